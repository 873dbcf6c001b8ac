from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from roadloom.llm.op11_anagrams import SpellingPolicy, near_words, op11_anagrams, oracle, spelling_forms, spelling_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(n, ratio=2):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b.encode()), default=None)
        form[a] = best if best is not None and n[best] >= ratio * n[a] else None
    out = []
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, n[a], len(near[a]), n[form[a]] if form[a] else None))
    return sorted(out)


def plain(rows, p=SpellingPolicy()):
    n = Counter()
    for k, t, *_ in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if p.drop_every and h % p.drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return plain_forms({w: x for w, x in n.items() if len(w) >= p.min_letters and x >= p.min_count}, p.ratio)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_query_equals_sql(spark, sf):
    from compare import connect, rows_of, rows_of_sql

    df = op11_anagrams(spark, sf)
    assert rows_of(df) == rows_of_sql(connect(sf), oracle(), df.columns)


def test_odd_tables(spark, odd, none):
    texts = ["wordy wordd word's naïve NAÏVE Naïve nàïve", "aaaaa baaaa abaaa aaaab aaaa aaaaaa " * 3, "Ünder ünder under unders Über " * 4, "x" * 100_000, "x" * 99_999 + "y", None, "ÿÿÿÿÿ×÷ÿÿÿÿÿ " * 5] * 3
    more = [(100 + i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(None, "nullkey nullkey nullkex", None, None, 0)] * 2
    df = odd.unionByName(spark.createDataFrame(more, odd.schema)).selectExpr("*", "1 as word", "2 as n", "3 as run", "4 as k")
    for p in (SpellingPolicy(), SpellingPolicy(drop_every=3, min_count=1)):
        assert got(spelling_groups(df, policy=p)) == plain([tuple(r)[:2] for r in df.collect()], p)
    assert spelling_groups(none).count() == 0


def test_paths_and_ties(spark):
    """A path of many steps ends in its root; equally frequent near words give the first; anagrams aren't near."""
    words = ["a" * (5 + i) for i in range(40)]
    n = {w: 2**i * 3 for i, w in enumerate(words)} | {"zbcde": 3, "ybcde": 12, "xbcde": 12, "zbced": 9, "zbdce": 50}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = got(spelling_forms(df))
    assert rows == plain_forms(n)
    assert {r[0]: r[2] for r in rows}["aaaaa"] == words[-1] and {r[0]: r[1] for r in rows}["zbcde"] == "xbcde"
    with pytest.raises(ValueError):
        spelling_forms(df, SpellingPolicy(ratio=1))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text("abé\U0001f600", min_size=0, max_size=6), max_size=60))
def test_near_words(spark, words):
    df = spark.createDataFrame([(w, 1) for w in words] + [(None, 5)], "word string, n long")
    pairs = [frozenset((r["a"], r["b"])) for r in near_words(df).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
