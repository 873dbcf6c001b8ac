from __future__ import annotations

import re
from collections import Counter

import pytest

from roadloom.llm.op13_divergence import AuditPolicy, audit, op13_divergence, oracle

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, p):
    n, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(UPPER))
        n.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        vocabulary = sorted(t for (la, t), c in docs.items() if la == lang and c >= p.min_docs)
        sources = sorted(s for la, s in groups if la == lang)
        v = len(vocabulary)
        count = {s: {t: n[lang, s, t] for t in vocabulary} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in vocabulary}
        share = {s: {t: 1 + p.scale * (c + p.smoothing) // (sum(of.values()) + p.smoothing * v) for t, c in of.items()} for s, of in count.items()}
        for s in sources:
            pairs = [(o, sum(abs(share[s][t] - share[o][t]) for t in vocabulary)) for o in sources if o != s]
            terms = [(t, share[s][t] - share[None][t]) for t in vocabulary if count[s][t] and share[s][t] > share[None][t]]
            for part, of in (("pair", pairs), ("term", terms)):
                of.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(of) if part == "pair" or i < p.top_terms]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def make():
    """Ties, repeated rows, null everything, a language without vocabulary, a group without terms."""
    rows = [(i, f"Road road w{i % 7}x É{'abc'[i % 3]} 東京{i % 2} tie tea" + " zig" * (i % 5), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(60)]
    rows += [(1, "same same", "de", "a")] * 6 + [(2, "rare", "fr", "a"), (3, "words", "fr", "b"), (4, None, "en", "silent"), (5, "", None, None), (6, "road", "", ""), (None, "road road", None, "x")]
    return rows + [(7, "long " * 50_000, "en", "s1"), (8, "ſtreet K İ", "en", "s1")]


@pytest.mark.parametrize("policy", [AuditPolicy(min_docs=4), AuditPolicy(min_docs=1, top_terms=3, broadcast_groups=0, broadcast_terms=0), AuditPolicy()])
def test_against_brute_force(spark, odd, policy):
    rows = make() + [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as term", "2 as n", "3 as total", "4 as docs", "5 as v")
    assert got(audit(df, policy=policy)) == plain(rows, policy)


def test_large_counts(spark):
    """Shares are exact where their numerators pass 64 bits."""
    from pyspark.sql import functions as F

    from roadloom.llm.op13_divergence import _share

    n = [0, 7, 10**12, 10**14 + 1, 3 * 10**14]
    df = spark.createDataFrame([(x, 4 * 10**14 + 3, 10**9) for x in n], "n long, total long, v long")
    rows = df.select("n", _share(F.col("n"), F.col("total"), F.col("v"), AuditPolicy()).alias("p")).collect()
    assert {r["n"]: r["p"] for r in rows} == {x: 1 + 10**9 * (x + 5) // (4 * 10**14 + 3 + 5 * 10**9) for x in n}


def test_empty(spark, none):
    assert audit(none).count() == 0


def test_query_equals_sql(spark, sf):
    from compare import connect, rows_of, rows_of_sql

    df = op13_divergence(spark, sf)
    assert rows_of(df) == rows_of_sql(connect(sf), oracle(), df.columns)
