from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from roadloom.llm import op12_winnowing as win
from roadloom.llm.op12_winnowing import WinnowPolicy, contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(t):
    return WORD.findall((t or "").translate(UPPER))


def plain(docs, items, words=10):
    windows = []
    for key, t in items:
        w = words_of(t)
        m = min(words, len(w))
        windows += [(None if key is None else str(key), tuple(w[i : i + m])) for i in range(len(w) - m + 1) if m]
    by = {}
    for key, w in windows:
        by.setdefault(w, set()).add(key)
    sizes = {len(w) for w in by}
    out = []
    for k, t in docs:
        w, hit, held = words_of(t), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (x := tuple(w[i : i + m])) in by:
                    hit |= set(range(i, i + m))
                    held |= by[x] - {None}
        out.append((k, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=repr)


def make():
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(rng.choice(["the", "road", "goes", "on", "Élan", "東京", "x1", "9", "is", "it's", "UP"], n))
    items = [(i, prose(int(n))) for i, n in enumerate([30, 10, 11, 9, 3, 1, 60, 12])]
    items += [(8, items[0][1]), (8, "another row of the item that repeats its key and has words enough"), (9, None), (10, "?!"), (None, "an item that has no key at all but quite enough words to be found"), (11, "Same " * 40)]
    docs = [(i, prose(int(n))) for i, n in enumerate([0, 1, 5, 50, 200, 3000])]
    for i, (_, t) in enumerate(items):
        t = t or ""
        docs += [(100 + i, prose(20) + ", " + t.upper() + "\n" + prose(3)), (200 + i, t), (300 + i, t[: len(t) // 2]), (400 + i, t.replace(" ", "--") + prose(7) + " " + t)]
    docs += [(500, "same " * 2000), (501, None), (502, "zq " * 5 + "same " * 9), (503, "9" * 200_000 + " " + items[0][1]), (None, items[6][1]), (100, docs[6][1])]
    return docs, items


@pytest.mark.parametrize("limit", [300_000, 0])
def test_against_brute_force(spark, odd, none, limit):
    docs, items = make()
    docs += [tuple(r)[:2] for r in odd.collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as N_HIT", "2 as digest", "3 as window", "4 as contaminated", "5 as size")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as print", "2 as item")
    p = WinnowPolicy(broadcast_windows=limit)
    out = contamination(df, it, policy=p)
    assert got(out) == plain(docs, items) and {"digest", "window", "size"} <= set(out.columns)
    assert contamination(none, it, policy=p).count() == 0
    assert got(contamination(df, it.limit(0), policy=p)) == plain(docs, [])
    few = WinnowPolicy(words=4, gram=2, broadcast_windows=limit)
    assert got(contamination(df, it, policy=few)) == plain(docs, items, 4)


def test_blocks(monkeypatch):
    """Words are the same however texts are cut into blocks, within words longer than one too."""
    text = ("Ab é東 " * 50 + "w" * 300 + " ,, 12x\x00Q ").encode() * 3
    raw = np.frombuffer(text, np.uint8)
    whole = win.word_hashes(raw)
    assert [text[a:b].decode().translate(UPPER) for a, b in zip(*whole[:2], strict=True)] == words_of(text.decode())
    for block in (1, 7, 64):
        monkeypatch.setattr(win, "BLOCK", block)
        win._powers.cache_clear()
        assert all(np.array_equal(x, y) for x, y in zip(whole, win.word_hashes(raw), strict=True))
    win._powers.cache_clear()


def test_fingerprints_guarantee():
    """A window has one fingerprint wherever it stands."""
    rng, p = np.random.default_rng(3), WinnowPolicy()
    words = rng.integers(0, 5, 4000).astype(np.uint64)
    place, grams = win.fingerprints(words, p)
    seen = {}
    for i, at in enumerate(place.tolist()):
        assert i <= at <= i + p.words - p.gram
        assert seen.setdefault(tuple(words[i : i + p.words].tolist()), (at - i, grams[at])) == (at - i, grams[at])
    assert len(np.unique(place)) < 0.6 * len(place)


def test_query_equals_sql(spark, sf):
    from compare import connect, rows_of, rows_of_sql

    df = win.op12_winnowing(spark, sf)
    assert rows_of(df) == rows_of_sql(connect(sf), win.oracle(), df.columns)
