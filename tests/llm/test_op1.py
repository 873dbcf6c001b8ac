from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from roadloom.llm.op1_itq import ItqPolicy, candidates, encode, fit_rotation, layout_for, near_duplicates, unit_rows
from roadloom.llm.registry import ORACLES, QUERIES


def plain(rows, threshold=0.93):
    good = [i for i, (k, lab, v) in enumerate(rows) if k is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)))
    near = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]) and cos(np.array(rows[i][2], float), np.array(rows[j][2], float)) >= threshold:
                near[i].add(j)
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((k, len(near[i]), c, k == c))
    return sorted(out, key=repr)


def make_rows():
    rng = np.random.default_rng(1)
    rows, key = [], 0
    for _ in range(40):
        base = rng.normal(size=24)
        for s in rng.choice([0, 0.05, 0.15, 0.6], rng.integers(1, 6)):
            rows.append((key, int(rng.integers(0, 2)), [float(np.float32(x)) for x in base + s * rng.normal(size=24)]))
            key += 1
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 3, [2.0] * 3, [1e30] * 24, [1e-30] * 24]
    rows += [(1000 + i, 1, v) for i, v in enumerate(odd)] + [(2000, None, rows[0][2]), (None, 1, rows[0][2]), (3, rows[3][1], rows[3][2])]
    return rows


def test_against_brute_force(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumnRenamed("vec_id", "id")
    clash = df.selectExpr("id", "label", "embedding", "1 as digest", "2 as codes", "3 as dim", "4 as _again")
    rows32 = [(k, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, lab, v in rows]
    for layout in (None, (3, 4)):
        got = near_duplicates(clash, key="id", policy=ItqPolicy(layout=layout))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows32)


def test_great_and_small_components(spark):
    rows = [(1, 0, [1e200, 2e200]), (2, 0, [1.0, 2.0]), (3, 0, [1e-200, 2.1e-200]), (4, 0, [1e308, -1e308]), (5, 0, [5e-324, 0.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]


def test_recall_at_the_threshold(spark):
    """Of pairs barely above the threshold, in every layout, at least 0.9 are found; and none below it."""
    rng, rows = np.random.default_rng(12), []
    for i in range(1500):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= a * (a @ b)
        c = 0.93 + 0.004 * rng.random() if i % 5 else 0.925
        rows += [(2 * i, 0, a.tolist()), (2 * i + 1, 0, (c * a + (1 - c * c) ** 0.5 * b / np.linalg.norm(b)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert [layout_for(n) for n in (0, 10**5, 10**7)] == [(1, 6), (3, 4), (7, 3)]
    for layout in ((1, 6), (3, 4), (7, 3)):
        found = {r["vec_id"] // 2 for r in near_duplicates(df, policy=ItqPolicy(layout=layout)).where("n_links > 0").collect()}
        print(layout, len(found) / 1200)
        assert len(found) >= 0.9 * 1200 and all(i % 5 for i in found)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_rotation_balances_and_keeps_neighbours():
    x = np.random.default_rng(0).normal(size=(500, 32))
    mean, p = fit_rotation(x, 64, 20, 0)
    assert np.allclose(p.T @ p, np.eye(32))
    codes = encode(x, mean, p).view(np.uint64)
    near = encode(x + 0.05 * np.random.default_rng(1).normal(size=x.shape), mean, p).view(np.uint64)
    assert np.bitwise_count(codes ^ near).mean() < 2 < 10 < np.bitwise_count(codes[:-1] ^ codes[1:]).mean()


def test_short_vectors(spark):
    """Codes of 16 dimensions tell vectors apart as those of 64 do: few pairs are compared, and links are found."""
    from pyspark.sql import functions as F

    from roadloom.llm.op1_itq import with_codes

    rng, rows = np.random.default_rng(3), []
    for i in range(1500):
        a = rng.normal(size=16)
        rows += [(2 * i, 0, a.tolist()), (2 * i + 1, 0, (a + 0.05 * rng.normal(size=16)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    coded = with_codes(df, ItqPolicy()).select("label", "dim", F.col("vec_id").alias("rep"), "codes")
    pairs = {tuple(r) for r in candidates(coded, ItqPolicy()).collect()}
    assert len(pairs) < 0.15 * 3000 * 2999 / 2
    assert sum((2 * i, 2 * i + 1) in pairs for i in range(1500)) >= 0.98 * 1500


def test_candidates_miss_nothing(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    codes = [base] + [base ^ int(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in (1, 3, 6, 9, 11, 11, 11, 12, 14)]
    codes = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    df = spark.createDataFrame([(1, 4, i, [c]) for i, c in enumerate(codes)], "label int, dim int, rep long, codes array<long>")
    got = [tuple(r) for r in candidates(df, ItqPolicy()).collect()]
    want = [(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin((codes[i] ^ codes[j]) & (2**64 - 1)).count("1") <= 11]
    assert sorted(got) == want


def test_unit_rows():
    rows, ok = unit_rows(pa.array([[3.0, 4.0], None, [0.0, 0.0], [1.0], []], pa.list_(pa.float32())), 3)
    assert ok.tolist() == [True, False, False, True, False]
    assert rows[0].tolist() == [0.6, 0.8, 0.0]


def test_query_equals_sql(spark, sf):
    from compare import connect, rows_of, rows_of_sql

    for name in ("op1_itq", "embedding_copies", "page_domains", "op6_raking", "op7_host_rules", "op9_hilbert"):
        df = QUERIES[name](spark, sf)
        assert rows_of(df) == rows_of_sql(connect(sf), ORACLES[name], df.columns), name


def test_no_link_is_missed_in_any_layout(spark):
    """Pairs barely above the threshold, of which some differ in more than 11 bits: all are found, in all layouts."""
    rng, rows, n = np.random.default_rng(21), [], 600
    for i in range(n):
        size = (64, 20)[i % 2]
        a, b = rng.normal(size=size), rng.normal(size=size)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        c = 0.9301 if i % 5 else 0.9299
        rows += [(2 * i, i % 3, a.tolist()), (2 * i + 1, i % 3, (c * a + (1 - c * c) ** 0.5 * b / np.linalg.norm(b)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = sorted(2 * i + j for i in range(n) if i % 5 for j in (0, 1))
    for layout in ((1, 6), (3, 4), (7, 3)):
        got = near_duplicates(df, policy=ItqPolicy(layout=layout)).where("n_links > 0")
        assert sorted(r["vec_id"] for r in got.collect()) == want, layout


def test_size_decides_no_result_of_hamming_balls(spark, monkeypatch):
    """Without complete search too, links are the same whatever layout the largest label would have."""
    from roadloom.llm import op1_itq

    rng, rows = np.random.default_rng(4), []
    for i in range(300):
        a, b = rng.normal(size=64), rng.normal(size=64)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        rows += [(2 * i, 0, a.tolist()), (2 * i + 1, 0, (0.8501 * a + (1 - 0.8501**2) ** 0.5 * b / np.linalg.norm(b)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = []
    for layout in ((1, 6), (7, 3)):
        monkeypatch.setattr(op1_itq, "layout_for", lambda n, x=layout: x)
        got.append({r["vec_id"] for r in near_duplicates(df, policy=ItqPolicy(threshold=0.85, complete=False)).where("n_links > 0").collect()})
    assert got[0] == got[1]


def test_blocks_find_what_tables_find(spark, monkeypatch):
    """Large labels are compared by blocks: all links are found, within blocks and between, and nothing else is written."""
    from roadloom.llm import op1_itq

    rows = make_rows()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    written = {}
    stage = op1_itq.staged

    def staged(table, name="step"):
        out = written[name] = stage(table, name)
        return out

    monkeypatch.setattr(op1_itq, "staged", staged)
    monkeypatch.setattr(op1_itq, "_ROWS", 5)
    for most, block in ((0, (7, 20)), (0, (1000, 1000)), (1 << 30, (7, 20))):
        monkeypatch.setattr(op1_itq, "MOST_IN_TABLES", most)
        monkeypatch.setattr(op1_itq, "BLOCK", block)
        written.clear()
        assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr) == plain(rows)
        assert ("pairs" in written) == (most == 0)
        if most == 0:
            assert sorted(map(tuple, written["pairs"].collect())) == sorted(map(tuple, written["links"].collect()))
            assert "probes" not in written["codes"].columns


def test_pairs_at_the_threshold_are_found_by_blocks(spark, monkeypatch):
    from roadloom.llm import op1_itq

    monkeypatch.setattr(op1_itq, "MOST_IN_TABLES", 0)
    rng, rows = np.random.default_rng(22), []
    for i in range(200):
        size = (64, 20)[i % 2]
        a, b = rng.normal(size=size), rng.normal(size=size)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        c = 0.93 + (1e-12 if i % 5 else -1e-12)
        rows += [(2 * i, i % 3, a.tolist()), (2 * i + 1, i % 3, (c * a + (1 - c * c) ** 0.5 * b / np.linalg.norm(b)).tolist())]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).where("n_links > 0")
    assert sorted(r["vec_id"] for r in got.collect()) == sorted(2 * i + j for i in range(200) if i % 5 for j in (0, 1))
