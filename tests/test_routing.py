"""Fastest ways over one-way roads and turns back, by brute force and by hand."""

from __future__ import annotations

import heapq
import random

import pytest

from roadloom.functions.geo import haversine_m
from roadloom.operators.matching import RoadMatcher, paths_of
from roadloom.operators.road_graph import Graph
from roadloom.operators.routing import DirectedMatcher, Roads, fastest, roads_of, turns

NODES, ARCS = "node_id string, lat double, lon double", "src string, dst string, dist_m double, time_s double"
SEGMENTS = "edge_id long, base long, adj long, car_fwd boolean, car_bwd boolean, road_env string, geometry array<struct<lat: double, lon: double>>, speed_kmh double"


def brute(arcs, start, u_turn):
    """(time, metres, turns) to each arc's end by plain Dijkstra over arcs."""
    out, seen, heap = {}, {}, [(0.0, 0.0, 0, start, True)]
    while heap:
        t, d, h, e, first = heapq.heappop(heap)
        if not first:
            if e in seen:
                continue
            seen[e] = out[e] = (t, d, h)
        for f, (dist, time) in arcs.items():
            if f[0] == e[1] and f not in seen:
                heapq.heappush(heap, (t + (time + (u_turn if f[1] == e[0] else 0.0)), d + dist, h + 1, f, False))
    return out


@pytest.mark.parametrize("by_joins", [False, True])
def test_fastest(spark, by_joins):
    rng = random.Random(5)
    arcs = {}
    for _ in range(70):
        a, b = rng.sample("abcdefghijklmno", 2)
        arcs[a, b] = (float(rng.randint(0, 5)), float(rng.randint(0, 9)))
    roads = Roads(spark.createDataFrame([], NODES), spark.createDataFrame([(*k, *v) for k, v in arcs.items()], ARCS))
    sources = spark.createDataFrame([(f"{a}|{b}", 30.0) for a, b in arcs] + [("x|y", 9.0), ("a|b", 1.0)], "node_id string, limit_s double")
    for u_turn in (0.0, 7.0):
        got = {(r["src"], r["dst"]): (r["dist_m"], r["along"]) for r in fastest(roads, sources, u_turn, by_joins).collect()}
        want = {("|".join(s), "|".join(f)): x[:2] for s in arcs for f, x in brute(arcs, s, u_turn).items() if x[0] <= 30}
        assert got == want
    none = spark.createDataFrame([], "node_id string, limit_s double")
    assert fastest(roads, none, 1.0, by_joins).count() == 0


def test_fastest_by_cells(spark, monkeypatch):
    """Roads beyond the limit of arrays are searched cell by cell, however small the cells and groups, with turns that
    cost something, ways of no length and nodes without a place; no table of turns is relaxed."""
    from roadloom.operators import routing

    rng, arcs = random.Random(7), {}
    nodes = [(f"n{i}", 48 + rng.random() / 10, 17 + rng.random() / 10) for i in range(30)]
    for _ in range(90):
        a, b = rng.sample([n for n, _, _ in nodes] + ["lost", "gone"], 2)
        arcs[a, b] = (float(rng.randint(0, 5)), float(rng.randint(0, 9)))
    arcs["n0", "n1"], arcs["n1", "n0"] = (3.0, 2.0), (3.0, 2.0)
    roads = Roads(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*k, *v) for k, v in arcs.items()], ARCS))
    sources = spark.createDataFrame([(f"{a}|{b}", 30.0) for a, b in arcs] + [("x|y", 9.0), ("n0|n1", 1.0)], "node_id string, limit_s double")
    for most, rows, u_turn in ((10**6, 10**6, 7.0), (12, 5, 7.0), (12, 10**6, 0.0)):
        got = {(r["src"], r["dst"]): tuple(r)[2:] for r in routing.fastest_by_cells(roads, sources, u_turn, most, rows).collect()}
        assert got == {("|".join(s), "|".join(f)): x for s in arcs for f, x in brute(arcs, s, u_turn).items() if x[0] <= 30}
    monkeypatch.setattr(routing, "MAX_BROADCAST_EDGES", 10)
    monkeypatch.setattr(routing, "relax", None)
    assert fastest(roads, sources, 7.0).count() == sum(x[0] <= 30 for s in arcs for x in brute(arcs, s, 7.0).values())


def test_paths_over_edges_of_no_length(spark):
    """Paths end though edges of length 0 leave distances equal, along directed arcs and around circles too."""
    adj = spark.createDataFrame([(a, b, w) for a, b, w in [("z", "b", 5.0), ("b", "c", 0.0), ("c", "d", 2.0), ("b", "e", 0.0), ("e", "c", 0.0)] for a, b in ((a, b), (b, a))], "u string, v string, w double")
    from roadloom.operators.reach import relax

    routes = relax(adj, spark.createDataFrame([("z", 100.0), ("d", 100.0)], "node_id string, limit_m double")).drop("along")
    pairs = spark.createDataFrame([("z", "d"), ("d", "e"), ("z", "z")], "x string, y string")
    got = {}
    for r in paths_of(adj, routes, pairs).orderBy("back").collect():
        got.setdefault((r["x"], r["y"]), []).append(r["node"])
    assert got == {("z", "d"): ["d", "c", "b", "z"], ("d", "e"): ["e", "c", "d"], ("z", "z"): ["z"]}


def segment(i, a, b, fwd, bwd, pts, speed=36.0):
    return (i, a, b, fwd, bwd, "ROAD", [(float(y), float(x)) for y, x in pts], speed)


def block(spark, one_way=True):
    """A block of streets: 1 east of 0, 3 north of 0, 2 north of 1; the street from 0 to 1 is one-way."""
    s = 0.01
    at = {0: (48.0, 17.0), 1: (48.0, 17.0 + s), 2: (48.0 + s, 17.0 + s), 3: (48.0 + s, 17.0)}
    rows = [segment(1, 0, 1, True, not one_way, [at[0], at[1]]), segment(2, 1, 2, True, True, [at[1], at[2]]), segment(3, 2, 3, True, True, [at[2], at[3]]), segment(4, 3, 0, True, True, [at[3], at[0]]), segment(4, 3, 0, True, True, [at[3], at[0]])]
    return roads_of(spark.createDataFrame([*rows, (5, 0, 0, True, True, "FERRY", [at[0], at[2]], 6.0)], SEGMENTS)), at


def test_roads_of(spark):
    roads, at = block(spark)
    arcs = {(r["src"], r["dst"]): (r["dist_m"], r["time_s"]) for r in roads.arcs.collect()}
    assert set(arcs) == {("0", "1"), *[(a, b) for x, y in ("12", "23", "30") for a, b in ((x, y), (y, x))]}
    assert arcs["0", "1"] == pytest.approx((haversine_m(*at[0], *at[1]), haversine_m(*at[0], *at[1]) / 10))
    assert {r["node_id"] for r in roads.nodes.collect()} == set("0123")


def test_one_way_detour(spark):
    """Against a one-way street the match goes around the block; along it, straight on; a small step back is no way."""
    roads, at = block(spark)
    trips = spark.createDataFrame([(2, 0, 48.0, 17.002), (2, 1, 48.0, 17.008), (2, 2, 48.0, 17.0079)], "trip_id int, pos int, lat double, lon double")
    straight = DirectedMatcher.on(roads, reach_m=40.0, slack_s=600.0)
    got = [(round(r["lat"], 5), round(r["lon"], 5)) for r in straight.match(trips).orderBy("trip_id", "pos").collect()]
    assert got == [(48.0, 17.002), (48.0, 17.0079)]
    back = spark.createDataFrame([(3, 0, 48.0, 17.008), (3, 1, 48.0, 17.002)], "trip_id int, pos int, lat double, lon double")
    line = [(round(r["lat"], 4), round(r["lon"], 4)) for r in straight.match(back).orderBy("pos").collect()]
    assert line == [(48.0, 17.008), (48.0, 17.01), (48.01, 17.01), (48.01, 17.0), (48.0, 17.0), (48.0, 17.002)]
    assert DirectedMatcher.on(roads, reach_m=40.0, slack_s=20.0).match(back).count() == 0
    both, _ = block(spark, one_way=False)
    assert DirectedMatcher.on(both, reach_m=40.0, slack_s=600.0).match(back).count() == 2


def test_directed_equals_undirected(spark):
    """Where every road is open both ways, at one speed, with free turns, places are on the same roads."""
    rng = random.Random(2)
    n = 5
    at = {i: (48 + 0.004 * (i // n) + rng.uniform(0, 5e-4), 17 + 0.006 * (i % n) + rng.uniform(0, 5e-4)) for i in range(n * n)}
    rows, k = [], 0
    for i in at:
        for j in ([i + 1] if i % n < n - 1 else []) + ([i + n] if i + n in at else []):
            k += 1
            rows.append(segment(k, i, j, True, True, [at[i], at[j]]))
    roads = roads_of(spark.createDataFrame(rows, SEGMENTS))
    edges = roads.arcs.where("src < dst").select("src", "dst", "dist_m")
    walk, pos, pts = 0, 0, []
    for trip in range(4):
        walk = rng.randrange(n * n)
        for pos in range(6):
            nxt = rng.choice([j for j in at if abs(at[j][0] - at[walk][0]) + abs(at[j][1] - at[walk][1]) < 0.0075 and j != walk])
            f = rng.uniform(0.2, 0.8)
            pts.append((trip, pos, at[walk][0] * (1 - f) + at[nxt][0] * f + rng.gauss(0, 5e-5), at[walk][1] * (1 - f) + at[nxt][1] * f + rng.gauss(0, 5e-5)))
            walk = nxt
    df = spark.createDataFrame(pts, "trip_id int, pos int, lat double, lon double")
    own = dict(reach_m=60.0, sigma_m=20.0, beta_m=80.0, slack_m=1e6)
    plain = {(r["trip_id"], r["pos"]): {r["a"], r["b"]} for r in RoadMatcher(Graph(roads.nodes, edges), **own).match_points(df).collect()}
    got = {(r["trip_id"], r["pos"]): {r["a"], r["b"]} for r in DirectedMatcher.on(roads, u_turn_s=0.0, slack_s=1e6, back_m=0.0, reach_m=60.0, sigma_m=20.0, beta_m=80.0).match_points(df).collect()}
    assert set(got) == set(plain) and len(got) == 24
    assert sum(got[k] == plain[k] for k in got) >= 20
    assert turns(roads.arcs, 1.0).count() == sum(d * d for d in [sum(1 for r in rows if i in (r[1], r[2])) for i in at])


def test_cells_equal_joins(spark):
    """Searching cell by cell gives the distances that joins give, at any size of cells and groups, in few rounds."""
    from roadloom.operators.reach import by_cells, cells_of, distances

    rng = random.Random(8)
    nodes = [(f"n{i}", rng.uniform(48, 49), rng.uniform(17, 18)) for i in range(120)] + [("lone", 10.0, 10.0)]
    edges = {}
    for a, y, x in nodes[:-1]:
        for b, _, _ in sorted(nodes[:-1], key=lambda n: (n[1] - y) ** 2 + (n[2] - x) ** 2)[1:4]:
            edges[min(a, b), max(a, b)] = float(rng.choice([0, 1, 2, 7, 7.3]))
    g = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, dist_m double"))
    sources = spark.createDataFrame([(n[0], rng.choice([0.0, 9.0, 30.0, 1e9])) for n in nodes[::3]] + [("lone", 5.0), ("absent", 5.0)], "node_id string, limit_m double")
    want = sorted(tuple(r) for r in distances(g, sources, by_joins=True).collect() if r["src"] != "absent")
    for most, rows in ((40, 30), (10**6, 10**6)):
        assert sorted(tuple(r) for r in by_cells(g, sources, most, rows).collect()) == want
    sizes = [r["n"] for r in cells_of(g, 40).groupBy("cell").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) > 5 and max(sizes) <= 40
    line = [(f"p{i:03}", 48.0, 17 + i * 1e-5) for i in range(300)]
    path = Graph(spark.createDataFrame(line, NODES), spark.createDataFrame([(f"p{i:03}", f"p{i + 1:03}", 1.0) for i in range(299)], "src string, dst string, dist_m double"))
    far = by_cells(path, spark.createDataFrame([("p000", 1e9)], "node_id string, limit_m double"), most_edges=10**6, max_rounds=3)
    assert far.agg({"dist_m": "max"}).first()[0] == 299.0
    assert by_cells(g, sources.limit(0)).count() == 0
