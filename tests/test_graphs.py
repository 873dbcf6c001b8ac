from __future__ import annotations

import hashlib
import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from roadloom.operators import metrics, placement, reach
from roadloom.operators.components import connected_components
from roadloom.operators.road_graph import Graph, graph_from_request
from roadloom.plans.config import ConfigBook, PipelineConfig, PlacementRequest
from roadloom.plans.store import GraphStore


def make(spark, edges, nodes=None) -> Graph:
    names = sorted(nodes or {n for e in edges for n in e[:2]})
    rows = [(n, 48.0 + i * 0.001, 17.0 + (i % 7) * 0.002, False, None, None) for i, n in enumerate(names)]
    n = spark.createDataFrame(rows, "node_id string, lat double, lon double, off_road boolean, first_seen timestamp, last_seen timestamp")
    return Graph(n, spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in edges], "src string, dst string, dist_m double"))


def path(n, w=100):
    return [(f"n{i}", f"n{i + 1}", w) for i in range(n - 1)]


def links(edges):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    return near


def within(near, s, r):
    best, heap = {s: 0.0}, [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, w in near.get(u, {}).items():
            if d + w <= r and d + w < best.get(v, 1e18):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


def random_edges(seed, n=40, m=70):
    rng = random.Random(seed)
    out = {}
    while len(out) < m:
        a, b = sorted(rng.sample(range(n), 2))
        out[(f"v{a:02d}", f"v{b:02d}")] = rng.randint(50, 400)
    return [(a, b, w) for (a, b), w in sorted(out.items())]


CASES = [
    ([], ["a"], dict(diameter_m=0, radius_m=0, components=1, treewidth=0, clustering=0)),
    (path(5), None, dict(diameter_m=400, radius_m=200, components=1, treewidth=1, clustering=0)),
    ([("a", "b", 100), ("b", "c", 100), ("a", "c", 100)], None, dict(diameter_m=100, radius_m=100, components=1, treewidth=2, clustering=1)),
    ([("a", "b", 100), ("b", "c", 100), ("x", "y", 100)], None, dict(diameter_m=200, radius_m=100, components=2, treewidth=1, clustering=0)),
]


@pytest.mark.parametrize("edges, nodes, want", CASES)
def test_metrics_by_hand(spark, edges, nodes, want):
    row = metrics.compute_metrics(make(spark, edges, nodes)).first()
    assert {k: row[k] for k in want} == pytest.approx(want)


def test_metrics_of_nothing(spark):
    assert all(v == 0 for v in metrics.compute_metrics(make(spark, [], None)).first())


def test_metrics_sampled(spark):
    row = metrics.compute_metrics(make(spark, path(5)), threshold=3, seeds=5).first()
    assert (row["diameter_m"], row["radius_m"], row["treewidth"]) == (400, 200, -1)


def test_components(spark):
    edges = [(random.Random(3).choice("ab") + str(i), "c" + str(i % 17), 1) for i in range(60)] + path(60)
    df = spark.createDataFrame(edges + [("n1", "n1", 1), (None, "q", 1)], "src string, dst string, w int")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    near, want = links(edges), {}
    for n in sorted(near):
        if n not in want:
            for m in within(near, n, 1e9):
                want[m] = n
    assert got == want


def test_component_ids_and_pruning(spark):
    g = make(spark, path(6) + [("x", "y", 1)], [f"n{i}" for i in range(6)] + ["x", "y", "z"])
    ids = {r["node_id"]: r["component_id"] for r in metrics.with_component_ids(g).collect()}
    assert (ids["n0"], ids["x"], ids["z"]) == (0, 1, 2)
    assert metrics.prune_components(g, 23).nodes.count() == 8
    assert metrics.prune_components(g, 40).nodes.count() == 6
    with pytest.raises(ValueError):
        metrics.guard_size(g, 8)


def test_eccentricities_agree(spark):
    edges = random_edges(5)
    g = make(spark, edges)
    want = {n: max(within(links(edges), n, 1e9).values()) for n in links(edges)}
    assert {r[0]: r[1] for r in metrics.eccentricities(g).collect()} == pytest.approx(want)
    assert {r[0]: r[1] for r in metrics.eccentricities(g, g.nodes).collect()} == pytest.approx(want)


@pytest.mark.parametrize("by_joins", [None, True])
def test_reach(spark, by_joins):
    edges = random_edges(1)
    g, near = make(spark, edges), links(edges)
    got = {(r[0], r[1]): r[2] for r in reach.distances(g, radius_m=500, by_joins=by_joins).collect()}
    assert got == pytest.approx({(s, t): d for s in near for t, d in within(near, s, 500).items()})
    some = spark.createDataFrame([("v01", 100.0), ("v01", 300.0), ("v02", 50.0), ("none", 1e9)], "node_id string, limit_m double")
    got = {(r[0], r[1]): r[2] for r in reach.distances(g, some, by_joins=by_joins).where("src <> 'none'").collect()}
    assert got == pytest.approx({(s, t): d for s, m in (("v01", 300), ("v02", 50)) for t, d in within(near, s, m).items()})


def greedy_plain(near, nodes, r, k):
    at = {n: set(within(near, n, r)) for n in nodes}
    cover, out = dict.fromkeys(nodes, 0), []
    while True:
        todo = {n for n in nodes if cover[n] < k}
        free = sorted(todo - set(out))
        if not free:
            return out
        best = max(free, key=lambda c: (len(at[c] & todo), [-ord(x) for x in c]))
        out.append(best)
        for n in at[best]:
            cover[n] += 1


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 2)])
def test_greedy_is_sequential_greedy(spark, seed, k):
    edges = random_edges(seed)
    p = placement.place(make(spark, edges), PlacementRequest("GREEDY", k, 400))
    got = [r["node_id"] for r in p.stations.orderBy("rank").collect()]
    assert got == greedy_plain(links(edges), sorted(links(edges)), 400, k)
    near = links(edges)
    want = {n: min((within(near, s, 400).get(n, 1e9) for s in got), default=1e9) for n in near}
    assert {r[0]: r[1] for r in p.coverage.collect()} == pytest.approx({n: d if d <= 400 else -1.0 for n, d in want.items()})


def test_random_is_a_random_order(spark):
    edges = random_edges(3)
    g, near, k = make(spark, edges), links(edges), 2
    table = reach.bounded_reach(g, 300)
    runs = placement.random_runs(table, g.nodes, k, 3, seed=1).collect()
    for run in range(3):
        cover, want = dict.fromkeys(near, 0), set()
        for n in sorted(near, key=lambda n: (hashlib.md5(f"{run}:{n}:1".encode()).hexdigest(), n)):
            if cover[n] < k:
                want.add(n)
                for m in within(near, n, 300):
                    cover[m] += 1
        assert {r["node"] for r in runs if r["run"] == run} == want


def test_grasp_covers_and_is_minimal(spark):
    edges = random_edges(4, 30, 60)
    near, k, r = links(edges), 2, 400
    p = placement.place(make(spark, edges), PlacementRequest("GRASP", k, r, iterations=2, seed=5))
    chosen = {x["node_id"] for x in p.stations.collect()}
    at = {n: set(within(near, n, r)) for n in near}
    cover = {n: len(at[n] & chosen) for n in near}
    assert all(cover[n] >= min(k, len(at[n])) for n in near)
    assert not [s for s in chosen if all(cover[n] > k for n in at[s])]
    assert p.objective == len(chosen) and p.total_nodes == len(near)


def test_grasp_takes_from_the_list(spark):
    edges = random_edges(6)
    g, near, k, r = make(spark, edges), links(edges), 1, 400
    table = reach.bounded_reach(g, r)
    # With alpha 0 and all evaluated, the first choices have the highest gain of all.
    gains = reach.coverage_gain(table, g.nodes).selectExpr("0 as run", "node_id as node", "gain as g")
    top = max(len(within(near, n, r)) for n in near)
    least = min(len(within(near, n, r)) for n in near)
    for alpha in (0.0, 0.5, 1.0):
        rows = placement.restricted(gains, alpha, 10**6, 0, 1).collect()
        assert {x["node"] for x in rows} == {n for n in near if len(within(near, n, r)) >= math.ceil(top - alpha * (top - least) - 1e-9)}
    some = placement.restricted(gains, 1.0, 10, 0, 1).collect()
    assert 1 <= len(some) <= 25
    runs = placement.grasp_runs(table, g.nodes, k, 2, 0.4, seed=2, budget=15).collect()
    for run in range(2):
        chosen = {x["node"] for x in runs if x["run"] == run}
        assert all(set(within(near, n, r)) & chosen for n in near)


def test_swaps_go_on_to_the_end(spark):
    edges = random_edges(9, 24, 36)
    g, near, k = make(spark, edges), links(edges), 1
    table = reach.bounded_reach(g, 300)
    stations = placement.grasp_runs(table, g.nodes, k, 1, 1.0, seed=3)
    assert placement.swap_round(table, stations, k).count() == 0


def test_concurrent_saves_have_their_own_ids(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    stores, g = [GraphStore(spark, f"file://{tmp_path}/graphs") for _ in range(4)], make(spark, path(3))
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda s: s.save(g, "g", 1), stores))
    assert len(set(ids)) == 4 and {r["node_count"] for r in stores[0].list(1).collect()} == {3}


def test_swap_frees_a_station(spark):
    # Stations b and d of a path of five: c alone would not do, but stations a and d can become b and d.
    edges = path(4)
    table = reach.bounded_reach(make(spark, edges), 100)
    stations = spark.createDataFrame([(0, "n0"), (0, "n2"), (0, "n3")], "run int, node string")
    swap = placement.swap_round(table, stations, 1).collect()
    near, at = links(edges), {}
    for n in near:
        at[n] = set(within(near, n, 100))
    for s in swap:
        now = {"n0", "n2", "n3"} - {s["out"]} | {s["into"]}
        cover = {n: len(at[n] & now) for n in near}
        assert min(cover.values()) >= 1
        assert any(all(cover[n] > 1 for n in at[x]) for x in now)


def test_removal_in_few_steps(spark, monkeypatch):
    """Rounds by which the redundant stations of least ids go, as SQL makes them: many on a grid whose ids follow its
    rows, but few written steps. What reaches nothing stays."""
    n, k, rng = 9, 2, random.Random(12)
    names = {(y, x): f"c{y}{x}" for y in range(n) for x in range(n)}
    at = {a: {b for q, b in names.items() if abs(q[0] - p[0]) + abs(q[1] - p[1]) <= 2} for p, a in names.items()}
    table = spark.createDataFrame([(a, b) for a, found in at.items() for b in found], "src string, dst string")
    runs = {0: set(at), 1: {a for a in at if rng.random() < 0.6}, 2: {"c44"}}
    want, turns = set(), 0
    for run, chosen in runs.items():
        now = set(chosen)
        for turn in range(n * n):
            cover = {b: len(at[b] & now) for b in at}
            spare = [a for a in now if all(cover[b] > k for b in at[a])]
            gone = {a for a in spare if not any(b < a and at[a] & at[b] for b in spare)}
            if not gone:
                break
            now, turns = now - gone, max(turns, turn + 1)
        want |= {(run, a) for a in now}
    assert turns > 8
    rows = [(run, a) for run, chosen in runs.items() for a in chosen] + [(2, "alone")]
    monkeypatch.setattr(placement, "_MAX_ROUNDS", 4)
    got = placement.remove_redundant(table, spark.createDataFrame(rows, "run int, node string"), k)
    assert {tuple(r) for r in got.collect()} == want | {(2, "alone")}
    assert placement.remove_redundant(table, spark.createDataFrame([], "run int, node string"), k).count() == 0


def test_isolated_and_empty(spark):
    p = placement.place(make(spark, [("a", "b", 50)], ["a", "b", "z"]), PlacementRequest("GREEDY", 2, 100))
    assert {r["node_id"] for r in p.stations.collect()} == {"a", "b", "z"}
    table = reach.bounded_reach(make(spark, [("a", "b", 50)], ["a", "b", "z"]), 100)
    assert [(r[0], r[1]) for r in placement.under_covered(table, p.stations.select("node_id"), p.stations, 2).collect()] == [("z", 1)]
    for a in ("GREEDY", "RANDOM", "GRASP"):
        assert placement.place(make(spark, [], None), PlacementRequest(a)).objective == 0


def test_request(spark):
    g = graph_from_request(spark, {
        "nodes": [{"id": "a", "lat": 1, "lon": 2, "componentId": 9}, {"id": "a", "lat": 5, "lon": 5}, {"id": "b", "lat": 3, "lon": 4}],
        "edges": [{"sourceId": "b", "targetId": "a", "distanceMeters": 7}, {"sourceId": "a", "targetId": "b", "distanceMeters": 1}, {"sourceId": "a", "targetId": "x", "distanceMeters": 1}],
    })
    assert [tuple(r) for r in g.edges.collect()] == [("a", "b", 7.0)]
    assert {r["node_id"]: r["lat"] for r in g.nodes.collect()} == {"a": 1.0, "b": 3.0}
    with pytest.raises(ValueError):
        graph_from_request(spark, {"nodes": [], "edges": [{"sourceId": "a", "targetId": "a", "distanceMeters": 1}]})


def test_store(spark, tmp_path):
    store, g = GraphStore(spark, f"file://{tmp_path}/graphs"), make(spark, path(3))
    assert store.list(1).count() == 0
    one = store.save(g, "one", 1, placement.place(g, PlacementRequest("GREEDY", 1, 100)).stations, metrics.compute_metrics(g))
    two = store.save(g, "two", 1)
    assert one != two
    assert {r["name"]: (r["node_count"], r["edge_count"], r["station_count"]) for r in store.list(1).collect()} == {"one": (3, 2, 1), "two": (3, 2, 0)}
    store.rename(two, "three", 1)
    graph, stations, row = store.load(one, 1)
    assert graph.edges.count() == 2 and stations.first()["rank"] == 1 and row.first()["node_count"] == 3
    for bad in (lambda: store.load(one, 2), lambda: store.delete(one ^ 1, 1)):
        with pytest.raises(ValueError):
            bad()
    store.delete(one, 1)
    assert [r["name"] for r in store.list(1).collect()] == ["three"]


def test_config():
    book = ConfigBook()
    assert book.active("u").k == 2 and book.update("u", k=5).k == 5 and book.active("v").k == 2 and book.reset("u").k == 2
    for bad in (dict(cell_resolution=16), dict(grasp_alpha=1.5), dict(country="de"), dict(algorithm="X"), dict(k=0)):
        with pytest.raises(ValueError):
            PipelineConfig(**bad)


def test_renames_at_the_same_time(spark, tmp_path):
    """Each of several writers gets a revision of its own, and the last one names the graph."""
    from concurrent.futures import ThreadPoolExecutor

    store = GraphStore(spark, f"file://{tmp_path}/graphs")
    one, other = store.save(make(spark, path(3)), "first", 1), store.save(make(spark, path(4)), "others", 2)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.rename(one, f"name {i}", 1), range(4)))
    rows = spark.read.parquet(f"file://{tmp_path}/graphs/headers").where(f"graph_id = {one}").collect()
    assert len({r["revision"] for r in rows}) == len(rows) == 5
    [named] = store.list(1).collect()
    assert named["name"] == max(rows, key=lambda r: r["revision"])["name"] and named["node_count"] == 3
    plan = store.list(1)._jdf.queryExecution().optimizedPlan().toString()
    assert str(one) in plan and str(other) not in plan


def test_exact_budget(spark):
    """As many candidates are evaluated as the budget allows, those of the least draws."""
    import hashlib

    gains = [(run, f"n{i}", 1 + (i * 7 + run) % 50) for run, n in ((0, 3000), (1, 40), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(gains, "run int, node string, g long")
    for budget in (1, 40, 500):
        got = {(r["run"], r["node"]) for r in placement.restricted(df, 1.0, budget, 3, 9).collect()}
        want = set()
        for run in (0, 1, 2):
            own = sorted((hashlib.md5(f"{n}:{run}:9:3".encode()).hexdigest(), n) for r, n, _ in gains if r == run)
            want |= {(run, n) for _, n in own[:budget]}
        assert got == want


def test_ranked(spark):
    from roadloom.plans.order import ranked

    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(500)], "a long, _part long").withColumn("rank", F.lit("old"))
    rows = ranked(df, "a", "_part").collect()
    assert sorted((r["a"], r["_part"], r["rank"]) for r in rows) == [(*x, i) for i, x in enumerate(sorted((i * 7 % 101, i) for i in range(500)))]
    assert ranked(df.limit(0), "a").count() == 0
