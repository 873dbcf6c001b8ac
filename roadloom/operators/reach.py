"""Distances along the graph: bounded reach, nearest stations, coverage.

Three ways, with the same results. A graph whose edges are few enough, which is counted first, goes to every task as
arrays, and each source is searched where it is. Beyond that, the graph is cut into square cells: each cell is searched
in a task, and only what crosses a border goes on to the next round. Without places, or where the fewest edges are
asked for too, distances are relaxed by joins.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import z_order
from roadloom.operators.road_graph import Graph, adjacency
from roadloom.plans.staging import drop_staged, keep_path, shared_dir, staged, staged_with

#: The most undirected edges, and nodes, of a graph that goes to every task: 24 bytes an edge and an id a node.
MAX_BROADCAST_EDGES, MAX_BROADCAST_NODES = 2_000_000, 1_000_000
_ROWS = 50_000
_FAR = (np.inf, 0)


@dataclass(frozen=True)
class Arrays:
    """A graph by node number: the neighbours of node i, and the weights, at starts[i] to starts[i + 1]."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    weights: np.ndarray

    def search(self, start: int, radius: float = np.inf) -> dict[int, tuple[float, int]]:
        """The distance from ``start`` to every node within ``radius``, and the fewest edges of a path so long."""
        best, done, heap = {start: (0.0, 0)}, {}, [(0.0, 0, start)]
        while heap:
            d, h, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = d, h
            at = slice(self.starts[u], self.starts[u + 1])
            for v, w in zip(self.ends[at].tolist(), self.weights[at].tolist(), strict=True):
                t = d + w
                if t <= radius and v not in done and (t, h + 1) < best.get(v, _FAR):
                    best[v] = t, h + 1
                    heapq.heappush(heap, (t, h + 1, v))
        return done


def arrays_of(graph: Graph, most_nodes: int = MAX_BROADCAST_NODES, most_edges: int = MAX_BROADCAST_EDGES) -> Arrays | None:
    """The graph as arrays on the driver, or None if it is larger than that; edges are counted before any is read."""
    if graph.edges.limit(most_edges + 1).count() > most_edges or graph.nodes.limit(most_nodes + 1).count() > most_nodes:
        return None
    ids = graph.nodes.select("node_id").distinct().toArrow().column(0).to_numpy(zero_copy_only=False)
    ids = np.sort(ids.astype(object))
    edges = graph.edges.select("src", "dst", F.col("dist_m").cast("double").alias("w")).toArrow()
    place = {n: i for i, n in enumerate(ids)}
    a, b = (np.fromiter((place.get(x, -1) for x in edges.column(i).to_pylist()), np.int64, edges.num_rows) for i in (0, 1))
    w, known = edges.column(2).to_numpy(), (a >= 0) & (b >= 0)
    a, b, w = (np.concatenate([x[known], y[known]]) for x, y in ((a, b), (b, a), (w, w)))
    order = np.argsort(a, kind="stable")
    starts = np.searchsorted(a[order], np.arange(len(ids) + 1))
    return Arrays(ids, starts, b[order], w[order])


def _searched(arrays: Arrays, sources: DataFrame) -> DataFrame:
    """(src, dst, dist_m, hops) of the sources (node_id, limit_m), each searched in the task that holds it."""
    shared = sources.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        def batch(src: list, dst: list, dist: list, hops: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(dist, pa.float64()), pa.array(hops, pa.int32())], names=["src", "dst", "dist_m", "hops"])

        for b in batches:
            src, dst, dist, hops = [], [], [], []
            for name, radius in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = int(np.searchsorted(g.ids, name)) if name is not None else len(g.ids)
                found = g.search(at, radius) if at < len(g.ids) and g.ids[at] == name else {}
                src += [name] * len(found)
                dst += [g.ids[i] for i in found]
                dist += [d for d, _ in found.values()]
                hops += [h for _, h in found.values()]
                if len(src) >= _ROWS:
                    yield batch(src, dst, dist, hops)
                    src, dst, dist, hops = [], [], [], []
            yield batch(src, dst, dist, hops)

    tasks = min(sources.sparkSession.sparkContext.defaultParallelism * 4, len(arrays.ids) // 64 + 1)
    return sources.repartition(tasks, "node_id").mapInArrow(run, "src string, dst string, dist_m double, hops int")


def relax(adj: DataFrame, sources: DataFrame, max_rounds: int = 10_000, from_neighbours: bool = False) -> DataFrame:
    """(src, dst, dist_m, along, hops): the shortest distance from each source (node_id, limit_m) to each node within
    its limit over ``adj`` (u, v, w, and along, a second measure that decides between equals; else 0), and the fewest
    edges of such a path.

    Each round joins the pairs that got shorter with their neighbours and keeps the minimum of each pair, so it ends
    after as many rounds as the longest of those paths has edges. Pairs are partial minima before they shuffle; every
    round is a written table, so a lost executor costs one round at most. ``dist_m`` is summed from the source on.
    ``from_neighbours``: paths have an edge at least, so a source is reached by a way around only.
    """
    adj = staged(adj if "along" in adj.columns else adj.withColumn("along", F.lit(0.0)), "adjacency")
    zero = sources.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("dist_m"), F.lit(0.0).alias("along"), F.lit(0).alias("hops"), "limit_m")

    def stepped(last: DataFrame, turn: int) -> DataFrame:
        step = last.join(adj.withColumnRenamed("along", "more"), F.col("dst") == F.col("u"))
        step = step.select("src", F.col("v").alias("dst"), (F.col("dist_m") + F.col("w")).alias("dist_m"), (F.col("along") + F.col("more")).alias("along"), F.lit(turn).alias("hops"), "limit_m")
        return step.where("dist_m <= limit_m")

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("src", "dst").agg(F.min(F.struct("dist_m", "along", "hops", "limit_m")).alias("b")).select("src", "dst", "b.*")

    first = 1 if from_neighbours else 0
    best = staged(least(stepped(zero, 1)) if from_neighbours else zero, "reach")
    for turn in range(first + 1, max_rounds):
        last = best.where(F.col("hops") == turn - 1)
        now, seen = staged_with(least(best.unionByName(stepped(last, turn))), "reach", n=F.count_if(F.col("hops") == turn))
        drop_staged(best)
        best = now
        if not seen["n"]:
            drop_staged(adj)
            return best.drop("limit_m")
    raise RuntimeError("distances did not settle")


def cells_of(graph: Graph, most_edges: int) -> DataFrame:
    """(node_id, cell): square cells, as large as they can be with ``most_edges`` ends of edges in each, if 65,536 by
    65,536 of them suffice. Levels are compared in one pass; 17 counts reach the driver."""
    z = graph.nodes.select("node_id", z_order(F.col("lat"), F.col("lon")).alias("z"))
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
    z = staged(z.join(ends, "node_id", "left").select("node_id", "z", (F.coalesce("n", F.lit(0)) + 1).alias("n")), "places")
    at = lambda level: F.shiftright(F.col("z"), 32 - 2 * level)
    sums = z.groupBy("z").agg(F.sum("n").alias("n")).select("n", F.inline(F.array(*[F.struct(F.lit(k).alias("level"), at(k).alias("cell")) for k in range(17)])))
    largest = {r["level"]: r["n"] for r in sums.groupBy("level", "cell").agg(F.sum("n").alias("n")).groupBy("level").agg(F.max("n").alias("n")).collect()}
    level = next((k for k in range(17) if largest.get(k, 0) <= most_edges), 16)
    return z.select("node_id", at(level).alias("cell"))


def _search_cell(rows: pa.Table, arcs: pa.Table) -> pa.Table:
    """Every source's search through one cell, from the nodes where it has come in; what leaves the cell is told, but
    not followed."""
    near: dict[str, list] = {}
    for u, v, w, cell, inside in zip(*(arcs.column(c).to_pylist() for c in ("u", "v", "w", "to", "inside")), strict=True):
        near.setdefault(u, []).append((v, w, cell, inside))
    entries: dict[tuple, list] = {}
    own = rows.column("cell")[0].as_py() if rows.num_rows else None
    for src, dst, dist, limit in zip(*(rows.column(c).to_pylist() for c in ("src", "dst", "dist_m", "limit_m")), strict=True):
        entries.setdefault((src, limit), []).append((dist, dst))
    out: list[tuple] = []
    for (src, limit), heap in entries.items():
        best, done, left = {}, {}, {}
        for d, n in heap:
            best[n] = min(d, best.get(n, np.inf))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = d
            for v, w, cell, inside in near.get(u, ()):
                t = d + w
                if t > limit:
                    continue
                if not inside:
                    if t < left.get(v, (np.inf,))[0]:
                        left[v] = t, cell
                elif v not in done and t < best.get(v, np.inf):
                    best[v] = t
                    heapq.heappush(heap, (t, v))
        out += [(src, n, d, limit, own, 1) for n, d in done.items()] + [(src, n, d, limit, cell, 2) for n, (d, cell) in left.items()]
    columns = list(zip(*out, strict=True)) or [()] * 6
    kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["src", "dst", "dist_m", "limit_m", "cell", "kind"])


def by_cells(graph: Graph, sources: DataFrame, most_edges: int = 100_000, group_rows: int = 200_000, max_rounds: int = 10_000) -> DataFrame:
    """(src, dst, dist_m): the shortest distance from each source (node_id, limit_m) to each node within its limit.

    Each round searches the cells that sources have come into, through all of a cell at once, so there are as many
    rounds as a path crosses borders, not as it has edges. A group is a cell's edges, at most ``most_edges`` by the
    cells' choice, with about ``group_rows`` entries of some of the sources; more sources make more groups. Distances
    are summed from the source on and kept as partial minima; every round is a written table.
    """
    cells = staged(cells_of(graph, most_edges), "cells")
    arcs = adjacency(graph.edges).join(cells.select(F.col("node_id").alias("u"), "cell"), "u").join(cells.select(F.col("node_id").alias("v"), F.col("cell").alias("to")), "v")
    arcs = staged(arcs.select("u", "v", "w", "cell", "to", (F.col("cell") == F.col("to")).alias("inside")), "arcs")
    zero = sources.join(cells, "node_id").select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("dist_m"), "limit_m", "cell", F.lit(2).alias("kind"))
    best = staged(zero, "reach")
    for _ in range(max_rounds):
        front = best.where("kind = 2")
        largest = front.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if not largest:
            return best.select("src", "dst", "dist_m")
        part = F.pmod(F.xxhash64("src"), F.lit(-(-largest // group_rows))).alias("part")
        front = front.select("src", "dst", "dist_m", "limit_m", "cell", part)
        groups = front.select(F.col("cell").alias("c"), F.col("part").alias("p")).distinct()
        known = arcs.join(groups, F.col("cell") == F.col("c")).select("u", "v", "w", "to", "inside", F.col("c").alias("cell"), F.col("p").alias("part"))
        found = front.groupBy("cell", "part").cogroup(known.groupBy("cell", "part")).applyInArrow(_search_cell, "src string, dst string, dist_m double, limit_m double, cell long, kind int")
        # Of equal distances the older one stays, so that nothing goes around in circles.
        rows = best.withColumn("kind", F.lit(0)).unionByName(found).groupBy("src", "dst").agg(F.min(F.struct("dist_m", "kind", "limit_m", "cell")).alias("b"))
        now = staged(rows.select("src", "dst", "b.dist_m", "b.limit_m", "b.cell", "b.kind"), "reach")
        drop_staged(best)
        best = now
    raise RuntimeError("distances did not settle")


_STATE = "src string, dst string, dist_m double, along double, hops int, limit_m double, cell long, at string, back string"


def _search_cells(rows: pa.Table, arcs: pa.Table, u_turn: float, first: bool) -> pa.Table:
    """Every source's search from arc to arc through each cell of a group on its own, from where it has come in; what
    leaves a cell is told, but not followed. kind: 2 what leaves, 3 where it came in, 1 the rest, and 0 all of a
    ``first`` search that leaves nothing. Ways have an arc at least; an arc that leads back costs ``u_turn`` more."""
    near: dict[str, list] = {}
    for u, v, w, more, cell, to in zip(*(arcs.column(c).to_pylist() for c in ("u", "v", "w", "along", "cell", "to")), strict=True):
        near.setdefault(u, []).append((f"{u}|{v}", v, w, more, to, cell == to))
    entries: dict[tuple, list] = {}
    for src, cell, limit, *entry in zip(*(rows.column(c).to_pylist() for c in ("src", "cell", "limit_m", "dist_m", "along", "hops", "dst", "at", "back")), strict=True):
        entries.setdefault((src, cell, limit), []).append(tuple(entry))
    out: list[tuple] = []
    for (src, cell, limit), heap in entries.items():
        best, done, left, entered = {}, {}, {}, {e[3] for e in heap}
        heapq.heapify(heap)
        while heap:
            d, along, h, name, at, back = heapq.heappop(heap)
            if h:
                if name in done:
                    continue
                done[name] = d, along, h
            for f, v, w, more, to, inside in near.get(at, ()):
                t = d + (w + u_turn if v == back else w)
                if t > limit:
                    continue
                new = t, along + more, h + 1
                if not inside:
                    if f not in left or new < left[f][:3]:
                        left[f] = *new, to, v, at
                elif f not in done and (f not in best or new < best[f]):
                    best[f] = new
                    heapq.heappush(heap, (*new, f, v, at))
        whole = first and not left
        out += [(src, n, *x, None, None, None, None, 0 if whole else 3 if n in entered else 1) for n, x in done.items()]
        out += [(src, n, *x[:3], limit, *x[3:], 2) for n, x in left.items()]
    columns = list(zip(*out, strict=True)) or [()] * 10
    kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.int32())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _STATE.split(", ")] + ["kind"])


def through_cells(sources: DataFrame, arcs: DataFrame, u_turn: float, group_rows: int = 50_000, group_arcs: int = 100_000, max_rounds: int = 10_000) -> DataFrame:
    """(src, dst, dist_m, along, hops) from ``sources`` (as :data:`_STATE`, one row a source) over ``arcs`` (u, v, w,
    along, cell of u, to: cell of v; a written table), by :func:`_search_cells`.

    A round searches the cells that sources have come into. A group is a batch of cells with about ``group_rows`` entries
    and ``group_arcs`` arcs; a cell with more entries is searched in several groups, each with some of the sources. What
    is found is only added to, and its minima are taken once, at the end; of what leaves a cell, that goes on which is
    better than all that was found there. Sources that never leave their cell need no minima."""
    spark = sources.sparkSession
    folder = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    keep_path(folder)
    schema = _STATE + ", turn int, kind int"
    rank = F.struct("dist_m", "along", "hops")
    total = arcs.count()

    def search(first: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda rows, known: _search_cells(rows, known, u_turn, first)

    front = staged(sources, "front")
    for turn in range(max_rounds):
        size = front.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
        if not size["rows"]:
            break
        parts, batches = -(-size["largest"] // group_rows), max(-(-size["rows"] // group_rows), -(-total // group_arcs))
        batch, part = F.pmod(F.xxhash64("cell"), F.lit(batches)).alias("batch"), F.pmod(F.xxhash64("src"), F.lit(parts)).alias("part")
        rows = front.select("*", batch, part)
        known = arcs.select("*", batch)
        if turn == 0 and parts == 1:
            known = known.withColumn("part", F.lit(0).cast("long"))
        else:
            groups = rows.select(F.col("cell").alias("c"), F.col("part").alias("p")).distinct()
            known = known.join(groups, F.col("cell") == F.col("c")).select(*known.columns, F.col("p").alias("part"))
        found = rows.groupBy("batch", "part").cogroup(known.groupBy("batch", "part")).applyInArrow(search(turn == 0), _STATE + ", kind int")
        found.write.partitionBy("kind").parquet(f"{folder}/turn={turn}")
        drop_staged(front)
        every = spark.read.schema(schema).parquet(folder)
        left = every.where((F.col("turn") == turn) & (F.col("kind") == 2)).groupBy("src", "dst").agg(F.min(F.struct(rank.alias("rank"), "limit_m", "cell", "at", "back")).alias("b"))
        left = left.select("src", "dst", "b.*")
        seen = every.where("kind = 3").groupBy("src", "dst").agg(F.min(rank).alias("known"))
        # Of equal ones the older stays, so that nothing goes around in circles.
        left = left.join(seen, ["src", "dst"], "left").where(F.col("known").isNull() | (F.col("rank") < F.col("known")))
        front = staged(left.select("src", "dst", "rank.*", "limit_m", "cell", "at", "back"), "front")
    else:
        raise RuntimeError("distances did not settle")
    if not turn:
        return staged(sources.limit(0).select("src", "dst", "dist_m", "along", "hops"), "reach")
    every = spark.read.schema(schema).parquet(folder)
    again = every.where("kind in (1, 3)").groupBy("src", "dst").agg(F.min(rank).alias("b")).select("src", "dst", "b.*")
    return every.where("kind = 0").select(*again.columns).unionByName(again)


def with_cells(arcs: DataFrame, cells: DataFrame) -> DataFrame:
    """``arcs`` (u, v, ...) with the cells of both ends, cell and to."""
    return arcs.join(cells.select(F.col("node_id").alias("u"), "cell"), "u").join(cells.select(F.col("node_id").alias("v"), F.col("cell").alias("to")), "v")


def distances(graph: Graph, sources: DataFrame | None = None, radius_m: float | None = None, by_joins: bool | None = None, hops: bool = False) -> DataFrame:
    """(src, dst, dist_m) from each source (node_id; default: every node) to what it reaches within ``radius_m`` (None:
    any distance), itself included. ``sources`` may have a limit of their own, limit_m. ``by_joins``: relax by
    joins; by default, the way follows the graph's size. ``hops``: a column more, the fewest edges of a shortest path."""
    sources = graph.nodes if sources is None else sources
    own = F.max("limit_m") if "limit_m" in sources.columns else F.lit(float("inf"))
    limit = F.least(own, F.lit(float("inf") if radius_m is None else float(radius_m)))
    sources = sources.groupBy("node_id").agg(limit.alias("limit_m"))
    arrays = None if by_joins else arrays_of(graph)
    if arrays is None and not by_joins and not hops:
        return by_cells(graph, sources)
    found = relax(adjacency(graph.edges), sources) if arrays is None else staged(_searched(arrays, sources), "reach")
    return found.select("src", "dst", "dist_m", *(["hops"] if hops else []))


def bounded_reach(graph: Graph, radius_m: float, sources: DataFrame | None = None) -> DataFrame:
    """The nodes within ``radius_m`` of each source (default: every node), itself included."""
    return distances(graph, sources, radius_m)


def coverage_gain(reach: DataFrame, unsatisfied: DataFrame) -> DataFrame:
    """(node_id, gain): how many unsatisfied nodes each source reaches."""
    hit = reach.join(unsatisfied.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return hit.groupBy("src").agg(F.count("*").alias("gain")).withColumnRenamed("src", "node_id")


def nearest_station(nodes: DataFrame, reach: DataFrame, stations: DataFrame) -> DataFrame:
    """(node_id, dist_m): the distance to the nearest station within the reach, else -1."""
    near = reach.join(stations.select(F.col("node_id").alias("src")), "src", "left_semi").groupBy("dst").agg(F.min("dist_m").alias("d"))
    return nodes.select("node_id").join(near.withColumnRenamed("dst", "node_id"), "node_id", "left").select("node_id", F.coalesce("d", F.lit(-1.0)).alias("dist_m"))
