"""Fastest ways over directed roads, and map matching on them.

A road open both ways is two arcs. Routes run from arc to arc, so that a turn can cost something: turning back into
the arc that one comes from. Times decide; the metres of the fastest way come along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import haversine
from roadloom.operators.city import chains, drivable
from roadloom.operators.matching import RoadMatcher, Ways, paths_of
from roadloom.operators.reach import MAX_BROADCAST_EDGES, cells_of, relax, through_cells, with_cells
from roadloom.operators.road_graph import Graph
from roadloom.plans.staging import staged

_ROUTES = "src string, dst string, dist_m double, along double, hops int"
_ROWS = 50_000
#: Cells among which nodes without a place are dealt out.
_NO_PLACE = 1024


@dataclass(frozen=True)
class Roads:
    """nodes (node_id string, lat, lon) and arcs (src, dst, dist_m, time_s; one per ordered pair)."""

    nodes: DataFrame
    arcs: DataFrame


def roads_of(segments: DataFrame) -> Roads:
    """The directed roads of segments (with speed_kmh): an arc for each step of a segment in each direction that is
    open to cars, ferries left out. Of parallel arcs the fastest stays. Segments that repeat an id count once; steps
    from a node to itself go. Empty table: no arcs."""
    kept = drivable(segments.dropDuplicates(["edge_id"]))
    ways = kept.select("edge_id", "car_fwd", "car_bwd", "speed_kmh")
    points = staged(chains(kept), "chains")
    after = points.select("edge_id", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("to"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    steps = points.join(after, ["edge_id", "pos"]).where("node_id <> to").join(ways, "edge_id")
    dist = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    arc = lambda a, b, ok: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(ok).alias("ok"))
    both = steps.select(F.explode(F.array(arc("node_id", "to", "car_fwd"), arc("to", "node_id", "car_bwd"))).alias("x"), dist.alias("dist_m"), (dist / (F.col("speed_kmh") / 3.6)).alias("time_s")).where("x.ok")
    arcs = both.groupBy("x.src", "x.dst").agg(F.min(F.struct("time_s", "dist_m")).alias("b")).select("src", "dst", "b.dist_m", "b.time_s")
    nodes = points.groupBy("node_id").agg(F.min_by(F.struct("lat", "lon"), F.struct("edge_id", "pos")).alias("p")).select("node_id", "p.lat", "p.lon")
    return Roads(staged(nodes, "nodes"), staged(arcs, "arcs"))


def turns(arcs: DataFrame, u_turn_s: float) -> DataFrame:
    """(u, v, w, along): from each arc into each that begins at its end, by their names; w is the time of the second,
    and ``u_turn_s`` more where it leads back."""
    name = F.concat_ws("|", "src", "dst")
    one = arcs.select(name.alias("u"), F.col("src").alias("from"), F.col("dst").alias("at"))
    two = arcs.select(name.alias("v"), F.col("src").alias("at"), F.col("dst").alias("to"), "time_s", F.col("dist_m").alias("along"))
    return one.join(two, "at").select("u", "v", (F.col("time_s") + F.when(F.col("from") == F.col("to"), u_turn_s).otherwise(0.0)).alias("w"), "along")


@dataclass
class Arcs:
    """Directed roads as arrays: arc i leads from a[i] to b[i], and the arcs that begin at node n are numbered from
    starts[n] to starts[n + 1]."""

    names: list[str]
    a: np.ndarray
    b: np.ndarray
    time: np.ndarray
    dist: np.ndarray
    starts: np.ndarray
    u_turn_s: float
    place: dict = field(default_factory=dict)

    @staticmethod
    def of(arcs: DataFrame, u_turn_s: float) -> Arcs:
        t = arcs.select("src", "dst", F.col("time_s").cast("double"), F.col("dist_m").cast("double")).toArrow()
        src, dst = (t.column(i).to_pylist() for i in (0, 1))
        number = {n: i for i, n in enumerate(dict.fromkeys(src + dst))}
        a, b = (np.fromiter((number[x] for x in c), np.int64, len(c)) for c in (src, dst))
        order = np.argsort(a, kind="stable")
        names = [f"{src[i]}|{dst[i]}" for i in order]
        return Arcs(names, a[order], b[order], t.column(2).to_numpy()[order], t.column(3).to_numpy()[order], np.searchsorted(a[order], np.arange(len(number) + 1)), u_turn_s)

    def search(self, start: int, limit: float) -> dict[int, tuple[float, float, int]]:
        """(time, metres, turns) from the end of ``start`` to the end of each arc within ``limit``, over a turn at
        least; of equally fast ways the shortest, then that of the fewest turns."""
        best: dict[int, tuple] = {}
        done: dict[int, tuple] = {}
        heap: list[tuple] = []

        def go(t: float, d: float, h: int, e: int) -> None:
            at, back = self.b[e], self.a[e]
            for f in range(self.starts[at], self.starts[at + 1]):
                new = (t + (self.time[f] + (self.u_turn_s if self.b[f] == back else 0.0)), d + self.dist[f], h + 1)
                if new[0] <= limit and f not in done and (f not in best or new < best[f]):
                    best[f] = new
                    heapq.heappush(heap, (*new, f))

        go(0.0, 0.0, 0, start)
        while heap:
            t, d, h, e = heapq.heappop(heap)
            if e not in done:
                done[e] = (float(t), float(d), h)
                go(t, d, h, e)
        return done


def fastest(roads: Roads, sources: DataFrame, u_turn_s: float = 40.0, by_joins: bool | None = None) -> DataFrame:
    """(src, dst, dist_m, along, hops): from the end of each source (node_id: an arc's name, ``from|to``; limit_s) to
    the end of each arc within its limit, over a turn at least: the seconds of the fastest way in ``dist_m``, its
    metres, and its turns.

    Roads of few enough arcs, which are counted first, go to the tasks as arrays, and each source is searched where it
    is; beyond that, cells of roads are searched in tasks (:func:`fastest_by_cells`). With ``by_joins`` ways are relaxed
    by joins over the table of turns. Sources that are no arcs reach nothing; of sources that repeat, the greatest limit
    counts. Empty tables: no rows.
    """
    if by_joins is None and roads.arcs.limit(MAX_BROADCAST_EDGES + 1).count() > MAX_BROADCAST_EDGES:
        return fastest_by_cells(roads, sources, u_turn_s)
    sources = sources.groupBy("node_id").agg(F.max("limit_s").alias("limit_m"))
    if by_joins:
        return relax(turns(roads.arcs, u_turn_s), sources, from_neighbours=True)
    spark = sources.sparkSession
    shared = spark.sparkContext.broadcast(Arcs.of(roads.arcs, u_turn_s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        if not g.place:
            g.place.update((n, i) for i, n in enumerate(g.names))
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["src", "dst", "dist_m", "along", "hops"])

        for b in batches:
            for name, limit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name in g.place:
                    rows += [(name, g.names[f], *x) for f, x in g.search(g.place[name], limit).items()]
                if len(rows) >= _ROWS:
                    yield batch()
                    rows = []
        yield batch()

    return staged(sources.repartition(spark.sparkContext.defaultParallelism * 4, "node_id").mapInArrow(run, _ROUTES), "ways")


def fastest_by_cells(roads: Roads, sources: DataFrame, u_turn_s: float = 40.0, most_edges: int = 100_000, group_rows: int = 50_000) -> DataFrame:
    """:func:`fastest` for roads of any size: square cells of at most ``most_edges`` ends of arcs are searched in tasks,
    and only ways that cross a border go on to the next round. An arc is where it begins; a way that has come to its end
    goes on in that end's cell. Nodes without a place are dealt out by their ids."""
    graph = Graph(roads.nodes, roads.arcs.select("src", "dst"))
    ends = roads.arcs.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    cells = ends.join(cells_of(graph, most_edges).groupBy("node_id").agg(F.min("cell").alias("cell")), "node_id", "left")
    cells = staged(cells.select("node_id", F.coalesce("cell", F.lit(-1) - F.pmod(F.xxhash64("node_id"), F.lit(_NO_PLACE))).alias("cell")), "cells")
    arcs = staged(with_cells(roads.arcs.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("time_s").cast("double").alias("w"), F.col("dist_m").cast("double").alias("along")), cells), "arcs")
    name = F.concat_ws("|", "u", "v").alias("src")
    limits = sources.groupBy(F.col("node_id").alias("src")).agg(F.max("limit_s").alias("limit_m"))
    zero = arcs.select(name, F.col("to").alias("cell"), F.col("v").alias("at"), F.col("u").alias("back")).join(limits, "src")
    zero = zero.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist_m"), F.lit(0.0).alias("along"), F.lit(0).alias("hops"), F.col("limit_m").cast("double").alias("limit_m"), "cell", "at", "back")
    return through_cells(zero, arcs, u_turn_s, group_rows=group_rows)


@dataclass(frozen=True)
class DirectedMatcher(RoadMatcher):
    """:class:`RoadMatcher` on directed roads: a place is on an arc, and the way to the next place is the fastest one
    in the arcs' directions, with ``u_turn_s`` for each turn back.

    A way may take ``detour`` times what the straight line takes at ``pace_kmh``, and ``slack_s``. Its metres are
    held against the straight line. A step back of up to ``back_m`` along an arc counts as standing still, as points
    are never exact. ``graph`` is made from ``roads``.
    """

    roads: Roads | None = None
    u_turn_s: float = 40.0
    pace_kmh: float = 30.0
    slack_s: float = 120.0
    back_m: float = 20.0
    by_edge: ClassVar[bool] = True

    @staticmethod
    def on(roads: Roads, **settings: float) -> DirectedMatcher:
        return DirectedMatcher(Graph(roads.nodes, roads.arcs.select("src", "dst", "dist_m")), roads=roads, **settings)

    def _placed(self, found: DataFrame) -> DataFrame:
        return found.join(self.roads.arcs.select(F.col("src").alias("a"), F.col("dst").alias("b"), "time_s"), ["a", "b"])

    def _limit(self, line: Column | np.ndarray) -> Column | np.ndarray:
        return line / (self.pace_kmh / 3.6) * self.detour + self.slack_s

    def _routes(self, found: DataFrame) -> DataFrame:
        most = float(self.roads.arcs.agg(F.max("time_s")).first()[0] or 0.0)
        # The search counts the last arc to its end, the first from its end.
        sources = found.where("line is not null").select(F.col("place").alias("node_id"), (self._limit(F.col("line")) + most).alias("limit_s"))
        return fastest(self.roads, sources, self.u_turn_s)

    def _step_costs(self, ways: Ways, c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As in :class:`RoadMatcher`; way: 0 within one arc, else 1."""
        arc, t, size, time, line = c["edge"], c["t"], c["len"], c["time_s"], c["line"][i]
        ahead = t[j] - t[i]
        direct = (arc[i] == arc[j]) & (ahead * size[i] >= -self.back_m)
        on, (found, along) = np.maximum(ahead, 0.0), ways.find(arc[i], arc[j])
        s = np.where(direct, on * time[i], (1 - t[i]) * time[i] + found - (1 - t[j]) * time[j])
        m = np.where(direct, on * size[i], (1 - t[i]) * size[i] + along - (1 - t[j]) * size[j])
        return np.where(s <= self._limit(line), self._rounded(np.abs(m - line) / self.beta_m + 0.5 * (c["off_m"][j] / self.sigma_m) ** 2), np.inf), np.where(direct, 0, 1).astype(np.int32)

    def _ends(self, way: Column, pa_: Column, pb: Column, a: Column, b: Column) -> tuple[Column, Column]:
        return F.when(way == 1, F.concat_ws("|", pa_, pb)), F.when(way == 1, F.concat_ws("|", a, b))

    def _steps(self, found: DataFrame, routes: DataFrame) -> DataFrame:
        here = found.where("line is not null").select("trip_id", "pos", "line", "place", "t", "len", "time_s").withColumnRenamed("place", "p")
        there = found.select("trip_id", (F.col("pos") - 1).alias("pos"), "place", F.col("t").alias("t2"), F.col("len").alias("len2"), F.col("time_s").alias("time2"), "off_m")
        pairs = here.join(there, ["trip_id", "pos"]).join(routes.select(F.col("src").alias("p"), F.col("dst").alias("place"), "dist_m", "along"), ["p", "place"], "left")
        ahead = F.greatest(F.col("t2") - F.col("t"), F.lit(0.0))
        is_direct = (F.col("p") == F.col("place")) & ((F.col("t2") - F.col("t")) * F.col("len") >= -self.back_m)
        direct = F.struct((ahead * F.col("time_s")).alias("s"), (ahead * F.col("len")).alias("m"))
        way = F.struct(((1 - F.col("t")) * F.col("time_s") + F.col("dist_m") - (1 - F.col("t2")) * F.col("time2")).alias("s"), ((1 - F.col("t")) * F.col("len") + F.col("along") - (1 - F.col("t2")) * F.col("len2")).alias("m"))
        rows = pairs.select("*", is_direct.alias("direct"), F.when(is_direct, direct).when(F.col("dist_m").isNotNull(), way).alias("way")).where(F.col("way.s") <= self._limit(F.col("line")))
        cost = F.round(F.abs(F.col("way.m") - F.col("line")) / self.beta_m + self._emission(F.col("off_m")), 6)
        return rows.select("trip_id", (F.col("pos") + 1).cast("int").alias("pos"), "p", "place", cost.alias("cost"), F.when(F.col("direct"), 0).otherwise(1).alias("way"))

    def _inner(self, pairs: DataFrame, routes: DataFrame) -> DataFrame:
        start = pairs.select(F.col("x").alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist_m"), F.lit(0).alias("hops"))
        known = routes.select("src", "dst", "dist_m", "hops").unionByName(start)
        paths = paths_of(turns(self.roads.arcs, self.u_turn_s), known, pairs).where("hops > 0")
        tails = self.roads.arcs.select(F.concat_ws("|", "src", "dst").alias("node"), F.col("src").alias("node_id")).join(self.graph.nodes, "node_id").select("node", "lat", "lon")
        return paths.join(tails, "node").select("x", "y", (F.lit(0) - F.col("back")).alias("k"), "lat", "lon")
