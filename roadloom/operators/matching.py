"""Map matching by a hidden Markov model (Newson and Krumm, 2009) over places on the edges of a road graph."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.geo import METRES_PER_DEGREE, haversine
from roadloom.operators.reach import distances
from roadloom.operators.road_graph import Graph, adjacency
from roadloom.plans.staging import keep_path, shared_dir, staged

#: Routes, or places along them, that go to every task, counted first; beyond it steps are shuffled to them.
MAX_BROADCAST_ROUTES = 2_000_000
#: A point's candidates: where the best path to each comes from, and by which way; ``end`` is where the trip's ends.
_FOLLOWED = "trip_id int, pos int, end int, via array<int>, way array<int>, a array<string>, b array<string>, t array<double>, plat array<double>, plon array<double>"
_CHOSEN = "trip_id int, pos int, a string, b string, t double, lat double, lon double, way int, last boolean"
_BEST = "trip_id int, pos int, place string, via string, total double"


@dataclass(frozen=True)
class RoadMatcher:
    """Matches each point to a place on an edge within ``reach_m``.

    Emission: Gaussian in the distance, ``sigma_m``. Transition: exponential in the difference between the route and
    the straight line, ``beta_m``; routes are shortest paths of up to ``detour`` times the line and ``slack_m``. All
    edges in reach count. The path of highest probability is found trip by trip; a trip with a gap (no edge in reach,
    or no route) fails.
    """

    graph: Graph
    reach_m: float = 50.0
    sigma_m: float = 10.0
    beta_m: float = 50.0
    detour: float = 3.0
    slack_m: float = 1000.0
    #: Whether routes run between edges, by their names, or else between nodes.
    by_edge: ClassVar[bool] = False

    def _row(self, lat: Column) -> Column:
        return F.floor(lat * (METRES_PER_DEGREE / (2 * self.reach_m)))

    def _column(self, lon: Column, row: Column, shift: int = 0) -> Column:
        """The cell of a longitude in a row of cells, which are at least two reaches wide anywhere in the row."""
        step = 2 * self.reach_m / METRES_PER_DEGREE
        top = F.least(F.greatest(F.abs(row), F.abs(row + 1)) * step, F.lit(89.99))
        n = F.greatest(F.floor(F.cos(F.radians(top)) * (360 / step)), F.lit(1))
        return F.pmod(F.floor((lon + 180) * n / 360) + shift, n)

    def _edges(self) -> DataFrame:
        """(a, b, len, alat, alon, dlat, dlon): each edge with its first end and the way to the other."""
        end = lambda k: self.graph.nodes.select(F.col("node_id").alias(k), F.col("lat").alias(f"{k}lat"), F.col("lon").alias(f"{k}lon"))
        rows = self.graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dist_m").alias("len")).join(end("a"), "a").join(end("b"), "b")
        return rows.select("a", "b", "len", "alat", "alon", (F.col("blat") - F.col("alat")).alias("dlat"), (F.pmod(F.col("blon") - F.col("alon") + 540, F.lit(360.0)) - 180).alias("dlon"))

    def candidates_of(self, points: DataFrame) -> DataFrame:
        """(trip_id, pos, a, b, len, t, off_m, plat, plon, and what else ``points`` hold but lat and lon): the nearest
        place of each edge in reach, at the share t of its length.

        An equi-join on cells: edges lie in the cells around points along them, a reach apart. Columns of cells get
        wider towards the poles and meet at 180 degrees.
        """
        more = [c for c in points.columns if c not in ("trip_id", "pos", "lat", "lon")]
        e = self._edges()
        n = F.greatest(F.ceil(F.col("len") / self.reach_m), F.lit(1))
        along = e.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn("f", F.col("i") / n)
        along = along.select("a", "b", self._row(F.col("alat") + F.col("f") * F.col("dlat")).alias("row"), (F.col("alon") + F.col("f") * F.col("dlon")).alias("lon"))
        around = along.withColumn("row", F.explode(F.array(*[F.col("row") + i for i in (-1, 0, 1)])))
        around = around.select("a", "b", "row", F.explode(F.array(*[self._column(F.col("lon"), F.col("row"), i) for i in (-1, 0, 1)])).alias("col")).distinct()
        p = points.select("trip_id", "pos", "lat", "lon", *more, self._row(F.col("lat")).alias("row")).withColumn("col", self._column(F.col("lon"), F.col("row")))
        near = p.join(around, ["row", "col"]).drop("row", "col").join(e, ["a", "b"])
        east = F.cos(F.radians("lat"))
        px, py = (F.pmod(F.col("lon") - F.col("alon") + 540, F.lit(360.0)) - 180) * east, F.col("lat") - F.col("alat")
        ex, ey = F.col("dlon") * east, F.col("dlat")
        square = ex * ex + ey * ey
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * ex + py * ey) / square))).otherwise(0.0)
        # Each step comes from a generator, so that it is computed once, not wherever the next ones use it.
        once = lambda df, *made: df.select("*", F.inline(F.array(F.struct(*made))))
        rows = once(near, t.alias("t"))
        rows = once(rows, (F.col("alat") + F.col("t") * F.col("dlat")).alias("plat"), (F.col("alon") + F.col("t") * F.col("dlon")).alias("plon"))
        rows = once(rows, haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")).alias("off_m")).where(F.col("off_m") <= self.reach_m)
        return rows.select("trip_id", "pos", *more, "a", "b", "len", "t", "off_m", "plat", "plon")

    def _placed(self, found: DataFrame) -> DataFrame:
        """Candidates with what the cost of a step needs."""
        return found

    def _routes(self, found: DataFrame) -> DataFrame:
        """(src, dst, dist_m, hops) between ends of edges, as far as any step from a candidate may go."""
        limits = found.where("line is not null").select(F.explode(F.array("a", "b")).alias("node_id"), (F.col("line") * self.detour + self.slack_m).alias("limit_m"))
        return distances(self.graph, limits.groupBy("node_id").agg(F.max("limit_m").alias("limit_m")), hops=True)

    def _step_costs(self, ways: Ways, c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, way) of steps from the candidates i to j (places in the columns c): the shortest way over an end of the
        one's edge and one of the other's (1: a to a, 2: a to b, 3: b to a, 4: b to b), or within one edge (0). Steps
        without a way cost infinitely much."""
        a, b, t, size = c["a"], c["b"], c["t"], c["len"]
        best, way = np.full(len(i), np.inf), np.zeros(len(i), np.int32)
        leave, enter = ((a, t * size), (b, (1 - t) * size)), ((a, t * size), (b, (1 - t) * size))
        for k, ((x, dx), (y, dy)) in enumerate(((x, y) for x in leave for y in enter), 1):
            m = dx[i] + ways.find(x[i], y[j])[0] + dy[j]
            less = m < best
            best[less], way[less] = m[less], k
        same = (a[i] == a[j]) & (b[i] == b[j])
        best[same], way[same] = (np.abs(t[j] - t[i]) * size[i])[same], 0
        line = c["line"][i]
        return np.where(best <= line * self.detour + self.slack_m, self._rounded(np.abs(best - line) / self.beta_m + 0.5 * (c["off_m"][j] / self.sigma_m) ** 2), np.inf), way

    @staticmethod
    def _rounded(x: np.ndarray) -> np.ndarray:
        """To six digits, halves up."""
        with np.errstate(invalid="ignore"):
            y = x * 1e6
            whole = np.trunc(y)
            return (whole + (y - whole >= 0.5)) / 1e6

    def _ends(self, way: Column, pa_: Column, pb: Column, a: Column, b: Column) -> tuple[Column, Column]:
        """(x, y): between which ends a step's route runs; null within one edge."""
        return F.when(way.isin(1, 2), pa_).when(way.isin(3, 4), pb), F.when(way.isin(1, 3), a).when(way.isin(2, 4), b)

    def _steps(self, found: DataFrame, routes: DataFrame) -> DataFrame:
        """(trip_id, pos, p, place, cost, way) from each place to each of the next point, with routes joined to them."""
        here = found.where("line is not null").select("trip_id", "pos", "line", "a", "b", "place", "t", "len").withColumnRenamed("place", "p")
        there = found.select("trip_id", (F.col("pos") - 1).alias("pos"), F.col("a").alias("a2"), F.col("b").alias("b2"), "place", F.col("t").alias("t2"), F.col("len").alias("len2"), "off_m")
        pairs, side, found_ways = here.join(there, ["trip_id", "pos"]), routes.select("src", "dst", "dist_m"), []
        from_ends = {"a": F.col("t") * F.col("len"), "b": (1 - F.col("t")) * F.col("len")}
        to_ends = {"a2": F.col("t2") * F.col("len2"), "b2": (1 - F.col("t2")) * F.col("len2")}
        for x, dx in from_ends.items():
            for y, dy in to_ends.items():
                d = f"d_{x}_{y}"
                pairs = pairs.join(side.select(F.col("src").alias(x), F.col("dst").alias(y), F.col("dist_m").alias(d)), [x, y], "left")
                found_ways.append(F.when(F.col(d).isNotNull(), F.struct((dx + F.col(d) + dy).alias("m"), F.lit(len(found_ways) + 1).alias("way"))))
        direct = F.struct((F.abs(F.col("t2") - F.col("t")) * F.col("len")).alias("m"), F.lit(0).alias("way"))
        best = pairs.select("trip_id", "pos", "p", "place", "line", "off_m", F.when(F.col("p") == F.col("place"), direct).otherwise(F.least(*found_ways)).alias("way"))
        best = best.where(F.col("way.m") <= F.col("line") * self.detour + self.slack_m)
        cost = F.round(F.abs(F.col("way.m") - F.col("line")) / self.beta_m + self._emission(F.col("off_m")), 6)
        return best.select("trip_id", (F.col("pos") + 1).cast("int").alias("pos"), "p", "place", cost.alias("cost"), F.col("way.way").alias("way"))

    def _emission(self, off: Column) -> Column:
        return 0.5 * F.pow(off / self.sigma_m, 2)

    def _solve(self, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chosen, routes); chosen: (trip_id, pos, a, b, t, lat, lon, way, last) of each point of the matched trips, way
        being that of the step to it.

        Routes that are few enough, which are counted first, go to the tasks as arrays, and a step's cost is found where
        the path is followed, so no table of steps is made; beyond that, steps are joined with their routes."""
        w = W.partitionBy("trip_id").orderBy("pos")
        points = trips.select(F.col("trip_id").cast("int").alias("trip_id"), F.col("pos").cast("int").alias("pos"), "lat", "lon")
        after = {c: F.lead(c).over(w) for c in ("pos", "lat", "lon")}
        points = points.select("*", *[c.alias(f"{k}2") for k, c in after.items()])
        line = F.when(F.col("pos2") == F.col("pos") + 1, haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
        points = staged(points.select("trip_id", "pos", "lat", "lon", line.alias("line"), F.col("pos2").isNull().alias("last")), "points")
        found = staged(self._placed(self.candidates_of(points)).withColumn("place", F.concat_ws("|", "a", "b")), "candidates")
        routes = self._routes(found)
        if few(routes):
            return staged(self._followed(found, Ways.shared(routes)), "chosen"), routes
        steps = staged(self._steps(found, routes), "steps")
        first = found.where("pos = 0").select("trip_id", "pos", F.lit(None).cast("string").alias("p"), "place", F.round(self._emission(F.col("off_m")), 6).alias("cost"))
        rows = first.unionByName(steps.select(*first.columns)).repartition("trip_id").sortWithinPartitions("trip_id", "pos", "place", "p")
        best = staged(rows.mapInArrow(_forward, _BEST), "best")
        # Trips that were followed to their last point, and where they end.
        last = best.join(points.where("last").select("trip_id", "pos"), ["trip_id", "pos"]).groupBy("trip_id").agg(F.min_by("place", F.struct("total", "place")).alias("last"))
        back = best.join(last, "trip_id").select("trip_id", "pos", "place", "via", "last").repartition("trip_id").sortWithinPartitions("trip_id", F.desc("pos"))
        chosen = back.mapInArrow(_backward, "trip_id int, pos int, place string, via string")
        chosen = chosen.join(steps.select("trip_id", "pos", F.col("p").alias("via"), "place", "way"), ["trip_id", "pos", "via", "place"], "left")
        at = found.select("trip_id", "pos", "place", "a", "b", "t", F.col("plat").alias("lat"), F.col("plon").alias("lon"), "last")
        return staged(chosen.join(at, ["trip_id", "pos", "place"]).select(*[f.split()[0] for f in _CHOSEN.split(", ")]), "chosen"), routes

    def _followed(self, found: DataFrame, shared: Broadcast) -> DataFrame:
        """The chosen places, by a fold over the candidates of each trip forward and one back, both in the partition that
        holds the trip, with costs of steps found in the task."""
        rows = found.repartition("trip_id").sortWithinPartitions("trip_id", "pos", "place")
        settings = replace(self, **{k: None for k in ("graph", "roads") if hasattr(self, k)})
        best = rows.mapInArrow(lambda batches: _follow(batches, settings, shared.value), _FOLLOWED)
        return best.sortWithinPartitions("trip_id", F.desc("pos")).mapInArrow(_trace, _CHOSEN)

    def match_points(self, trips: DataFrame) -> DataFrame:
        """(trip_id, pos, a, b, t, lat, lon): where on which edge each point of the matched trips lies; ``trips`` needs
        trip_id, pos (from 0), lat and lon."""
        return self._solve(trips)[0].select("trip_id", "pos", "a", "b", "t", "lat", "lon")

    def _inner(self, pairs: DataFrame, routes: DataFrame) -> DataFrame:
        """(x, y, k, lat, lon): the nodes, in the order of k, of the routes of the pairs (x, y)."""
        paths = paths_of(adjacency(self.graph.edges), routes, pairs)
        return paths.join(self.graph.nodes.select("node_id", "lat", "lon"), F.col("node") == F.col("node_id")).select("x", "y", (F.lit(0) - F.col("back")).alias("k"), "lat", "lon")

    def match_steps(self, trips: DataFrame) -> DataFrame:
        """(trip_id, at, before, line): the geometry along the roads of the matched trips, a row for each point: the
        places (lat, lon) of the way to it, without those equal to the one before, that which comes before them in the
        trip, if any does, and how many do. A route's places are put together once for all steps that take it."""
        chosen, routes = self._solve(trips)
        w = W.partitionBy("trip_id").orderBy("pos")
        spot = F.struct("lat", "lon")
        x, y = self._ends(F.col("way"), F.lag("a").over(w), F.lag("b").over(w), F.col("a"), F.col("b"))
        steps = chosen.select("trip_id", "pos", spot.alias("spot"), "last", x.alias("x"), y.alias("y"))
        taken = staged(steps.where("x is not null").select("x", "y").distinct(), "taken")
        inner = staged(self._inner(taken, routes), "inner")
        places = F.transform(F.array_sort(F.collect_list(F.struct("k", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
        paths = staged(inner.groupBy("x", "y").agg(places.alias("inner")), "paths")
        steps = steps.join(F.broadcast(paths) if few(inner) else paths, ["x", "y"], "left")
        none = F.array().cast("array<struct<lat: double, lon: double>>")
        own = F.when(F.col("pos") == 0, F.array("spot")).otherwise(F.concat(F.coalesce("inner", none), F.when(F.col("last"), F.array("spot")).otherwise(none)))
        rows = steps.select("trip_id", "pos", own.alias("all"))
        rows = rows.select("trip_id", "pos", "all", F.last(F.try_element_at("all", F.lit(-1)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"))
        new = F.filter("all", lambda p, i: F.coalesce(p != F.when(i == 0, F.col("before")).otherwise(F.get("all", i - 1)), F.lit(True)))
        rows = rows.select("trip_id", "pos", "before", new.alias("line"))
        at = F.coalesce(F.sum(F.size("line")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return rows.select("trip_id", at.alias("at"), "before", "line")

    def match(self, trips: DataFrame) -> DataFrame:
        """(trip_id, pos, lat, lon) along the roads of the matched trips: the first point's place, all nodes of the
        routes between, and the last point's place."""
        rows = self.match_steps(trips).select("trip_id", "at", F.posexplode("line").alias("k", "p"))
        return rows.select("trip_id", (F.col("at") + F.col("k")).cast("int").alias("pos"), "p.lat", "p.lon")


@dataclass
class Ways:
    """Routes as arrays: from node i to j, keys[k] = i * n + j has dist[k] and, of directed ways, along[k]."""

    names: list[str]
    keys: np.ndarray
    dist: np.ndarray
    along: np.ndarray
    place: dict = field(default_factory=dict)

    @staticmethod
    def shared(routes: DataFrame) -> Broadcast:
        more = "along" if "along" in routes.columns else F.lit(0.0)
        t = routes.select("src", "dst", F.col("dist_m").cast("double"), more).toArrow()
        src, dst = (t.column(i).to_pylist() for i in (0, 1))
        number = {n: i for i, n in enumerate(dict.fromkeys(src + dst))}
        a, b = (np.fromiter((number[x] for x in c), np.int64, len(c)) for c in (src, dst))
        order = np.argsort(a * len(number) + b)
        return routes.sparkSession.sparkContext.broadcast(Ways(list(number), (a * len(number) + b)[order], t.column(2).to_numpy()[order], t.column(3).to_numpy()[order]))

    def numbers(self, nodes: list[str]) -> np.ndarray:
        """The numbers of nodes. Those of no route get negative ones, a number for each name."""
        if not self.place:
            self.place.update((n, i) for i, n in enumerate(self.names))
        get, other = self.place.get, {}
        out = np.array([get(n, -1) for n in nodes], np.int64)
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = other.setdefault(nodes[i], -1 - len(other))
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dist, along) from each of a to each of b; without a route, infinity."""
        if not len(self.keys):
            return np.full(len(a), np.inf), np.full(len(a), np.inf)
        key = np.where((a < 0) | (b < 0), -1, a * len(self.names) + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.dist[at], np.inf), np.where(known, self.along[at], np.inf)


def few(rows: DataFrame) -> bool:
    """Whether they may go to every task."""
    return rows.limit(MAX_BROADCAST_ROUTES + 1).count() <= MAX_BROADCAST_ROUTES


_NUMBERS = ("line", "len", "t", "off_m", "time_s")


def _follow(batches: Iterator[pa.RecordBatch], matcher: RoadMatcher, ways: Ways) -> Iterator[pa.RecordBatch]:
    """Rows as :data:`_FOLLOWED`, a point each, from candidates in the order of trip, position and place: where the best
    path to each candidate comes from, and at a trip's last point, where the best path ends (else -1). A trip ends at its
    first gap. A batch's candidates are in memory at a time, with those of the point before."""
    rest: pa.Table | None = None
    old: tuple | None = None  # trip, position and totals of the last point that was followed
    for table, more in _with_end(batches):
        rows = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not rows.num_rows:
            continue
        trip, pos = (rows.column(k).to_numpy() for k in ("trip_id", "pos"))
        starts = np.flatnonzero(np.concatenate([[True], (trip[1:] != trip[:-1]) | (pos[1:] != pos[:-1])]))
        sizes = np.diff(np.append(starts, len(trip)))
        done = len(starts) - 1 if more else len(starts)  # the last point may go on in the next batch
        known = 1 if old is not None else 0
        if done > known:
            yield from _points(rows, trip[starts], pos[starts], starts, sizes, known, done, old, matcher, ways, keep := [])
            old = keep[0]
        rest = rows.slice(starts[done - 1]) if done else rows


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Each batch with whether it isn't the end, and at the end an empty table."""
    table = None
    for b in batches:
        table = pa.Table.from_batches([b])
        yield table, True
    if table is not None:
        yield table.slice(0, 0), False


def _points(rows: pa.Table, trip: np.ndarray, pos: np.ndarray, starts: np.ndarray, sizes: np.ndarray, known: int, done: int, old: tuple | None, matcher: RoadMatcher, ways: Ways, keep: list) -> Iterator[pa.RecordBatch]:
    """The points from ``known`` to ``done`` of ``rows`` followed, as :func:`_follow` says; the last one's state goes to
    ``keep``."""
    c = {k: rows.column(k).to_numpy(zero_copy_only=False) for k in _NUMBERS if k in rows.column_names}
    if matcher.by_edge:
        c["edge"] = ways.numbers(rows.column("place").to_pylist())
    else:
        c["a"], c["b"] = np.split(ways.numbers(rows.column("a").to_pylist() + rows.column("b").to_pylist()), 2)
    lasts = rows.column("last").to_numpy(zero_copy_only=False)[starts]
    linked = np.concatenate([[False], (trip[1:] == trip[:-1]) & (pos[1:] == pos[:-1] + 1)])[:done]
    to = np.flatnonzero(linked)
    wide = sizes[to]
    counts = sizes[to - 1] * wide
    first = np.concatenate([[0], np.cumsum(counts)])
    local = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    wide_of = np.repeat(wide, counts)
    cost, way = matcher._step_costs(ways, c, np.repeat(starts[to - 1], counts) + local // wide_of, np.repeat(starts[to], counts) + local % wide_of)
    begin = matcher._rounded(0.5 * (c["off_m"] / matcher.sigma_m) ** 2)
    links = dict(zip(to.tolist(), first[:-1].tolist(), strict=True))
    low, high = starts[known], starts[done - 1] + sizes[done - 1]
    via, sums, end = np.full(high, -1, np.int32), np.full(high, np.inf), np.full(done - known, -1, np.int32)
    totals = old[2] if known else None
    for k, (at, n, p, follows, last) in enumerate(zip(*(x[known:done].tolist() for x in (starts, sizes, pos, linked, lasts)), strict=True), known):
        if follows:
            f, m = links[k], len(totals)
            step = cost[f : f + m * n].reshape(m, n) + totals[:, None]
            via[at : at + n] = step.argmin(0)
            totals = step.min(0)
        else:
            totals = begin[at : at + n] if p == 0 else np.full(n, np.inf)
        sums[at : at + n] = totals
        if last and totals.min() < np.inf:
            end[k - known] = totals.argmin()
    keep.append((trip[done - 1], pos[done - 1], totals))
    took, of = np.zeros(high, np.int32), np.repeat(np.arange(done), sizes[:done])
    come = np.flatnonzero(via >= 0)
    firsts, at = np.zeros(done, np.int64), of[come]
    firsts[to] = first[:-1]
    took[come] = way[firsts[at] + via[come] * sizes[at] + come - starts[at]]
    via, took = np.where(np.isinf(sums), -1, via)[low:].astype(np.int32), took[low:]
    alive = np.minimum.reduceat(sums, starts[:done])[known:] < np.inf
    offsets = pa.array(np.append(starts[known:done], high) - low, pa.int32())
    part = rows.slice(low, high - low).combine_chunks()
    flat = lambda name: part.column(name).chunk(0) if part.column(name).num_chunks else pa.array([], part.column(name).type)
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(via), pa.array(took), *(flat(k) for k in ("a", "b", "t", "plat", "plon")))]
    out = pa.RecordBatch.from_arrays([pa.array(trip[known:done], pa.int32()), pa.array(pos[known:done], pa.int32()), pa.array(end), *lists], names=[f.split()[0] for f in _FOLLOWED.split(", ")])
    yield out.filter(pa.array(alive))


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen places, from rows as :data:`_FOLLOWED` of each trip from its end on."""
    trip, want = object(), -1
    for batch in batches:
        lists = {k: batch.column(k) for k in ("via", "way", "a", "b", "t", "plat", "plon")}
        values = {k: x.flatten() for k, x in lists.items()}
        via, take, kept, lasts = values["via"].to_pylist(), [], [], []
        at = 0
        sizes = pc.list_value_length(lists["via"]).to_pylist()
        for i, (t, end, n) in enumerate(zip(batch.column("trip_id").to_pylist(), batch.column("end").to_pylist(), sizes, strict=True)):
            last = t != trip
            if last:
                trip, want = t, end
            if want >= 0:
                kept.append(i)
                take.append(at + want)
                lasts.append(last)
                want = via[at + want]
            at += n
        ids = batch.take(pa.array(kept, pa.int64()))
        chosen = [values[k].take(pa.array(take, pa.int64())) for k in ("a", "b", "t", "plat", "plon", "way")]
        yield pa.RecordBatch.from_arrays([ids.column("trip_id"), ids.column("pos"), *chosen, pa.array(lasts, pa.bool_())], names=[f.split()[0] for f in _CHOSEN.split(", ")])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least total cost of each place, from rows (trip_id, pos, p, place, cost) in order; one point's places are in
    memory at a time. A trip ends at its first gap."""
    trip, pos, alive, best, new = object(), -1, False, {}, {}
    out: list[tuple] = []

    def close() -> None:
        nonlocal best, new, alive
        alive = alive and bool(new)
        if alive:
            out.extend((trip, pos, b, via, total) for b, (total, via) in new.items())
        best, new = new, {}

    for batch in batches:
        for t, at, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if t != trip or at != pos:
                close()
                if t != trip:
                    trip, alive, best = t, at == 0, {}
                else:
                    alive = alive and at == pos + 1
                pos = at
            if alive and (a is None or a in best):
                total = c if a is None else best[a][0] + c
                if b not in new or (total, a or "") < (new[b][0], new[b][1] or ""):
                    new[b] = (total, a)
        if len(out) > 10_000:
            yield _batch(out)
            out = []
    close()
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("trip_id", pa.int32()), ("pos", pa.int32()), ("place", pa.string()), ("via", pa.string()), ("total", pa.float64()))
    width = len(rows[0]) if rows else 5
    columns = list(zip(*rows, strict=True)) or [()] * width
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=False)], names=[n for n, _ in kinds[: len(columns)]])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen places, from rows (trip_id, pos, place, via, last) of each trip from its end on."""
    trip, want, next_pos = object(), None, -1
    for batch in batches:
        out: list[tuple] = []
        for t, at, b, via, last in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if t != trip:
                trip, want, next_pos = t, last, at
            if at == next_pos and b == want:
                out.append((t, at, b, via))
                want, next_pos = via, at - 1
        if out:
            yield _batch(out)


def paths_of(adj: DataFrame, routes: DataFrame, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(x, y, back, node, hops): the nodes of a shortest path over ``adj`` (u, v, w) for each pair (x, y; distinct),
    counted back from y. ``routes`` (src, dst, dist_m, hops) has the distances from each x.

    All paths are followed back at once, a node a round: the one before is a neighbour from which the distance adds up
    and that is nearer to x, or as near by fewer edges, as over edges of length 0 (of several, the least id). A path
    ends where it has no edge left. Rounds are written to one table.
    """
    adj = staged(adj.select("u", "v", "w"), "adjacency")
    from_x = routes.select(F.col("src").alias("x"), F.col("dst").alias("node"), F.col("dist_m").alias("d"), "hops")
    last = F.struct("hops", "d")
    start = pairs.select("x", "y", F.col("y").alias("node")).join(from_x, ["x", "node"])
    # A pair that has a way around from x to itself begins at its end.
    now = start.groupBy("x", "y").agg(F.max(last).alias("b")).select("x", "y", F.lit(0).alias("back"), F.col("y").alias("node"), "b.d", "b.hops")
    folder = f"{shared_dir(adj.sparkSession)}/paths-{uuid.uuid4().hex}"
    keep_path(folder)
    schema = now.schema
    for turn in range(max_rounds):
        part = f"{folder}/turn={turn}"
        now.write.parquet(part)
        now = adj.sparkSession.read.schema(schema).parquet(part)
        far = now.where("hops > 0").select("x", "y", F.col("node").alias("v"), F.col("d").alias("dv"), F.col("hops").alias("hv"))
        if far.isEmpty():
            return adj.sparkSession.read.schema(schema).parquet(folder).select("x", "y", "back", "node", "hops")
        before = far.join(adj, "v").join(from_x.withColumnRenamed("node", "u"), ["x", "u"])
        before = before.where((F.col("d") + F.col("w") == F.col("dv")) & ((F.col("d") < F.col("dv")) | (F.col("hops") < F.col("hv"))))
        new = before.groupBy("x", "y").agg(F.min(F.struct(F.col("u").alias("node"), "d", "hops")).alias("b"))
        now = new.select("x", "y", F.lit(turn + 1).alias("back"), "b.node", "b.d", "b.hops")
    raise RuntimeError("a path did not end")
