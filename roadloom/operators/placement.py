"""Facility placement: every node within the radius of at least k stations, with few stations.

The three strategies work on the written reach table (src, dst, dist_m), which is symmetric, and in parallel: in one
round, every candidate is chosen that comes before all candidates with which it shares an open node. None of these
choices can change another, so the rounds choose what choosing one after the other would.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.operators.reach import bounded_reach, nearest_station
from roadloom.operators.road_graph import Graph
from roadloom.plans.config import PlacementRequest
from roadloom.plans.order import ranked
from roadloom.plans.staging import drop_staged, staged, staged_with

_MAX_ROUNDS = 10_000
#: Rounds of removal in one written step.
_ROUNDS_A_STEP = 4


@dataclass(frozen=True)
class Placement:
    """stations (node_id, lat, lon, rank), coverage (node_id, dist_m: -1 if none is in reach), objective: their
    number, total_nodes, and the milliseconds that it took."""

    stations: DataFrame
    coverage: DataFrame
    objective: int
    total_nodes: int
    ms: int


def _coverage(reach: DataFrame, chosen: DataFrame) -> DataFrame:
    """(run, node, n): by how many of a run's stations each node is covered."""
    hit = chosen.select("run", F.col("node").alias("src")).join(reach, "src")
    return hit.groupBy("run", F.col("dst").alias("node")).agg(F.count("*").alias("n"))


def _first_at_all(at: DataFrame, row: list[str]) -> DataFrame:
    """The rows (``row``: their columns beside run) that come first, by ``key``, at every spot that they touch.

    ``at``: (run, ``row``, spot, key). No two of them share a spot, so they can all be taken at once."""
    firsts = at.groupBy("run", "spot").agg(F.min("key").alias("first"))
    beaten = at.join(firsts, ["run", "spot"]).groupBy("run", *row).agg(F.max(F.col("key") != F.col("first")).alias("beaten"))
    return beaten.where(~F.col("beaten")).select("run", *row)


def _leaders(rows: DataFrame, reach: DataFrame, open_nodes: DataFrame, order: list) -> DataFrame:
    """The rows (run, node, ...) that come first, by ``order`` (columns; least first), among the rows that share an
    open node with them: a row leads if it is the first at every open node that it reaches."""
    at = rows.withColumn("key", F.struct(*order, "node")).join(reach.select(F.col("src").alias("node"), F.col("dst").alias("spot")), "node")
    at = at.join(open_nodes.select("run", F.col("node").alias("spot")), ["run", "spot"], "left_semi")
    return rows.join(_first_at_all(at, ["node"]), ["run", "node"], "left_semi")


def _turn(*parts: object) -> object:
    """A place in a random order that follows from ``parts`` (columns or values): an MD5 digest."""
    return F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else F.lit(str(p)) for p in parts]))


def greedy(reach: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node_id, rank): again and again the open node that reaches most open nodes (ties: least id); open nodes are
    those covered fewer than k times, and a station is no candidate any more.

    Gains only fall, so a leader would be chosen before anything that it shares open nodes with. A node whose
    neighbours are all covered may stay open at the end, as candidates are open nodes only."""
    runs = nodes.select(F.lit(0).alias("run"), F.col("node_id").alias("node"))

    def pick(gains: DataFrame, turn: int) -> tuple[DataFrame, list]:
        return gains.withColumn("low", -F.col("g")), ["low"]

    return _in_turn(_construct(reach, runs, k, True, pick), F.desc("gain"), "node")


def _in_turn(rows: DataFrame, *order: object) -> DataFrame:
    """(node_id, rank): ranks from 1 in ``order``."""
    return ranked(rows, *order, out="at").select(F.col("node").alias("node_id"), (F.col("at") + 1).cast("int").alias("rank"))


def _construct(reach: DataFrame, nodes: DataFrame, k: int, only_open: bool, pick: Callable[[DataFrame, int], tuple[DataFrame, list]]) -> DataFrame:
    """(run, node, gain): stations of each run by rounds of leaders.

    ``pick`` gets the candidates (run, node, g: open nodes in reach) and the round, and returns those that may be
    chosen with the columns of their order. Gains are kept with the nodes: after a round, each loses what its reach
    holds of the nodes that were just settled, so a round's joins follow what changed. Pairs that lead to nodes settled
    in every run are dropped whenever the open nodes have halved."""
    reach = staged(reach.select("src", "dst"), "pairs")
    first = nodes.join(reach.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("g")), "node", "left")
    state = staged(first.select("run", "node", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("gain"), F.coalesce("g", F.lit(0)).alias("g")), "state")
    still = None
    for turn in range(_MAX_ROUNDS):
        todo = state.where(F.col("n") < k).select("run", "node")
        gains = state.where(F.col("gain").isNull() & (F.col("g") > 0) & (F.col("n") < k if only_open else F.lit(True))).select("run", "node", "g")
        may, order = pick(gains, turn)
        lead, seen = staged_with(_leaders(may, reach, todo, order).select("run", "node", F.col("g").alias("won")), "leaders", n=F.count(F.lit(1)))
        if not seen["n"]:
            drop_staged(lead)
            break
        more = _coverage(reach, lead).withColumnRenamed("n", "m").join(state.select("run", "node", "n"), ["run", "node"])
        more = staged(more.select("run", "node", "m", ((F.col("n") < k) & (F.col("n") + F.col("m") >= k)).alias("settled")), "covered")
        lost = more.where("settled").select("run", F.col("node").alias("dst")).join(reach, "dst").groupBy("run", F.col("src").alias("node")).agg(F.count("*").alias("lost"))
        new = state.join(more.drop("settled"), ["run", "node"], "left").join(lead, ["run", "node"], "left").join(lost, ["run", "node"], "left")
        new = new.select("run", "node", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.coalesce("gain", "won").alias("gain"), (F.col("g") - F.coalesce("lost", F.lit(0))).alias("g"))
        new, seen = staged_with(new, "state", open=F.count_if(F.col("n") < k))
        for old in (state, lead, more):
            drop_staged(old)
        state = new
        if still is None or seen["open"] * 2 <= still:
            if still is not None:
                fewer = staged(reach.join(state.where(F.col("n") < k).select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "pairs")
                drop_staged(reach)
                reach = fewer
            still = seen["open"]
    return state.where(F.col("gain").isNotNull()).select("run", "node", "gain")


def restricted(gains: DataFrame, alpha: float, budget: int, turn: int, seed: int) -> DataFrame:
    """The restricted candidate list of each run: of ``gains`` (run, node, g), those with a gain of at least
    ceil(most - alpha * (most - least)), and ``turn_key``, a random order for uniform picks.

    Of more than ``budget`` candidates, that many are evaluated, those of the least draws. They aren't sorted: counts
    by the draws' first three digits, at most 4,096 a run, tell at which digits the budget is used up, and only the
    candidates with those digits are put in order.
    """
    draw = _turn("node", "run", seed, turn)
    drawn = gains.select("run", "node", "g", _turn("run", "node", turn, seed).alias("turn_key"), draw.alias("draw"), F.substring(draw, 1, 3).alias("digits"))
    counts = drawn.groupBy("run", "digits").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("run").orderBy("digits").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("run", "digits", "n", before.alias("before")).where(F.col("before") < budget)
    drawn = drawn.join(F.broadcast(counts), ["run", "digits"])
    whole = F.col("before") + F.col("n") <= budget
    place = F.row_number().over(W.partitionBy("run").orderBy("draw", "node"))
    last = drawn.where(~whole).withColumn("place", place).where(F.col("place") <= budget - F.col("before")).drop("place")
    kept = drawn.where(whole).unionByName(last)
    span = kept.groupBy("run").agg(F.max("g").alias("most"), F.min("g").alias("least"))
    least = F.ceil(F.round(F.col("most") - alpha * (F.col("most") - F.col("least")), 9))
    return kept.join(F.broadcast(span), "run").where(F.col("g") >= least).select("run", "node", "g", "turn_key")


def random_runs(reach: DataFrame, nodes: DataFrame, k: int, iterations: int, seed: int = 0) -> DataFrame:
    """(run, node, turn): in each run, nodes in a random order of their own; one becomes a station if it is covered
    fewer than k times by then. That is the same as drawing open nodes one by one.

    A node is decided once all nodes within its reach that come earlier are; all runs advance in the same rounds.
    """
    reach = staged(reach.select("src", "dst"), "pairs")
    every = nodes.select(F.col("node_id").alias("node")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    order = F.struct(_turn("run", "node", seed).alias("h"), "node")
    state = staged(every.select("run", "node", order.alias("turn"), F.lit(None).cast("boolean").alias("station")), "state")
    pairs = reach.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other"))
    for _ in range(_MAX_ROUNDS):
        open_rows = state.where("station is null").select("run", "node", "turn")
        near = open_rows.join(pairs, "node").join(state.select("run", F.col("node").alias("other"), F.col("turn").alias("t2"), F.col("station").alias("s2")), ["run", "other"])
        seen = near.where("t2 < turn").groupBy("run", "node").agg(F.count_if(F.col("s2").isNull()).alias("waits"), F.count_if("s2").alias("n"))
        rows = open_rows.join(seen, ["run", "node"], "left").select("run", "node", F.coalesce("waits", F.lit(0)).alias("waits"), F.coalesce("n", F.lit(0)).alias("n"))
        # Enough stations before it settle a node early; otherwise all before it must be decided.
        ready = rows.where((F.col("n") >= k) | (F.col("waits") == 0)).select("run", "node", (F.col("n") < k).alias("s"))
        decided, seen = staged_with(ready, "decided", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        new = staged(state.join(decided, ["run", "node"], "left").select("run", "node", "turn", F.coalesce("station", "s").alias("station")), "state")
        drop_staged(state)
        drop_staged(decided)
        state = new
    return state.where("station").select("run", "node", "turn")


def remove_redundant(reach: DataFrame, stations: DataFrame, k: int) -> DataFrame:
    """Without stations all of whose nodes are covered more than k times, until there is none; of redundant stations
    that share a node, the least id goes first.

    So a station goes if each of its nodes is covered more than k times once the stations of lesser ids that go have
    gone. That is settled as soon as it holds even if all undecided ones of lesser ids go, or doesn't hold even if none
    does. ``left``: by how many a node is covered for a station, without lesser ones that went; a written step makes
    several such rounds, each of which looks at the nodes' stations and the stations' nodes once."""
    now = staged(stations.select("run", "node"), "stations")
    spot, node = W.partitionBy("run", "spot"), W.partitionBy("run", "node")
    lesser = spot.orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    count = lambda c: F.count_if(c).over(lesser)
    went, open_ = F.coalesce("gone", F.lit(False)), F.col("gone").isNull()
    rows = now.join(reach.select(F.col("src").alias("node"), F.col("dst").alias("spot")), "node")
    first = F.col("spot") == F.min("spot").over(node)
    rows = rows.select("run", "node", "spot", F.count("*").over(spot).alias("left"), first.alias("first"), F.lit(None).cast("boolean").alias("gone"))
    old, out = None, rows.limit(0)
    for _ in range(_MAX_ROUNDS):
        for _ in range(_ROUNDS_A_STEP):
            rows = rows.withColumn("most", F.col("left") - count(went)).withColumn("least", F.col("most") - count(open_))
            goes = F.when(F.min("least").over(node) > k, True).when(F.min("most").over(node) <= k, False)
            rows = rows.select("run", "node", "spot", "left", "first", F.coalesce("gone", goes).alias("gone"))
        rows = rows.withColumn("left", F.col("left") - count(went)).where(open_ | (F.col("gone") & F.col("first")))
        step, seen = staged_with(rows.unionByName(out), "pairs", open=F.count_if(open_))
        if old is not None:
            drop_staged(old)
        rows, out, old = step.where(open_), step.where("gone"), step
        if not seen["open"]:
            left = staged(now.join(out.select("run", "node"), ["run", "node"], "left_anti"), "stations")
            drop_staged(now)
            drop_staged(old)
            return left
    raise RuntimeError("removal did not settle")


def swap_round(reach: DataFrame, stations: DataFrame, k: int) -> DataFrame:
    """(run, out, into): swaps of a station with a node in its reach, each of which leaves every node as covered as it
    must be and makes another station redundant. Of those that touch a node in common, the least by (into, out,
    other) is taken, so all of a run's swaps can be made at once.

    ``into`` must reach all nodes that keep the other station, whose own coverage is exactly k, from being redundant;
    nodes that only ``out`` reaches must be covered more than k times, and more than k + 1 times where the other
    station reaches them too.
    """
    r = reach.select("src", "dst")
    cover = staged(_coverage(r, stations), "cover")
    spots = staged(stations.join(r.select(F.col("src").alias("node"), F.col("dst").alias("spot")), "node").join(cover.select("run", F.col("node").alias("spot"), "n"), ["run", "spot"]), "spots")
    tight = spots.where(F.col("n") <= k).select("run", F.col("node").alias("other"), "spot")
    # A node covered fewer than k times would still hold the other station after one more.
    need = spots.where(F.col("n") <= k).groupBy("run", F.col("node").alias("other")).agg(F.count("*").alias("need"), F.min("n").alias("least")).where(F.col("least") == k)
    helps = tight.join(r.select(F.col("src").alias("into"), F.col("dst").alias("spot")), "spot").groupBy("run", "other", "into").agg(F.count("*").alias("has"))
    helps = helps.join(need, ["run", "other"]).where("has = need").select("run", "other", "into")
    helps = helps.join(stations.select("run", F.col("node").alias("into")), ["run", "into"], "left_anti")
    outs = r.select(F.col("src").alias("into"), F.col("dst").alias("out")).join(stations.select("run", F.col("node").alias("out")), "out")
    tries = staged(helps.join(outs, ["run", "into"]).where("out <> other").select("run", "other", "into", "out"), "tries")
    lost = tries.join(spots.select("run", F.col("node").alias("out"), "spot", "n"), ["run", "out"])
    lost = lost.join(r.select(F.col("src").alias("into"), F.col("dst").alias("spot"), F.lit(True).alias("kept")), ["into", "spot"], "left")
    lost = lost.join(r.select(F.col("src").alias("other"), F.col("dst").alias("spot"), F.lit(True).alias("shared")), ["other", "spot"], "left")
    kept, shared = F.coalesce("kept", F.lit(False)), F.coalesce("shared", F.lit(False))
    # A node that both reach stays as covered as it is: it must not be one that the other station waits for.
    bad = (~kept & (F.col("n") <= k)) | (~kept & shared & (F.col("n") <= k + 1)) | (kept & shared & (F.col("n") <= k))
    wrong = lost.groupBy("run", "other", "into", "out").agg(F.max(bad).alias("bad"))
    good = staged(wrong.where(~F.col("bad")).select("run", "into", "out", "other"), "good")
    touched = good.select("*", F.explode(F.array("into", "out", "other")).alias("src"), F.struct("into", "out", "other").alias("key"))
    at = touched.join(r, "src").select("run", "into", "out", "other", F.col("dst").alias("spot"), "key").distinct()
    return _first_at_all(at, ["into", "out", "other"]).select("run", "out", "into")


def grasp_runs(reach: DataFrame, nodes: DataFrame, k: int, iterations: int, alpha: float, seed: int = 0, budget: int = 500) -> DataFrame:
    """(run, node): in each run, a construction from restricted candidate lists, then removal of redundant stations,
    then swaps that free a station until there is none. Candidates are all nodes that aren't stations.

    In a round, of the candidates on the list that share an open node, the first in a random order is chosen.
    """
    every = nodes.select(F.col("node_id").alias("node")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))

    def pick(gains: DataFrame, turn: int) -> tuple[DataFrame, list]:
        return restricted(gains, alpha, budget, turn, seed), ["turn_key"]

    now = remove_redundant(reach, _construct(reach, every, k, False, pick), k)
    for _ in range(_MAX_ROUNDS):
        swaps = staged(swap_round(reach, now, k), "swaps")
        if swaps.isEmpty():
            return now
        moved = now.join(swaps.select("run", F.col("out").alias("node")), ["run", "node"], "left_anti").unionByName(swaps.select("run", F.col("into").alias("node")))
        now = remove_redundant(reach, staged(moved, "swapped"), k)
    raise RuntimeError("swaps did not settle")


def best_run(runs: DataFrame) -> DataFrame:
    """The stations of the run with the fewest, the first of equals."""
    sizes = runs.groupBy("run").agg(F.count("*").alias("size"))
    best = sizes.orderBy("size", "run").limit(1).select("run")
    return runs.join(F.broadcast(best), "run", "left_semi")


def place(graph: Graph, request: PlacementRequest, reach: DataFrame | None = None) -> Placement:
    """Stations by the request's strategy, and each node's distance to the nearest."""
    began = time.monotonic()
    nodes = graph.nodes
    total = nodes.count()
    reach = staged(bounded_reach(graph, request.max_radius_m), "reach") if reach is None else reach
    r = request
    if r.algorithm == "GREEDY":
        chosen = greedy(reach, nodes, r.k)
    else:
        runs = random_runs(reach, nodes, r.k, r.iterations, r.seed) if r.algorithm == "RANDOM" else grasp_runs(reach, nodes, r.k, r.iterations, r.grasp_alpha, r.seed, r.grasp_eval_budget)
        order = ["turn"] if r.algorithm == "RANDOM" else ["node"]
        chosen = _in_turn(best_run(runs), *order)
    stations = staged(chosen.join(nodes.select("node_id", "lat", "lon"), "node_id").select("node_id", "lat", "lon", "rank"), "stations")
    coverage = nearest_station(nodes, reach, stations)
    return Placement(stations, coverage, stations.count(), total, int((time.monotonic() - began) * 1000))


def under_covered(reach: DataFrame, nodes: DataFrame, stations: DataFrame, k: int) -> DataFrame:
    """(node_id, n): the nodes within reach of fewer than k stations."""
    hit = reach.join(stations.select(F.col("node_id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(hit, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
