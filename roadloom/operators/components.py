"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.plans.staging import drop_staged, shuffled, staged_with

#: Edges up to which Spark may broadcast a side of a step's join; they are counted as they are written.
MOST_BROADCAST = 100_000


def _large_star(edges: DataFrame, many: bool = False) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(shuffled(low) if many else low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame, many: bool = False) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(shuffled(low) if many else low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _print() -> dict:
    """What tells two tables of edges apart, as they are written."""
    return {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v"))}


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every endpoint of ``edges`` with the smallest node reachable from it.

    Returns ``(node, component)``. Nodes without an edge don't appear; self-loops and null endpoints are ignored,
    repeated and reversed edges count once. No neighbour list is gathered: each step is a partial minimum and an
    equi-join, so a hub only makes a hot join key, which adaptive execution splits. Rounds grow with the logarithm
    of the size; each is written to the shared folder. More than :data:`MOST_BROADCAST` edges are never broadcast.
    """
    a, b = F.col(src), F.col(dst)
    first = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, seen = staged_with(first.distinct(), "cc", **_print())
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        many = seen["n"] > MOST_BROADCAST
        new, got = staged_with(_small_star(_large_star(now, many), many), "cc", **_print())
        drop_staged(now)
        now, last, seen = new, seen, got
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
