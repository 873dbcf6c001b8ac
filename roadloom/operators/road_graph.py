"""Road graphs as two DataFrames, built from trips by merging nodes within cells."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions import hexagons
from roadloom.functions.geo import grid_cell, haversine
from roadloom.operators.trips import clean_trips, in_order, numbered
from roadloom.plans.config import DEFAULTS, PipelineConfig

NODES = "node_id string, lat double, lon double, off_road boolean, first_seen timestamp, last_seen timestamp"
EDGES = "src string, dst string, dist_m double"


@dataclass(frozen=True)
class Graph:
    """nodes (:data:`NODES`) and undirected edges (:data:`EDGES`; src < dst, one per pair)."""

    nodes: DataFrame
    edges: DataFrame


class Matcher(Protocol):
    def match(self, trips: DataFrame) -> DataFrame:
        """(trip_id, pos, lat, lon) of the trips that could be matched to roads."""


def canonical_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge per unordered pair, the first by ``order`` (else the shortest); self-loops are dropped."""
    both = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "dist_m", *([order] if order else []))
    first = F.min_by("dist_m", order) if order else F.min("dist_m")
    return both.groupBy("src", "dst").agg(first.alias("dist_m"))


def distinct_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """The first of the nodes with one id, by ``order``."""
    rest = [c for c in nodes.columns if c not in ("node_id", order)]
    first = nodes.groupBy("node_id").agg(F.min_by(F.struct(*rest), order).alias("n"))
    return first.select("node_id", *[F.col(f"n.{c}").alias(c) for c in rest])


def bound_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends exist."""
    ids = nodes.select("node_id")
    kept = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return kept.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst", "dist_m")


def graph_from_request(spark: SparkSession, request: dict) -> Graph:
    """A graph from its wire form; repeated nodes and edges count once, the first wins, and loose edges go.

    Component ids that come along are ignored; a self-loop is an error."""
    nodes = [(i, n["id"], float(n["lat"]), float(n["lon"])) for i, n in enumerate(request.get("nodes", []))]
    edges = [(i, e["sourceId"], e["targetId"], float(e["distanceMeters"])) for i, e in enumerate(request.get("edges", []))]
    if any(a == b for _, a, b, _ in edges):
        raise ValueError("a graph must not hold self-loops")
    rows = distinct_nodes(spark.createDataFrame(nodes, "seq int, node_id string, lat double, lon double"), "seq")
    rows = rows.withColumns({"off_road": F.lit(False), "first_seen": F.lit(None).cast("timestamp"), "last_seen": F.lit(None).cast("timestamp")})
    links = canonical_edges(spark.createDataFrame(edges, "seq int, src string, dst string, dist_m double"), "seq")
    return Graph(rows, bound_edges(links, rows))


def trip_edges(points: DataFrame) -> DataFrame:
    """Consecutive points of each trip: (trip_id, pos, src, dst, dist_m), with nodes named trip_pos."""
    w = in_order(points)
    rows = numbered(points).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null")
    node = lambda pos: F.concat_ws("_", F.col("trip_id").cast("string"), pos.cast("string"))
    return rows.select("trip_id", "pos", node(F.col("pos")).alias("src"), node(F.col("pos") + 1).alias("dst"), haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("dist_m"))


def merged_graph(points: DataFrame, cell: Callable[[Column, Column], Column]) -> Graph:
    """One node per point, joined along trips, then merged by cell.

    ``points`` needs trip_id, pos (along the trip), lat, lon, ts and off_road. Nodes alone in their cell stay as they
    are; others become one node at their mean place, without times, off-road if all are. Edges within a cell go,
    those between two cells become one, of the distance between the cells' nodes.
    """
    w = W.partitionBy("trip_id").orderBy("pos")
    at = points.withColumn("cell", cell(F.col("lat"), F.col("lon")))
    name = F.concat_ws("_", F.col("trip_id").cast("string"), F.col("pos").cast("string"))
    one = F.count("*") == 1
    alone = lambda c: F.when(one, F.min(c))
    cells = at.withColumn("name", name).groupBy("cell").agg(
        F.when(one, F.min("name")).otherwise(F.concat(F.lit("cell_"), F.col("cell"))).alias("node_id"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.bool_and("off_road").alias("off_road"), alone("ts").alias("first_seen"), alone("ts").alias("last_seen"),
    )
    steps = at.select(F.col("cell").alias("a"), F.lead("cell").over(w).alias("b")).where("b is not null and a <> b")
    pairs = steps.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    end = lambda k: cells.select(F.col("cell").alias(k), F.col("node_id").alias(f"{k}_id"), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    rows = pairs.join(end("a"), "a").join(end("b"), "b")
    dist = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    edges = rows.select(F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst"), dist.alias("dist_m"))
    return Graph(cells.drop("cell").select("node_id", "lat", "lon", "off_road", "first_seen", "last_seen"), edges)


def matched_points(trips: DataFrame, matcher: Matcher | None) -> DataFrame:
    """Matched trips on their roads, without times; trips that fail, or match fewer than two points, as they are."""
    raw = numbered(trips).select("trip_id", "pos", "lat", "lon", "ts", F.lit(True).alias("off_road"))
    if matcher is None:
        return raw
    found = matcher.match(numbered(trips)).select("trip_id", "pos", "lat", "lon", F.lit(None).cast("timestamp").alias("ts"), F.lit(False).alias("off_road"))
    good = found.groupBy("trip_id").agg(F.count("*").alias("n")).where("n >= 2").select("trip_id")
    return raw.join(good, "trip_id", "left_anti").unionByName(found.join(good, "trip_id", "left_semi"))


def cell_encoder(config: PipelineConfig = DEFAULTS) -> Callable[[Column, Column], Column]:
    return lambda lat, lon: hexagons.text_of(hexagons.cell(lat, lon, config.cell_resolution))


def grid_encoder(step_e6: int) -> Callable[[Column, Column], Column]:
    return lambda lat, lon: grid_cell(lat, lon, step_e6)


def build_road_graph(points: DataFrame, config: PipelineConfig = DEFAULTS, matcher: Matcher | None = None, cell: Callable | None = None) -> Graph:
    """Clean the trips, match them if there is a matcher, and merge them into one graph."""
    trips = clean_trips(points, config.max_speed_kmh)
    return merged_graph(matched_points(trips, matcher), cell or cell_encoder(config))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions: (u, v, w)."""
    one = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("dist_m").alias("w"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def wire_nodes(nodes: DataFrame) -> DataFrame:
    """One JSON document per node: id, lat, lon, componentId (0 unless ``nodes`` has component_id)."""
    part = F.col("component_id") if "component_id" in nodes.columns else F.lit(0)
    return nodes.select(F.to_json(F.struct(F.col("node_id").alias("id"), "lat", "lon", part.alias("componentId"))).alias("value"))


def wire_edges(edges: DataFrame) -> DataFrame:
    """One JSON document per edge: sourceId, targetId, distanceMeters."""
    return edges.select(F.to_json(F.struct(F.col("src").alias("sourceId"), F.col("dst").alias("targetId"), F.col("dist_m").alias("distanceMeters"))).alias("value"))


def graph_to_request(graph: Graph, most: int = 250_000) -> dict:
    """The whole graph in its wire form, for graphs within ``most`` nodes and four times as many edges."""
    nodes, edges = wire_nodes(graph.nodes).limit(most + 1).collect(), wire_edges(graph.edges).limit(4 * most + 1).collect()
    if len(nodes) > most or len(edges) > 4 * most:
        raise ValueError("the graph is too large for one document; write wire_nodes and wire_edges")
    return {"nodes": [json.loads(r[0]) for r in nodes], "edges": [json.loads(r[0]) for r in edges]}
