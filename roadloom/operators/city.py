"""City graphs from an extract of road segments and a boundary."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.geo import haversine, in_rings
from roadloom.operators.metrics import guard_size, prune_components
from roadloom.operators.road_graph import Graph, canonical_edges
from roadloom.plans.config import DEFAULTS, PipelineConfig
from roadloom.plans.staging import staged

#: One row per road segment, whose geometry runs from its base node to its adjacent node.
SEGMENTS = "edge_id long, base long, adj long, car_fwd boolean, car_bwd boolean, road_env string, geometry array<struct<lat: double, lon: double>>"


@dataclass(frozen=True)
class Boundary:
    """rings: (lon, lat) of all parts' borders and holes; the box around them unless given."""

    rings: tuple
    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float

    @staticmethod
    def of(ring: list, box: tuple | None = None) -> Boundary:
        return Boundary.of_rings([ring], box)

    @staticmethod
    def of_rings(rings: list, box: tuple | None = None) -> Boundary:
        """``box``: (min_lat, max_lat, min_lon, max_lon)."""
        lats, lons = ([p[i] for r in rings for p in r] for i in (1, 0))
        low_lat, high_lat, low_lon, high_lon = box or (min(lats), max(lats), min(lons), max(lons))
        return Boundary(tuple(tuple((p[0], p[1]) for p in r) for r in rings), low_lat, high_lat, low_lon, high_lon)


def boundary_of(text: str) -> Boundary:
    """The first settlement of a GeoJSON document (a geometry, feature or collection), with all its parts and holes;
    none is an error. A bbox (west, south, east, north) of the feature or geometry counts instead of the box around."""
    shape = json.loads(text or "{}")
    if shape.get("type") == "FeatureCollection":
        shape = (shape.get("features") or [{}])[0]
    geometry = shape.get("geometry") or shape
    parts = geometry.get("coordinates")
    parts = {"Polygon": [parts], "MultiPolygon": parts}.get(geometry.get("type")) if parts else None
    if not parts:
        raise ValueError("city not found")
    box = shape.get("bbox") or geometry.get("bbox")
    half = len(box) // 2 if box else 0
    return Boundary.of_rings([ring for part in parts for ring in part if ring], (box[1], box[half + 1], box[0], box[half]) if box else None)


def read_boundary(spark: SparkSession, path: str) -> Boundary:
    """:func:`boundary_of` a file."""
    return boundary_of("\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect()))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def drivable(segments: DataFrame) -> DataFrame:
    """Open to cars in a direction, and no ferry."""
    return segments.where((F.col("car_fwd") | F.col("car_bwd")) & (F.coalesce("road_env", F.lit("")) != "FERRY"))


def _inside(point: Column, b: Boundary, buffer_m: float) -> Column:
    lat, lon = point["lat"], point["lon"]
    box = lat.between(b.min_lat, b.max_lat) & lon.between(b.min_lon, b.max_lon)
    return box & in_rings(lat, lon, [list(r) for r in b.rings], buffer_m)


def within(segments: DataFrame, b: Boundary, buffer_m: float = 0.0) -> DataFrame:
    """Segments of which an end lies in the box and in the polygons or their buffer; the cheap test comes first."""
    first, last = F.element_at("geometry", 1), F.element_at("geometry", -1)
    return segments.where(_inside(first, b, buffer_m) | _inside(last, b, buffer_m))


def chains(segments: DataFrame) -> DataFrame:
    """The points of each segment: (edge_id, pos, node_id, lat, lon). Ends have the id of their node, the points
    between are the segment's own."""
    rows = segments.select("edge_id", "base", "adj", F.size("geometry").alias("n"), F.posexplode("geometry").alias("pos", "p"))
    name = F.when(F.col("pos") == 0, F.col("base").cast("string")).when(F.col("pos") == F.col("n") - 1, F.col("adj").cast("string"))
    return rows.select("edge_id", "pos", F.coalesce(name, F.concat(F.col("edge_id").cast("string"), F.lit("_p"), F.col("pos").cast("string"))).alias("node_id"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def chain_graph(points: DataFrame) -> Graph:
    """A node per id (the place of the first segment that has it) and an edge per step of a chain."""
    w = W.partitionBy("edge_id").orderBy("pos")
    first = F.min_by(F.struct("lat", "lon"), F.struct("edge_id", "pos")).alias("p")
    none = F.lit(None).cast("timestamp")
    nodes = points.groupBy("node_id").agg(first).select("node_id", "p.lat", "p.lon", F.lit(False).alias("off_road"), none.alias("first_seen"), none.alias("last_seen"))
    steps = points.select("edge_id", "pos", F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)).alias("dist_m"))
    return Graph(nodes, canonical_edges(steps.where("dst is not null").withColumn("_order", F.struct("edge_id", "pos")), "_order"))


def extract_city(segments: DataFrame, boundary: Boundary, config: PipelineConfig = DEFAULTS, max_nodes: int | None = 250_000) -> Graph:
    """Drivable segments within the boundary as a graph, without small components; an error if it has more than
    ``max_nodes`` (None: any number)."""
    kept = within(drivable(segments.dropDuplicates(["edge_id"])), boundary, config.buffer_m)
    graph = chain_graph(staged(chains(kept), "chains"))
    graph = Graph(staged(graph.nodes, "nodes"), staged(graph.edges, "edges"))
    graph = prune_components(graph, config.retain_percent)
    return graph if max_nodes is None else guard_size(graph, max_nodes)
