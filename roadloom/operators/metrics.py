"""Measures of a road graph: components, degrees, lengths, density, clustering, eccentricities, treewidth."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import haversine
from roadloom.operators.components import connected_components
from roadloom.operators.reach import arrays_of, distances
from roadloom.operators.road_graph import Graph, adjacency
from roadloom.plans.order import ranked
from roadloom.plans.staging import staged

#: The largest graph, in nodes, whose eccentricities are exact and whose treewidth is bounded.
EXACT_NODES = 10_000


def components_of(graph: Graph) -> DataFrame:
    """(node_id, component): the smallest node id that is reachable; a node without edges is its own."""
    linked = connected_components(graph.edges).withColumnRenamed("node", "node_id")
    return graph.nodes.select("node_id").join(linked, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def ranked_components(labels: DataFrame) -> DataFrame:
    """(component, size, component_id): ids from 0, larger components first, then by smallest node.

    Components are ordered by range, in as many tasks as that takes."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    return ranked(sizes, F.desc("size"), "component", out="component_id").withColumn("component_id", F.col("component_id").cast("int"))


def with_component_ids(graph: Graph) -> DataFrame:
    """The nodes with component_id; 0 where there is none."""
    labels = staged(components_of(graph), "components")
    ranks = ranked_components(labels)
    ids = labels.join(ranks, "component").select("node_id", "component_id")
    return graph.nodes.join(ids, "node_id", "left").withColumn("component_id", F.coalesce("component_id", F.lit(0)))


def prune_components(graph: Graph, retain_percent: float) -> Graph:
    """Without components smaller than this share of the nodes; a graph of one component stays as it is."""
    labels = staged(components_of(graph), "components")
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    total = sizes.agg(F.count("*").alias("parts"), F.sum("size").alias("nodes")).first()
    if total["parts"] <= 1:
        return graph
    least = max(1, int(total["nodes"] * retain_percent / 100))
    kept = labels.join(sizes.where(F.col("size") >= least), "component", "left_semi").select("node_id")
    nodes = graph.nodes.join(kept, "node_id", "left_semi")
    return Graph(nodes, graph.edges.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").select("src", "dst", "dist_m"))


def guard_size(graph: Graph, most: int = 250_000) -> Graph:
    n = graph.nodes.limit(most + 1).count()
    if n > most:
        raise ValueError(f"the graph has more than {most} nodes")
    return graph


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("u").agg(F.count("*").alias("degree")).withColumnRenamed("u", "node_id")


def clustering(graph: Graph) -> DataFrame:
    """(node_id, degree, triangles, local): the share of a node's pairs of neighbours that are joined.

    A triangle is found once, from its end of lowest degree, so a hub's neighbours aren't paired."""
    deg = degrees(graph.edges)
    ends = graph.edges.join(deg.select(F.col("node_id").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("node_id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    out = ends.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    out = staged(out, "oriented")
    wedge = out.alias("x").join(out.select("a", F.col("b").alias("c")).alias("y"), "a").where("b < c").select("a", "b", "c")
    closed = wedge.join(graph.edges.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("triangles"))
    rows = graph.nodes.select("node_id").join(deg, "node_id", "left").join(corners, "node_id", "left")
    rows = rows.select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("triangles", F.lit(0)).alias("triangles"))
    d = F.col("degree")
    return rows.withColumn("local", F.when(d < 2, 0.0).otherwise(2 * F.col("triangles") / (d * (d - 1))))


def eccentricities(graph: Graph, seeds: DataFrame | None = None) -> DataFrame:
    """(node_id, ecc): the greatest distance from each seed (default: every node) to a node that it reaches.

    Every node: only for graphs within :data:`EXACT_NODES` and the bound of edges that go to each task."""
    if seeds is not None:
        return distances(graph, seeds).groupBy("src").agg(F.max("dist_m").alias("ecc")).withColumnRenamed("src", "node_id")
    arrays = arrays_of(graph, EXACT_NODES)
    if arrays is None:
        raise ValueError("the graph is too large for exact eccentricities; give seeds")
    spark = graph.nodes.sparkSession
    shared, n = spark.sparkContext.broadcast(arrays), len(arrays.ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for b in batches:
            yield pd.DataFrame({"node_id": [g.ids[i] for i in b["id"]], "ecc": [max(d for d, _ in g.search(int(i)).values()) for i in b["id"]]})

    return spark.range(0, n, 1, min(n // 64 + 1, spark.sparkContext.defaultParallelism * 4)).mapInPandas(run, "node_id string, ecc double")


def sample_nodes(nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` nodes without replacement, the first in a random order that follows from ``seed``."""
    return nodes.select("node_id").orderBy(F.md5(F.concat(F.col("node_id"), F.lit(f":{seed}"))), "node_id").limit(n)


def treewidth_bound(graph: Graph, labels: DataFrame) -> DataFrame:
    """(component, width): an upper bound by eliminating nodes of least degree (ties: least id) with fill-in.

    For graphs within :data:`EXACT_NODES` only. The steps depend on one another within a component; components are
    separate tasks."""
    if graph.nodes.limit(EXACT_NODES + 1).count() > EXACT_NODES:
        raise ValueError("the graph is too large for a treewidth bound")
    rows = graph.edges.join(labels.withColumnRenamed("node_id", "src"), "src").select("component", "src", "dst")

    def widths(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"component": [part["component"].iloc[0]], "width": [eliminate(zip(part["src"], part["dst"], strict=True))]})

    wide = rows.groupBy("component").applyInPandas(widths, "component string, width int")
    every = labels.select("component").distinct()
    return every.join(wide, "component", "left").select("component", F.coalesce("width", F.lit(0)).alias("width"))


def eliminate(edges: Iterator[tuple]) -> int:
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    heap = [(len(s), v) for v, s in near.items()]
    heapq.heapify(heap)
    width = 0
    while heap:
        d, v = heapq.heappop(heap)
        if v not in near or len(near[v]) != d:
            continue
        around = near.pop(v)
        width = max(width, len(around))
        for u in around:
            near[u] |= around
            near[u] -= {u, v}
            heapq.heappush(heap, (len(near[u]), u))
    return width


def bounding_box(nodes: DataFrame) -> DataFrame:
    """One row: node_count, the least and greatest coordinates, width_m (at the middle latitude), height_m and
    density_km2 (nodes per square km, 0 for an empty box)."""
    box = nodes.agg(F.count("*").alias("node_count"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    middle = (F.col("min_lat") + F.col("max_lat")) / 2
    sides = box.withColumns({"width_m": haversine(middle, F.col("min_lon"), middle, F.col("max_lon")), "height_m": haversine(F.col("min_lat"), F.col("min_lon"), F.col("max_lat"), F.col("min_lon"))})
    area = F.col("width_m") * F.col("height_m") / 1e6
    return sides.withColumn("density_km2", F.when(area > 0, F.col("node_count") / area).otherwise(0.0))


def compute_metrics(graph: Graph, threshold: int = EXACT_NODES, seeds: int = 50, seed: int = 0) -> DataFrame:
    """One row: node_count, edge_count, avg_degree, diameter_m, clustering, avg_edge_len_m, density_km2, components,
    radius_m, treewidth. All zero for an empty graph; above ``threshold`` nodes, distances come from ``seeds`` sampled
    nodes and treewidth is -1."""
    nodes, edges = staged(graph.nodes, "nodes"), staged(graph.edges, "edges")
    graph = Graph(nodes, edges)
    n, m = nodes.count(), edges.count()
    spark = nodes.sparkSession
    if n == 0:
        return spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("node_count", "edge_count")], *[F.lit(0.0).alias(c) for c in ("avg_degree", "diameter_m", "clustering", "avg_edge_len_m", "density_km2")], F.lit(0).cast("long").alias("components"), F.lit(0.0).alias("radius_m"), F.lit(0).alias("treewidth"))
    labels = staged(components_of(graph), "components")
    ecc = eccentricities(graph, None if n <= min(threshold, EXACT_NODES) else sample_nodes(nodes, seeds, seed))
    far = ecc.agg(F.coalesce(F.max("ecc"), F.lit(0.0)).alias("diameter_m"), F.coalesce(F.min(F.when(F.col("ecc") > 0, F.col("ecc"))), F.lit(0.0)).alias("radius_m")).first()
    width = treewidth_bound(graph, labels).agg(F.max("width")).first()[0] if n <= threshold else -1
    density = bounding_box(nodes).first()["density_km2"]
    length = edges.agg(F.coalesce(F.avg("dist_m"), F.lit(0.0)).alias("avg_edge_len_m"))
    local = clustering(graph).agg(F.coalesce(F.avg("local"), F.lit(0.0)).alias("clustering"))
    parts = labels.select("component").distinct().count()
    return length.join(F.broadcast(local)).select(
        F.lit(n).cast("long").alias("node_count"), F.lit(m).cast("long").alias("edge_count"), F.lit(2.0 * m / n).alias("avg_degree"), F.lit(far["diameter_m"]).alias("diameter_m"), "clustering", "avg_edge_len_m",
        F.lit(density).alias("density_km2"), F.lit(parts).cast("long").alias("components"), F.lit(far["radius_m"]).alias("radius_m"), F.lit(width).alias("treewidth"),
    )
