"""One entry point for each thing a user asks for: import, measure, place, save, configure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.city import Boundary, extract_city, read_boundary
from roadloom.operators.gazetteer import boundary_by_name
from roadloom.operators.metrics import compute_metrics, with_component_ids
from roadloom.operators.placement import Placement, place
from roadloom.operators.road_graph import Graph, Matcher, build_road_graph, graph_from_request
from roadloom.operators.tiles import segments_near
from roadloom.plans.config import PipelineConfig, PlacementRequest
from roadloom.plans.settings import StoredConfigs
from roadloom.plans.staging import staged
from roadloom.plans.store import GraphStore
from roadloom.sources.points import list_samples, read_points, read_sample


class RoadService:
    """The users' graphs under ``root`` and their settings. Graphs are arguments and results, never kept aside."""

    def __init__(self, spark: SparkSession, root: str, matcher: Matcher | None = None) -> None:
        self.spark, self.store, self.configs, self.matcher = spark, GraphStore(spark, root), StoredConfigs(spark, root), matcher

    def _built(self, points: DataFrame, user: int) -> Graph:
        g = build_road_graph(points, self.configs.active(user), self.matcher)
        g = Graph(staged(g.nodes, "nodes"), staged(g.edges, "edges"))
        return Graph(staged(with_component_ids(g), "nodes"), g.edges)

    def import_file(self, path: str, user: int) -> Graph:
        return self._built(read_points(self.spark, path), user)

    def samples(self, folder: str) -> list[str]:
        return list_samples(folder)

    def import_sample(self, folder: str, name: str, user: int) -> Graph:
        return self._built(read_sample(self.spark, folder, name), user)

    def import_city(self, segments_path: str, boundary_path: str, user: int) -> Graph:
        return self._city(segments_path, read_boundary(self.spark, boundary_path), user)

    def import_city_by_name(self, segments_path: str, settlements_path: str, name: str, user: int) -> Graph:
        """The city that fits ``name`` best, in the user's country if the settings have one."""
        return self._city(segments_path, boundary_by_name(self.spark, settlements_path, name, self.configs.active(user).country), user)

    def _city(self, segments_path: str, boundary: Boundary, user: int) -> Graph:
        g = extract_city(segments_near(self.spark, segments_path, boundary), boundary, self.configs.active(user))
        g = Graph(staged(g.nodes, "nodes"), staged(g.edges, "edges"))
        return Graph(staged(with_component_ids(g), "nodes"), g.edges)

    def metrics(self, graph: Graph) -> DataFrame:
        return compute_metrics(graph)

    def place(self, graph: Graph | dict, request: PlacementRequest) -> Placement:
        return place(graph_from_request(self.spark, graph) if isinstance(graph, dict) else graph, request)

    def place_by_config(self, graph: Graph, user: int, seed: int = 0) -> Placement:
        c: PipelineConfig = self.configs.active(user)
        return place(graph, PlacementRequest(c.algorithm, c.k, c.max_radius_m, c.iterations, c.grasp_alpha, c.grasp_eval_budget, seed))


def response(p: Placement) -> DataFrame:
    """One row per station (node_id, lat, lon, rank) beside the objective, the number of nodes and the time taken."""
    return p.stations.select("*", F.lit(p.objective).alias("objective"), F.lit(p.total_nodes).alias("total_nodes"), F.lit(p.ms).alias("computation_time_ms"))
