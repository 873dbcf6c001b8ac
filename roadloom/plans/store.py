"""Saved graphs as Parquet tables, one folder per graph: header, nodes, edges, stations, metrics."""

from __future__ import annotations

import os
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.road_graph import Graph

_HEADER = "graph_id long, user_id long, name string, created_at timestamp_ntz, updated_at timestamp_ntz, revision long, deleted boolean"


def claimed(spark: SparkSession, path: str, after: int) -> int:
    """The first revision beyond ``after`` that nobody has claimed in the folder ``path``; it is claimed now."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    revision = after + 1
    while not _made(spark, fs, folder, str(revision)):
        revision += 1
    return revision


def _made(spark: SparkSession, fs, folder, name: str) -> bool:
    """Whether a file that wasn't there was made. The usual create of a local folder looks first and makes then, so
    there the system's own exclusive one is asked for."""
    if fs.getUri().getScheme() == "file":
        try:
            os.close(os.open(f"{folder.toUri().getPath()}/{name}", os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, name), False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


class GraphStore:
    """Graphs of users under ``root``, a folder that all executors reach.

    Parts lie in folders by graph_id; a header row is added for each change and the latest counts, so renaming and
    deleting never rewrite data. A change claims its revision by making a file that must not be there, so that of
    writers at the same time each gets a revision of its own; a claim whose header never came leaves a gap."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, df: DataFrame, table: str, graph_id: int) -> None:
        # A folder of its own: writers who append to one folder would clear each other's files under way.
        df.write.parquet(f"{self.root}/{table}/graph_id={graph_id}")

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, table: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}").select(*empty.columns) if self._exists(table) else empty

    def _write_header(self, graph_id: int, user_id: int, name: str, created: datetime, revision: int, deleted: bool = False) -> None:
        now = datetime.now(UTC).replace(tzinfo=None)
        row = [(graph_id, user_id, name, created or now, now, revision, deleted)]
        self.spark.createDataFrame(row, _HEADER).coalesce(1).write.parquet(f"{self.root}/headers/entry={uuid.uuid4().hex}")

    def headers(self, user_id: int | None = None) -> DataFrame:
        """The latest header of each graph that isn't deleted."""
        rows = self._read("headers", _HEADER)
        cols = [c for c in rows.columns if c != "graph_id"]
        last = rows.groupBy("graph_id").agg(F.max_by(F.struct(*cols), "revision").alias("h")).select("graph_id", "h.*").where("not deleted")
        return last if user_id is None else last.where(F.col("user_id") == user_id)

    def _own(self, graph_id: int, user_id: int):
        row = self.headers(user_id).where(F.col("graph_id") == graph_id).first()
        if row is None:
            raise ValueError("graph not found")
        return row

    def save(self, graph: Graph, name: str, user_id: int, stations: DataFrame | None = None, metrics: DataFrame | None = None) -> int:
        """Save a graph and return its id: 63 random bits, so that writers need not ask one another."""
        graph_id = uuid.uuid4().int >> 65
        self._append(graph.nodes, "nodes", graph_id)
        self._append(graph.edges, "edges", graph_id)
        if stations is not None:
            self._append(stations.select("node_id", "lat", "lon", "rank"), "stations", graph_id)
        if metrics is not None:
            self._append(metrics, "metrics", graph_id)
        self._write_header(graph_id, user_id, name, None, 0)
        return graph_id

    def load(self, graph_id: int, user_id: int) -> tuple[Graph, DataFrame | None, DataFrame | None]:
        """The graph, its stations by rank and its metrics (None without any)."""
        self._own(graph_id, user_id)
        part = lambda t: self.spark.read.parquet(f"{self.root}/{t}/graph_id={graph_id}") if self._exists(f"{t}/graph_id={graph_id}") else None
        stations = part("stations")
        return Graph(part("nodes"), part("edges")), None if stations is None else stations.orderBy("rank"), part("metrics")

    def rename(self, graph_id: int, name: str, user_id: int) -> None:
        h = self._own(graph_id, user_id)
        self._write_header(graph_id, user_id, name, h["created_at"], claimed(self.spark, f"{self.root}/claims/{graph_id}", h["revision"]))

    def delete(self, graph_id: int, user_id: int) -> None:
        h = self._own(graph_id, user_id)
        self._write_header(graph_id, user_id, h["name"], h["created_at"], claimed(self.spark, f"{self.root}/claims/{graph_id}", h["revision"]), True)
        for t in ("nodes", "edges", "stations", "metrics"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{t}/graph_id={graph_id}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def list(self, user_id: int) -> DataFrame:
        """Each graph of the user with the numbers of its nodes, edges and stations; of others' graphs no file is read."""
        parts, mine = {}, [r["graph_id"] for r in self.headers(user_id).select("graph_id").collect()]
        for t in ("nodes", "edges", "stations"):
            parts[t] = self._read(t, "node_id string, src string, graph_id long").select("graph_id").where(F.col("graph_id").isin(mine))
        return graph_summaries(self.headers(user_id).select("graph_id", "name", "created_at"), **parts)


def graph_summaries(headers: DataFrame, nodes: DataFrame, edges: DataFrame, stations: DataFrame) -> DataFrame:
    """``headers`` (graph_id, ...) with node_count, edge_count and station_count; 0 where there are none."""
    out = headers
    for name, rows in (("node_count", nodes), ("edge_count", edges), ("station_count", stations)):
        counts = rows.groupBy("graph_id").agg(F.count("*").alias(name))
        out = out.join(counts, "graph_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out
