"""Queries of readers, boundaries, wire forms, saved graphs and settings, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import city, metrics, road_graph, trips
from roadloom.plans.catalog import _C, _F, _LABELS, _P, _SIZES, _W, COARSE, FINE, _graph, _points
from roadloom.plans.config import PipelineConfig
from roadloom.plans.service import RoadService
from roadloom.plans.settings import StoredConfigs
from roadloom.plans.staging import shared_dir
from roadloom.sources import points as src

CHUNK = 1000
#: Two parts, the first with a hole, and a box that cuts the second.
CITY = {
    "type": "Feature",
    "bbox": [17.01, 49.01, 17.17, 49.19],
    "geometry": {"type": "MultiPolygon", "coordinates": [
        [[[17.02, 49.02], [17.1, 49.03], [17.09, 49.1], [17.03, 49.09], [17.02, 49.02]], [[17.05, 49.04], [17.07, 49.04], [17.07, 49.07], [17.05, 49.07], [17.05, 49.04]]],
        [[[17.12, 49.11], [17.19, 49.12], [17.15, 49.18], [17.12, 49.11]]]]},
}
BUFFER_M = 555.0


def _scratch(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _chunked(s, d) -> DataFrame:
    """Points with the number of the file that they go to, at most :data:`CHUNK` and their repeats to a file. Numbers
    have leading zeros, so that files' names are in the order of their numbers."""
    return _points(s, d).withColumn("chunk", F.lpad(F.floor(F.col("seq") % 1_000_000_000 / CHUNK).cast("string"), 12, "0"))


def _written(rows: DataFrame, path: str, extension: str | None = None) -> str:
    """One file for each row (chunk, value). Files have Spark's names; with an extension, the driver renames them."""
    rows.repartition("chunk").write.partitionBy("chunk").option("lineSep", "\n").text(path)
    if extension is None:
        return path
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, names = fs.listFiles(fs_path, True), []
    while found.hasNext():
        names.append(found.next().getPath())
    for p in names:
        if p.getName().startswith("part-"):
            fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"track.{extension}"))
    return path


def _read(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_extract("file", "chunk=([0-9]+)", 1).cast("long").alias("chunk"), F.col("seq").cast("long").alias("seq"), "trip_id", "lat", "lon", F.unix_micros("ts").alias("us"))


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def geojson_points(s, d):
    """Points written as GeoJSON files and read from their folder."""
    p = _chunked(s, d).where("ts is not null")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.date_format("ts", _ISO).alias("timestamp"), F.when(F.col("seq") % 7 > 0, F.col("trip_id")).alias("trip_id")).alias("properties"),
    )
    docs = p.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", feature.alias("f")))), lambda x: x["f"]).alias("features"))
    path = _written(docs.select("chunk", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")), _scratch(s, "geojson"))
    return _read(src.read_folder(s, path, "geojson"))


def gpx_points(s, d):
    """Points written as GPX files, a segment for each trip, and read from their folder."""
    stamp = F.when(F.col("ts").isNull(), F.lit("")).otherwise(F.concat(F.lit("<time>"), F.date_format("ts", _ISO), F.lit("</time>")))
    pt = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('">'), stamp, F.lit("</trkpt>"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["v"]), "")
    segs = _chunked(s, d).withColumn("v", pt).groupBy("chunk", "trip_id").agg(tag("trkseg", joined(F.struct("seq", "v"))).alias("v"))
    docs = segs.groupBy("chunk").agg(tag("gpx", F.concat(F.lit("<metadata><time>2020-01-01T00:00:00Z</time></metadata>"), tag("trk", joined(F.struct("trip_id", "v"))))).alias("value"))
    return _read(src.read_folder(s, _written(docs, _scratch(s, "gpx")), "gpx"))


def csv_points(s, d):
    """Points written as CSV files with headers of their own, read from their folder and numbered across files."""
    p = trips.valid_points(_chunked(s, d))
    line = F.concat_ws(",", "lon", F.col("trip_id") % 5, "lat")
    docs = p.groupBy("chunk").agg(F.concat(F.lit("LNG,trip, Lat\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("v")))), lambda x: x["v"]), "\n")).alias("value"))
    return src.merged_files(src.read_folder(s, _written(docs, _scratch(s, "csv"), "csv"))).select("seq", "trip_id", "lat", "lon")


def in_boundary(s, d):
    """Points in the parts of a city, outside the hole, or within the buffer of a border."""
    b = city.boundary_of(json.dumps({"type": "FeatureCollection", "features": [CITY]}))
    p = trips.valid_points(_points(s, d))
    inside = lambda m: city._inside(F.struct("lat", "lon"), b, m)
    return p.select("seq", inside(0.0).alias("inside"), inside(BUFFER_M).alias("near")).where("near")


def request_graph(s, d):
    """A graph from its wire form: nations, linked with those of the next key and with their region."""
    rows = s.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()
    nodes = [{"id": f"n{r['n_nationkey']}", "lat": r["n_nationkey"], "lon": r["n_regionkey"], "componentId": 3} for r in [*rows, *rows[:5]]]
    edges = [{"sourceId": f"n{r['n_nationkey']}", "targetId": f"n{(r['n_nationkey'] + 1 + r['n_regionkey']) % 27}", "distanceMeters": 10.0 + r["n_nationkey"]} for r in rows]
    g = road_graph.graph_from_request(s, {"nodes": nodes, "edges": edges})
    return g.nodes.select(F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("lat").alias("v")).unionByName(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dist_m").alias("v")))


def wire_form(s, d):
    """The wire form of a graph with component ids, read back from its JSON."""
    g = _graph(s, d, FINE)
    nodes = road_graph.wire_nodes(metrics.with_component_ids(g)).select(F.from_json("value", "id string, lat double, componentId long").alias("j")).select(F.col("j.id").alias("a"), F.lit("").alias("b"), F.round("j.lat", 6).alias("v"), F.col("j.componentId").alias("part"))
    edges = road_graph.wire_edges(g.edges).select(F.from_json("value", "sourceId string, targetId string, distanceMeters double").alias("j"))
    return nodes.unionByName(edges.select(F.col("j.sourceId").alias("a"), F.col("j.targetId").alias("b"), F.round("j.distanceMeters", 3).alias("v"), F.lit(None).cast("long").alias("part")))


def saved_graphs(s, d):
    """Graphs saved, renamed, deleted and loaded; stations come by rank, and others' graphs aren't found."""
    store = RoadService(s, _scratch(s, "graphs")).store
    g = _graph(s, d, COARSE)
    south = road_graph.Graph(g.nodes.where("lat < 50"), road_graph.bound_edges(g.edges, g.nodes.where("lat < 50")))
    ranks = g.nodes.where("lat > 51.9").select("node_id", "lat", "lon", F.col("lat").cast("int").alias("rank"))
    first, second, third = store.save(g, "all", 1, ranks), store.save(south, "south", 1), store.save(south, "mine", 2)
    store.rename(second, "half", 1)
    store.delete(third, 2)
    denied = 0
    for act in (lambda: store.load(first, 2), lambda: store.rename(third, "x", 2), lambda: store.delete(second, 2)):
        try:
            act()
        except ValueError:
            denied += 1
    loaded, stations, _ = store.load(first, 1)
    rows = store.list(1).select((F.col("graph_id") == first).alias("first"), "name", "node_count", "edge_count", "station_count")
    sums = loaded.edges.agg(F.count("*").alias("edge_count")).select(F.lit(True).alias("first"), F.lit("loaded").alias("name"), F.lit(denied).cast("long").alias("node_count"), "edge_count", F.lit(stations.count()).cast("long").alias("station_count"))
    return rows.unionByName(sums)


def settings(s, d):
    """The settings of all customers, of whom every third has saved own ones, and every ninth others after them."""
    book = StoredConfigs(s, _scratch(s, "settings"))
    users = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    u = F.col("user_id")
    own = users.where("user_id % 3 = 0").select(u, F.lit(0).alias("revision"), (u % 5 + 1).alias("k"), (u % 7 * 100 + 100).alias("max_radius_m"), F.when(u % 2 == 0, "sk").alias("country"))
    book.save(own)
    book.save(users.where("user_id % 9 = 0").select(u, F.lit(1).alias("revision"), F.lit("GREEDY").alias("algorithm"), F.lit(9).alias("k")))
    return book.of(users)


def refusals(s, d):
    """What is said to requests that can't be met, in one message for all wrong settings."""
    g = _graph(s, d, COARSE)
    tries = {
        "settings": lambda: PipelineConfig(k=0, grasp_alpha=1.5, country="de"),
        "size": lambda: metrics.guard_size(g, 10),
        "format": lambda: src.read_points(s, "track.GPX"),
        "sample": lambda: src.read_sample(s, "/tmp", "../track.gpx"),
        "city": lambda: city.boundary_of("{}"),
        "loop": lambda: road_graph.graph_from_request(s, {"nodes": [], "edges": [{"sourceId": "a", "targetId": "a", "distanceMeters": 1}]}),
    }
    rows = []
    for name, act in tries.items():
        try:
            act()
        except ValueError as e:
            rows.append((name, str(e)))
    return s.createDataFrame(rows, "name string, message string")


_SIDES = [(*a, *b) for part in CITY["geometry"]["coordinates"] for ring in part for a, b in zip(ring[:-1], ring[1:], strict=True)]
_VALUES = ", ".join(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for x1, y1, x2, y2 in _SIDES)
_T = "greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
_BOX = "lat BETWEEN {1} AND {3} AND lon BETWEEN {0} AND {2}".format(*CITY["bbox"])
_IN = f"p AS MATERIALIZED (SELECT *, seq % 1000000000 // {CHUNK} AS chunk FROM q)"
_CHUNKS = _P.replace("p AS MATERIALIZED", "q AS", 1).replace("FROM p ", "FROM q ", 1) + ", " + _IN
ORACLES = {
    "geojson_points": f"WITH {_CHUNKS} SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY seq) - 1 AS seq, (CASE WHEN seq % 7 > 0 THEN trip_id ELSE 1 END)::INT AS trip_id, lat, lon, us FROM p WHERE us IS NOT NULL",
    "gpx_points": f"WITH {_CHUNKS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY chunk ORDER BY trip_id) AS t, row_number() OVER (PARTITION BY chunk, trip_id ORDER BY seq) - 1 AS i FROM p) SELECT chunk, (t - 1) * 4294967296 + i AS seq, t::INT AS trip_id, lat, lon, coalesce(us, epoch_us(TIMESTAMP '2020-01-01')) AS us FROM k",
    "csv_points": f"WITH {_CHUNKS}, k AS (SELECT * FROM p JOIN (SELECT seq FROM v) USING (seq)) SELECT row_number() OVER (ORDER BY chunk, seq) - 1 AS seq, dense_rank() OVER (ORDER BY chunk, trip_id % 5)::INT AS trip_id, lat, lon FROM k",
    "in_boundary": f"WITH {_P}, sd(x1, y1, x2, y2) AS (VALUES {_VALUES}), k AS (SELECT seq, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / CASE WHEN y1 = y2 THEN 1 ELSE y2 - y1 END + x1) % 2 = 1 AS inside, bool_or(pow(lon - x1 - {_T} * (x2 - x1), 2) + pow(lat - y1 - {_T} * (y2 - y1), 2) <= pow({BUFFER_M}::DOUBLE / 111000, 2)) AS close_by FROM v, sd WHERE {_BOX} GROUP BY seq) SELECT seq, inside, inside OR close_by AS near FROM k WHERE inside OR close_by",
    "request_graph": "WITH e AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS a, 'n' || (n_nationkey + 1 + n_regionkey) % 27 AS b, 10.0::DOUBLE + n_nationkey AS v FROM nation), i AS (SELECT 'n' || n_nationkey AS id FROM nation) SELECT 'n' || n_nationkey AS a, NULL::VARCHAR AS b, n_nationkey::DOUBLE AS v FROM nation UNION ALL SELECT least(a, b), greatest(a, b), arg_min(v, k) FROM e WHERE a IN (SELECT id FROM i) AND b IN (SELECT id FROM i) GROUP BY ALL",
    "wire_form": f"{_W}{_F}, {_LABELS}, {_SIZES}, rk AS (SELECT component, row_number() OVER (ORDER BY size DESC, component) - 1 AS part FROM sz) SELECT node_id AS a, '' AS b, round(lat, 6) AS v, part FROM nodes JOIN cc ON id = node_id JOIN rk ON component = c UNION ALL SELECT src, dst, dist_m, NULL FROM edges",
    "saved_graphs": f"WITH {_C}, n AS (SELECT count(*) AS n, count(*) FILTER (lat < 50) AS south, count(*) FILTER (lat > 51.9) AS north FROM nodes), ge AS (SELECT count(*) AS n, count(*) FILTER (src IN (SELECT node_id FROM nodes WHERE lat < 50) AND dst IN (SELECT node_id FROM nodes WHERE lat < 50)) AS south FROM edges) SELECT TRUE AS first, 'all' AS name, n.n AS node_count, ge.n AS edge_count, n.north AS station_count FROM n, ge UNION ALL SELECT FALSE, 'half', n.south, ge.south, 0 FROM n, ge UNION ALL SELECT TRUE, 'loaded', 3, ge.n, n.north FROM n, ge",
    "settings": "SELECT c_custkey AS user_id, 200.0::DOUBLE AS max_speed_kmh, 12 AS cell_resolution, (CASE WHEN c_custkey % 9 = 0 THEN 9 WHEN c_custkey % 3 = 0 THEN c_custkey % 5 + 1 ELSE 2 END)::INT AS k, (CASE WHEN c_custkey % 9 = 0 OR c_custkey % 3 <> 0 THEN 1000 ELSE c_custkey % 7 * 100 + 100 END)::DOUBLE AS max_radius_m, 10 AS iterations, 0.3::DOUBLE AS grasp_alpha, 500 AS grasp_eval_budget, CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 6 = 0 THEN 'sk' END AS country, 2.0::DOUBLE AS retain_percent, 100.0::DOUBLE AS buffer_m, CASE WHEN c_custkey % 9 = 0 THEN 'GREEDY' ELSE 'RANDOM' END AS algorithm FROM customer",
    "refusals": "SELECT * FROM (VALUES ('settings', 'country must be sk, cz, at or None; k must be from 1 to 1000000, not 0; grasp_alpha must be from 0 to 1, not 1.5'), ('size', 'the graph has more than 10 nodes'), ('format', 'unsupported file format: track.GPX'), ('sample', 'a sample''s name must not hold a path'), ('city', 'city not found'), ('loop', 'a graph must not hold self-loops')) t(name, message)",
}
QUERIES = {f.__name__: f for f in (geojson_points, gpx_points, csv_points, in_boundary, request_graph, wire_form, saved_graphs, settings, refusals)}
