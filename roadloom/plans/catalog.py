"""Registered queries over the driver's tables, with the SQL they are checked against.

GPS points come from ``events`` through :func:`points_of_events`. Distances are rounded to millimetres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.geo import haversine, hex_cell, in_ring
from roadloom.operators import city, metrics, reach, road_graph, trips
from roadloom.operators.road_graph import Graph
from roadloom.plans import store
from roadloom.plans.staging import staged
from roadloom.sources.points import parse_csv, points_of_events

SPEED, FINE, COARSE, RADIUS, K = 5.0, 5000, 20000, 5000.0, 2
RING = [(17.02, 49.02), (17.15, 49.03), (17.18, 49.15), (17.09, 49.08), (17.03, 49.17)]


def _points(spark: SparkSession, d: str) -> DataFrame:
    return points_of_events(spark.read.parquet(f"{d}/events.parquet"))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """Valid, distinct points of trips with two or more, without the speed filter."""
    return trips.long_trips(trips.distinct_points(trips.valid_points(_points(spark, d))))


def _graph(spark: SparkSession, d: str, step: int) -> Graph:
    g = road_graph.merged_graph(road_graph.matched_points(_plain(spark, d), None), road_graph.grid_encoder(step))
    edges = staged(g.edges.select("src", "dst", F.round("dist_m", 3).alias("dist_m")), "edges")
    return Graph(staged(g.nodes, "nodes"), edges)


def coord_filter(s, d):
    return trips.valid_points(_points(s, d)).select("seq", "trip_id", "lat", "lon")


def trip_sizes(s, d):
    return trips.trip_sizes(_points(s, d)).select("trip_id", "n_points", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


def speed_filter(s, d):
    return trips.speed_filter(trips.valid_points(_points(s, d)), SPEED).select("seq", "trip_id")


def clean_trips(s, d):
    return trips.clean_trips(_points(s, d), SPEED).select("seq", "trip_id")


def dedup(s, d):
    return trips.distinct_points(_points(s, d)).select("seq", "trip_id")


def min_len(s, d):
    """Trips of one user on one day; many have a single point."""
    day = F.coalesce(F.dayofyear("ts"), F.lit(0))
    rows = trips.valid_points(_points(s, d)).withColumn("trip_id", F.col("trip_id") * 1000 + day)
    return trips.long_trips(rows).select("seq", "trip_id")


def point_order(s, d):
    return trips.numbered(_plain(s, d)).select("seq", "trip_id", F.col("pos").cast("long").alias("pos"))


def traj_edges(s, d):
    return road_graph.trip_edges(_plain(s, d)).select("src", "dst", F.round("dist_m", 3).alias("dist_m"))


def cell_nodes(s, d):
    return _graph(s, d, FINE).nodes.select("node_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "off_road", F.unix_micros("first_seen").alias("first_us"))


def cell_edges(s, d):
    return _graph(s, d, FINE).edges


def hex_cells(s, d):
    return _plain(s, d).groupBy(hex_cell(F.col("lat"), F.col("lon"), 7).alias("cell")).agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def edge_canonical(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    raw = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("n"), F.col("o_custkey") % 97).alias("src"), F.concat(F.lit("n"), F.col("o_orderkey") % 89).alias("dst"), F.col("o_totalprice").cast("double").alias("dist_m"))
    return road_graph.canonical_edges(raw, "seq")


def node_distinct(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("n"), F.col("o_custkey") % 97).alias("node_id"), F.col("o_totalprice").cast("double").alias("lat"))
    return road_graph.distinct_nodes(o, "seq")


def bound_edges(s, d):
    g = _graph(s, d, COARSE)
    return road_graph.bound_edges(g.edges, g.nodes.where("lat < 50.5"))


def avg_edge_len(s, d):
    return _graph(s, d, FINE).edges.agg(F.round(F.avg("dist_m"), 3).alias("avg_edge_len_m"), F.count("*").alias("edge_count"))


def bbox_density(s, d):
    b = metrics.bounding_box(_graph(s, d, FINE).nodes)
    return b.select("node_count", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon", "density_km2")], *[F.round(c, 3).alias(c) for c in ("width_m", "height_m")])


def avg_degree(s, d):
    g = _graph(s, d, FINE)
    n = g.nodes.agg(F.count("*").alias("n"))
    return g.edges.agg(F.count("*").alias("m")).join(F.broadcast(n)).select(F.round(2.0 * F.col("m") / F.col("n"), 6).alias("avg_degree"))


def degrees(s, d):
    return metrics.degrees(_graph(s, d, FINE).edges)


def clustering(s, d):
    return metrics.clustering(_graph(s, d, COARSE)).select("node_id", "degree", "triangles", F.round("local", 6).alias("local"))


def components(s, d):
    return metrics.components_of(_graph(s, d, FINE))


def component_rank(s, d):
    return metrics.ranked_components(metrics.components_of(_graph(s, d, FINE))).select("component", "size", F.col("component_id").cast("long").alias("component_id"))


def component_prune(s, d):
    g = metrics.prune_components(_graph(s, d, FINE), 20.2)
    return g.nodes.select("node_id", F.lit("node").alias("kind")).unionByName(g.edges.select(F.concat_ws("|", "src", "dst").alias("node_id"), F.lit("edge").alias("kind")))


def road_components(s, d):
    """The whole way from raw points to components: cleaning with the speed filter, merging, component ids."""
    g = road_graph.build_road_graph(_points(s, d), road_graph.DEFAULTS.updated(max_speed_kmh=SPEED), cell=road_graph.grid_encoder(FINE))
    g = Graph(staged(g.nodes, "nodes"), staged(g.edges, "edges"))
    rows = metrics.with_component_ids(g).groupBy(F.col("component_id").cast("long").alias("component_id"))
    return rows.agg(F.count("*").alias("n_nodes"), F.round(F.min("lat"), 6).alias("min_lat"), F.round(F.max("lat"), 6).alias("max_lat"))


def graph_reach(s, d):
    return reach.bounded_reach(_graph(s, d, COARSE), RADIUS).select("src", "dst", F.round("dist_m", 3).alias("dist_m"))


def coverage_gain(s, d):
    g = _graph(s, d, COARSE)
    return reach.coverage_gain(reach.bounded_reach(g, RADIUS), g.nodes.where("lat > 50"))


def nearest_station(s, d):
    g = _graph(s, d, COARSE)
    fixed = g.nodes.where("lat > 50 and lon > 17.1").select("node_id")
    return reach.nearest_station(g.nodes, reach.bounded_reach(g, RADIUS, fixed), fixed).select("node_id", F.round("dist_m", 3).alias("dist_m"))


def eccentricity_sampled(s, d):
    """From a sample of 50 nodes."""
    g = _graph(s, d, COARSE)
    return metrics.eccentricities(g, metrics.sample_nodes(g.nodes, 50)).select("node_id", F.round("ecc", 3).alias("ecc"))


def csv_parse(s, d):
    p = _points(s, d)
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.concat_ws(",", F.col("seq"), F.when(F.col("seq") % 13 == 0, F.lit("x")).otherwise(F.col("trip_id").cast("string")), F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon"), F.coalesce(ts, F.lit("bad")))
    lines = p.select("seq", F.when(F.col("seq") % 17 == 0, F.lit("1,2")).when(F.col("seq") % 19 == 0, F.lit("  ")).otherwise(line).alias("value"))
    return parse_csv(lines, "id, Trip ,LATITUDE,lng,Time").select("seq", "trip_id", "lat", "lon", F.unix_micros("ts").alias("us"))


def in_polygon(s, d):
    p = trips.valid_points(_points(s, d))
    return p.where(in_ring(F.col("lat"), F.col("lon"), RING)).select("seq", "lat", "lon")


def pair_distance(s, d):
    p = trips.valid_points(_points(s, d))
    return p.select("seq", F.round(haversine(F.col("lat"), F.col("lon"), F.lit(48.1), F.lit(17.1)), 3).alias("dist_m"))


def _segments(s, d) -> DataFrame:
    """Road segments of three points from the events: ends on a grid of nodes, a point of their own between. Some are
    repeated."""
    p = trips.valid_points(_points(s, d))
    i = F.col("seq") % 1_000_000_000
    lat, lon = lambda n: 49.0 + (n % 40) * 0.005, lambda n: 17.0 + F.floor(n / 40) % 40 * 0.005
    a, b = i % 1600, (i * 7 + 1 + i % 3) % 1600
    pt = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    rows = p.select(
        i.alias("edge_id"), a.alias("base"), b.alias("adj"), (i % 5 != 0).alias("car_fwd"), (i % 10 == 0).alias("car_bwd"), F.when(i % 11 == 0, "FERRY").otherwise("ROAD").alias("road_env"),
        F.array(pt(lat(a), lon(a)), pt((lat(a) + lat(b)) / 2, (lon(a) + lon(b)) / 2), pt(lat(b), lon(b))).alias("geometry"),
    )
    return rows.where("base <> adj")


def city_edges(s, d):
    g = city.chain_graph(city.chains(city.within(city.drivable(_segments(s, d).dropDuplicates(["edge_id"])), city.Boundary.of(RING))))
    return g.edges.select("src", "dst", F.round("dist_m", 3).alias("dist_m"))


def city_nodes(s, d):
    """All of a city's nodes, however many: the limit of an import is the service's."""
    g = city.extract_city(_segments(s, d), city.Boundary.of(RING), road_graph.DEFAULTS.updated(buffer_m=0.0, retain_percent=0.2), max_nodes=None)
    return g.nodes.select("node_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def graph_summaries(s, d):
    read = lambda t: s.read.parquet(f"{d}/{t}.parquet")
    heads = read("customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_name").alias("name"))
    o = read("orders").select(F.col("o_custkey").alias("graph_id"), "o_orderkey")
    return store.graph_summaries(heads, o, read("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("graph_id"), read("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("graph_id")))


# SQL.
_HAV = "(2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return _HAV.format(a=a)


_P = """e AS (SELECT event_id AS seq, user_id::INT AS trip_id,
  CASE WHEN event_id % 97 = 0 THEN 0 WHEN event_id % 89 = 0 THEN 95000000 ELSE 48000000 + (user_id % 5) * 1000000 + ((event_id * 7919) % 10007) * 20 END AS y,
  CASE WHEN event_id % 97 = 0 THEN 0 ELSE 17000000 + ((event_id * 104729) % 10009) * 20 END AS x,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE epoch_us(ts) END AS us FROM events),
p AS MATERIALIZED (SELECT *, y / 1e6 AS lat, x / 1e6 AS lon FROM (SELECT * FROM e UNION ALL SELECT seq + 1000000000, trip_id, y, x, us FROM e WHERE seq % 53 = 0)),
v AS (SELECT * FROM p WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 0.001 AND abs(lon) < 0.001))"""
_FIRST = "SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY trip_id, lat, lon, us ORDER BY seq) = 1"
_LONG = "SELECT * FROM {t} QUALIFY count(*) OVER (PARTITION BY trip_id) >= 2"
_PLAIN = f"""{_P}, d1 AS ({_FIRST.format(t="v")}), l AS ({_LONG.format(t="d1")}),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY us NULLS LAST, seq) - 1 AS pos FROM l)"""


def _merged(step: int, of: str = "o") -> str:
    return f"""c AS MATERIALIZED (SELECT *, (y // {step}) || '_' || (x // {step}) AS cell FROM {of}),
nodes AS MATERIALIZED (SELECT cell, CASE WHEN count(*) = 1 THEN min(trip_id || '_' || pos) ELSE 'cell_' || cell END AS node_id, avg(y) / 1e6 AS lat, avg(x) / 1e6 AS lon, CASE WHEN count(*) = 1 THEN min(us) END AS us FROM c GROUP BY cell),
st AS (SELECT cell AS a, lead(cell) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM c),
pr AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM st WHERE b IS NOT NULL AND a <> b),
edges AS MATERIALIZED (SELECT least(m.node_id, n.node_id) AS src, greatest(m.node_id, n.node_id) AS dst, round({hav("m.lat", "m.lon", "n.lat", "n.lon")}, 3) AS dist_m FROM pr JOIN nodes m ON m.cell = a JOIN nodes n ON n.cell = b),
adj AS MATERIALIZED (SELECT src AS u, dst AS v, dist_m AS w FROM edges UNION ALL SELECT dst, src, dist_m FROM edges)"""


_FOLD = f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY us NULLS LAST, seq) AS rn FROM v),
f AS (SELECT trip_id, rn, seq, TRUE AS keep, lat, lon, us FROM o WHERE rn = 1
  UNION ALL SELECT trip_id, rn, seq, keep, CASE WHEN go THEN nlat ELSE lat END, CASE WHEN go THEN nlon ELSE lon END, CASE WHEN go THEN nus ELSE us END FROM (
    SELECT *, nus IS NULL OR us IS NULL OR secs <= 0 OR fast AS keep, nus IS NOT NULL AND (us IS NULL OR (secs > 0 AND fast)) AS go FROM (
      SELECT o.trip_id, o.rn, o.seq, f.lat, f.lon, f.us, o.lat AS nlat, o.lon AS nlon, o.us AS nus, (o.us - f.us) // 1000000 AS secs,
        {hav("f.lat", "f.lon", "o.lat", "o.lon")} / nullif((o.us - f.us) // 1000000, 0) <= {SPEED} / 3.6 AS fast
      FROM f JOIN o ON o.trip_id = f.trip_id AND o.rn = f.rn + 1)))"""
_LABELS = "cc(id, c) USING KEY (id) AS (SELECT node_id, node_id FROM nodes UNION ALL SELECT x.v, min(x.c) FROM (SELECT a.v, cc.c FROM cc JOIN adj a ON a.u = cc.id) x JOIN recurring.cc k ON k.id = x.v WHERE x.c < k.c GROUP BY x.v)"
_SIZES = "sz AS (SELECT c AS component, count(*) AS size FROM cc GROUP BY c)"


def _dist(start: str, limit: str = "") -> str:
    return f"""r(s, t, d) USING KEY (s, t) AS (SELECT node_id, node_id, 0.0::DOUBLE FROM {start}
  UNION ALL SELECT s, t, min(d) FROM (SELECT r.s, a.v AS t, r.d + a.w AS d FROM r JOIN adj a ON a.u = r.t {limit}) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.s = x.s AND k.t = x.t AND k.d <= x.d) GROUP BY s, t)"""


_NEAR = f"WHERE r.d + a.w <= {RADIUS}"
_W = "WITH RECURSIVE "
_RINGSQL = ", ".join(f"({i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, (a, b) in enumerate(zip(RING, [*RING[1:], RING[0]], strict=True)))
_INSIDE = "((SELECT count(*) FROM ring g WHERE (g.y1 > {lat}) <> (g.y2 > {lat}) AND {lon} < (g.x2 - g.x1) * ({lat} - g.y1) / (g.y2 - g.y1) + g.x1) % 2 = 1)"
_BOX = f"{{lat}} BETWEEN {min(p[1] for p in RING)} AND {max(p[1] for p in RING)} AND {{lon}} BETWEEN {min(p[0] for p in RING)} AND {max(p[0] for p in RING)} AND {_INSIDE}"
_CITY = f"""{_P}, ring(i, x1, y1, x2, y2) AS (VALUES {_RINGSQL}),
g AS (SELECT DISTINCT seq AS edge_id, seq % 1600 AS a, (seq * 7 + 1 + seq % 3) % 1600 AS b FROM (SELECT seq % 1000000000 AS seq FROM v) WHERE (seq % 5 <> 0 OR seq % 10 = 0) AND seq % 11 <> 0),
h AS (SELECT edge_id, a, b, 49.0::DOUBLE + (a % 40) * 0.005::DOUBLE AS ya, 17.0::DOUBLE + (a // 40) % 40 * 0.005::DOUBLE AS xa, 49.0::DOUBLE + (b % 40) * 0.005::DOUBLE AS yb, 17.0::DOUBLE + (b // 40) % 40 * 0.005::DOUBLE AS xb FROM g WHERE a <> b),
k AS MATERIALIZED (SELECT * FROM h WHERE ({_BOX.format(lat="ya", lon="xa")}) OR ({_BOX.format(lat="yb", lon="xb")})),
q AS (SELECT edge_id, 0 AS pos, a::VARCHAR AS id, ya AS lat, xa AS lon FROM k UNION ALL SELECT edge_id, 1, edge_id || '_p1', (ya + yb) / 2, (xa + xb) / 2 FROM k UNION ALL SELECT edge_id, 2, b::VARCHAR, yb, xb FROM k),
s2 AS (SELECT edge_id, pos, id AS a, lead(id) OVER w AS b, {hav("lat", "lon", "lead(lat) OVER w", "lead(lon) OVER w")} AS dist FROM q WINDOW w AS (PARTITION BY edge_id ORDER BY pos)),
edges AS MATERIALIZED (SELECT least(a, b) AS src, greatest(a, b) AS dst, round(arg_min(dist, (edge_id, pos)), 3) AS dist_m FROM s2 WHERE b IS NOT NULL GROUP BY ALL),
nodes AS MATERIALIZED (SELECT id AS node_id, arg_min(lat, (edge_id, pos)) AS lat, arg_min(lon, (edge_id, pos)) AS lon FROM q GROUP BY id),
adj AS MATERIALIZED (SELECT src AS u, dst AS v, dist_m AS w FROM edges UNION ALL SELECT dst, src, dist_m FROM edges)"""
_X, _Y = "(radians(lon) * 6371000.0)", "(sin(radians(lat)) * 6371000.0)"
_EDGE = repr(1_281_256.0 / 7**3.5)
_HEX = f"""hq AS (SELECT *, ({_X} * (sqrt(3.0::DOUBLE) / 3) - {_Y} / 3) / {_EDGE}::DOUBLE AS q, ({_Y} * 2 / 3) / {_EDGE}::DOUBLE AS r FROM o),
hr AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM hq),
hd AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM hr),
hx AS (SELECT *, CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS fq, CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS fr FROM hd)"""

_F, _C = f"{_PLAIN}, {_merged(FINE)}", f"{_PLAIN}, {_merged(COARSE)}"
ORACLES = {
    "coord_filter": f"WITH {_P} SELECT seq, trip_id, lat, lon FROM v",
    "trip_sizes": f"WITH {_P} SELECT trip_id, count(*) AS n_points, min(us) AS first_us, max(us) AS last_us FROM p GROUP BY trip_id",
    "speed_filter": f"{_W}{_P}, {_FOLD} SELECT seq, trip_id FROM f WHERE keep",
    "clean_trips": f"{_W}{_P}, {_FOLD}, kp AS (SELECT o.* FROM o JOIN f USING (seq) WHERE keep), d1 AS ({_FIRST.format(t='kp')}) SELECT seq, trip_id FROM ({_LONG.format(t='d1')})",
    "dedup": f"WITH {_P} SELECT seq, trip_id FROM ({_FIRST.format(t='p')})",
    "min_len": f"WITH {_P}, z AS (SELECT * REPLACE ((trip_id * 1000 + coalesce(dayofyear(make_timestamp(us)), 0))::INT AS trip_id) FROM v) SELECT seq, trip_id FROM ({_LONG.format(t='z')})",
    "point_order": f"WITH {_PLAIN} SELECT seq, trip_id, pos FROM o",
    "traj_edges": f"WITH {_PLAIN}, n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM o WINDOW w AS (PARTITION BY trip_id ORDER BY pos)) SELECT trip_id || '_' || pos AS src, trip_id || '_' || (pos + 1) AS dst, round({hav('lat', 'lon', 'lat2', 'lon2')}, 3) AS dist_m FROM n WHERE lat2 IS NOT NULL",
    "cell_nodes": f"WITH {_F} SELECT node_id, round(lat, 7) AS lat, round(lon, 7) AS lon, TRUE AS off_road, us AS first_us FROM nodes",
    "cell_edges": f"WITH {_F} SELECT src, dst, dist_m FROM edges",
    "hex_cells": f"WITH {_PLAIN}, {_HEX} SELECT '7:' || fq::BIGINT || ':' || fr::BIGINT AS cell, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM hx GROUP BY ALL",
    "edge_canonical": "WITH r AS (SELECT o_orderkey AS seq, 'n' || (o_custkey % 97) AS a, 'n' || (o_orderkey % 89) AS b, o_totalprice::DOUBLE AS w FROM orders) SELECT least(a, b) AS src, greatest(a, b) AS dst, arg_min(w, seq) AS dist_m FROM r WHERE a <> b GROUP BY ALL",
    "node_distinct": "SELECT 'n' || (o_custkey % 97) AS node_id, arg_min(o_totalprice::DOUBLE, o_orderkey) AS lat FROM orders GROUP BY ALL",
    "bound_edges": f"WITH {_C} SELECT src, dst, dist_m FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE lat < 50.5) AND dst IN (SELECT node_id FROM nodes WHERE lat < 50.5)",
    "avg_edge_len": f"WITH {_F} SELECT round(avg(dist_m), 3) AS avg_edge_len_m, count(*) AS edge_count FROM edges",
    "bbox_density": f"WITH {_F}, b AS (SELECT count(*) AS node_count, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM nodes), s AS (SELECT *, {hav('((min_lat + max_lat) / 2)', 'min_lon', '((min_lat + max_lat) / 2)', 'max_lon')} AS w, {hav('min_lat', 'min_lon', 'max_lat', 'min_lon')} AS h FROM b) SELECT node_count, round(min_lat, 6) AS min_lat, round(max_lat, 6) AS max_lat, round(min_lon, 6) AS min_lon, round(max_lon, 6) AS max_lon, round(node_count / (w * h / 1e6), 6) AS density_km2, round(w, 3) AS width_m, round(h, 3) AS height_m FROM s",
    "avg_degree": f"WITH {_F} SELECT round(2.0::DOUBLE * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 6) AS avg_degree",
    "degrees": f"WITH {_F} SELECT u AS node_id, count(*) AS degree FROM adj GROUP BY u",
    "clustering": f"WITH {_C}, g AS (SELECT u AS node_id, count(*) AS degree FROM adj GROUP BY u), t AS (SELECT a.u AS node_id, count(*) AS triangles FROM adj a JOIN adj b ON b.u = a.u AND a.v < b.v JOIN edges e ON e.src = a.v AND e.dst = b.v GROUP BY a.u) SELECT node_id, coalesce(degree, 0) AS degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN coalesce(degree, 0) < 2 THEN 0 ELSE 2.0::DOUBLE * coalesce(triangles, 0) / (degree * (degree - 1)) END, 6) AS local FROM nodes LEFT JOIN g USING (node_id) LEFT JOIN t USING (node_id)",
    "components": f"{_W}{_F}, {_LABELS} SELECT id AS node_id, c AS component FROM cc",
    "component_rank": f"{_W}{_F}, {_LABELS}, {_SIZES} SELECT component, size, row_number() OVER (ORDER BY size DESC, component) - 1 AS component_id FROM sz",
    "component_prune": f"{_W}{_F}, {_LABELS}, {_SIZES}, k AS (SELECT id FROM cc JOIN sz ON component = c WHERE size >= greatest(1, floor((SELECT count(*) FROM nodes) * 20.2 / 100)) OR (SELECT count(*) FROM sz) <= 1) SELECT id AS node_id, 'node' AS kind FROM k UNION ALL SELECT src || '|' || dst, 'edge' FROM edges JOIN k ON id = src",
    "road_components": f"{_W}{_P}, {_FOLD}, kp AS (SELECT o.* EXCLUDE (rn) FROM o JOIN f USING (seq) WHERE keep), d1 AS ({_FIRST.format(t='kp')}), l1 AS ({_LONG.format(t='d1')}), o1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY us NULLS LAST, seq) - 1 AS pos FROM l1), {_merged(FINE, 'o1')}, {_LABELS}, {_SIZES}, rk AS (SELECT component, row_number() OVER (ORDER BY size DESC, component) - 1 AS component_id FROM sz) SELECT component_id, count(*) AS n_nodes, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat FROM cc JOIN nodes ON node_id = id JOIN rk ON component = c GROUP BY component_id",
    "reach": f"{_W}{_C}, {_dist('nodes', _NEAR)} SELECT s AS src, t AS dst, round(d, 3) AS dist_m FROM r",
    "coverage_gain": f"{_W}{_C}, {_dist('nodes', _NEAR)} SELECT s AS node_id, count(*) AS gain FROM r WHERE t IN (SELECT node_id FROM nodes WHERE lat > 50) GROUP BY s",
    "nearest_station": f"{_W}{_C}, fx AS (SELECT node_id FROM nodes WHERE lat > 50 AND lon > 17.1), {_dist('fx', _NEAR)} SELECT node_id, round(coalesce(min(d), -1), 3) AS dist_m FROM nodes LEFT JOIN r ON t = node_id GROUP BY node_id",
    "eccentricity_sampled": f"{_W}{_C}, fx AS (SELECT node_id FROM nodes ORDER BY md5(node_id || ':0'), node_id LIMIT 50), {_dist('fx')} SELECT s AS node_id, round(max(d), 3) AS ecc FROM r GROUP BY s",
    "csv_parse": f"WITH {_P} SELECT seq, CASE WHEN seq % 13 = 0 THEN 1 ELSE trip_id END AS trip_id, lat, lon, us FROM p WHERE seq % 17 <> 0 AND seq % 19 <> 0",
    "in_polygon": f"WITH {_P}, ring(i, x1, y1, x2, y2) AS (VALUES {_RINGSQL}) SELECT seq, lat, lon FROM v WHERE {_INSIDE.format(lat='v.lat', lon='v.lon')}",
    "pair_distance": f"WITH {_P} SELECT seq, round({hav('lat', 'lon', '48.1::DOUBLE', '17.1::DOUBLE')}, 3) AS dist_m FROM v",
    "city_edges": f"WITH {_CITY} SELECT src, dst, dist_m FROM edges",
    "city_nodes": f"{_W}{_CITY}, {_LABELS}, {_SIZES} SELECT node_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM nodes JOIN cc ON id = node_id JOIN sz ON component = c WHERE size >= greatest(1, floor((SELECT count(*) FROM nodes) * 0.2 / 100)) OR (SELECT count(*) FROM sz) <= 1",
    "graph_summaries": "SELECT c_custkey AS graph_id, c_name AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS node_count, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS edge_count, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS station_count FROM customer",
}
QUERIES = {
    f.__name__: f
    for f in (
        coord_filter, trip_sizes, speed_filter, clean_trips, dedup, min_len, point_order, traj_edges, cell_nodes, cell_edges, hex_cells, edge_canonical, node_distinct, bound_edges,
        avg_edge_len, bbox_density, avg_degree, degrees, clustering, components, component_rank, component_prune, road_components, coverage_gain, nearest_station,
        eccentricity_sampled, csv_parse, in_polygon, pair_distance, city_edges, city_nodes, graph_summaries,
    )
} | {"reach": graph_reach}
