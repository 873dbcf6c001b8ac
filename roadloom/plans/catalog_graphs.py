"""Queries of exact metrics, placement and map matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.geo import haversine
from roadloom.operators import matching, metrics, placement, reach, trips
from roadloom.operators.road_graph import Graph
from roadloom.plans.catalog import _C, _LABELS, _NEAR, _PLAIN, _W, COARSE, RADIUS, K, _dist, _graph, _plain, hav
from roadloom.plans.config import PlacementRequest
from roadloom.plans.staging import staged

SEED, RUNS = 7, 3
MATCH = dict(reach_m=1200.0, sigma_m=300.0, beta_m=500.0, detour=2.0, slack_m=3000.0)


def eccentricity(s: SparkSession, d: str) -> DataFrame:
    return metrics.eccentricities(_graph(s, d, COARSE)).select("node_id", F.round("ecc", 3).alias("ecc"))


def graph_metrics(s, d):
    m = metrics.compute_metrics(_graph(s, d, COARSE))
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes])


def treewidth(s, d):
    g = _graph(s, d, COARSE)
    return metrics.treewidth_bound(g, metrics.components_of(g))


def _placed(s, d, algorithm):
    p = placement.place(_graph(s, d, COARSE), PlacementRequest(algorithm, K, RADIUS, RUNS, seed=SEED))
    return p.stations.select("node_id", "rank", F.lit(p.objective).cast("long").alias("objective"), F.lit(p.total_nodes).cast("long").alias("total_nodes"))


def place_greedy(s, d):
    return _placed(s, d, "GREEDY")


def place_random(s, d):
    return _placed(s, d, "RANDOM")


def place_grasp(s, d):
    return _placed(s, d, "GRASP")


def _half_covered(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = _graph(s, d, COARSE)
    return g.nodes, staged(reach.bounded_reach(g, RADIUS), "reach"), g.nodes.where("lat > 50")


def coverage_counts(s, d):
    """By how many of the northern nodes, as stations, each node is covered."""
    _, table, stations = _half_covered(s, d)
    return placement._coverage(table, stations.select(F.lit(0).alias("run"), F.col("node_id").alias("node"))).select(F.col("node").alias("node_id"), "n")


def under_covered(s, d):
    nodes, table, stations = _half_covered(s, d)
    return placement.under_covered(table, nodes, stations, K)


def redundant_removed(s, d):
    """What is left of all nodes, as stations, without redundant ones."""
    nodes, table, _ = _half_covered(s, d)
    return placement.remove_redundant(table, nodes.select(F.lit(0).alias("run"), F.col("node_id").alias("node")), K).select(F.col("node").alias("node_id"))


def swaps(s, d):
    """Swaps that free a station, from the stations that the random search finds."""
    nodes, table, _ = _half_covered(s, d)
    found = staged(placement.remove_redundant(table, placement.random_runs(table, nodes, K, 1, SEED).select("run", "node"), K), "found")
    return placement.swap_round(table, found, K).select("out", "into")


def restricted_list(s, d):
    """The first restricted candidate list of the randomised search, over all nodes."""
    nodes, table, _ = _half_covered(s, d)
    gains = reach.coverage_gain(table, nodes).select(F.lit(0).alias("run"), F.col("node_id").alias("node"), F.col("gain").alias("g"))
    return placement.restricted(gains, 0.3, 200, 0, SEED).select(F.col("node").alias("node_id"), F.col("g").alias("gain"))


def lattice(s: SparkSession, d: str) -> Graph:
    """Roads from each coarse cell that holds a point to those next to it."""
    cell = lambda c: F.floor(F.round(F.col(c) * 1e6) / COARSE).cast("long")
    at = _plain(s, d).select(cell("lat").alias("y"), cell("lon").alias("x")).distinct()
    name = lambda y, x: F.concat_ws("_", y, x)
    nodes = at.select(name(F.col("y"), F.col("x")).alias("node_id"), ((F.col("y") + 0.5) * (COARSE / 1e6)).alias("lat"), ((F.col("x") + 0.5) * (COARSE / 1e6)).alias("lon"), F.lit(False).alias("off_road"), F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"))
    nodes = staged(nodes, "nodes")
    pairs = at.select(name(F.col("y"), F.col("x")).alias("m"), F.explode(F.array(name(F.col("y") + 1, F.col("x")), name(F.col("y"), F.col("x") + 1))).alias("n"))
    end = lambda k: nodes.select(F.col("node_id").alias(k), F.col("lat").alias(f"{k}lat"), F.col("lon").alias(f"{k}lon"))
    rows = pairs.join(end("m"), "m").join(end("n"), "n")
    dist = F.round(haversine(F.col("mlat"), F.col("mlon"), F.col("nlat"), F.col("nlon")), 3)
    return Graph(nodes, staged(rows.select(F.least("m", "n").alias("src"), F.greatest("m", "n").alias("dst"), dist.alias("dist_m")), "edges"))


def map_match(s, d):
    """The place of each point of all trips on a lattice of roads."""
    found = matching.RoadMatcher(lattice(s, d), **MATCH).match_points(trips.numbered(_plain(s, d)))
    return found.select("trip_id", F.col("pos").cast("long").alias("pos"), "a", "b", F.round("t", 6).alias("t"))


def map_match_lines(s, d):
    """How long the road geometry of each matched trip is."""
    line = matching.RoadMatcher(lattice(s, d), **MATCH).match_steps(trips.numbered(_plain(s, d)))
    along = F.when(F.col("before").isNull(), F.col("line")).otherwise(F.concat(F.array("before"), "line"))
    pairs = line.select("trip_id", along.alias("p")).where(F.size("p") > 1).select("trip_id", F.inline(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("u"), F.slice("p", F.lit(2), F.size("p") - 1).alias("v"))))
    steps = pairs.toDF("trip_id", "u", "v").select("trip_id", haversine(F.col("u.lat"), F.col("u.lon"), F.col("v.lat"), F.col("v.lon")).alias("m"))
    return steps.groupBy("trip_id").agg(F.count("*").alias("n_steps"), F.round(F.sum("m"), 0).alias("length_m"))


_R = f"{_W}{_C}, {_dist('nodes', _NEAR)}"
_TW = """tw(step, comp, u, v) AS (SELECT 0, c, u, v FROM adj JOIN cc ON id = u
  UNION ALL (WITH g AS (SELECT comp, u, count(*) AS n FROM tw GROUP BY ALL), x AS (SELECT comp, u AS x FROM g QUALIFY row_number() OVER (PARTITION BY comp ORDER BY n, u) = 1),
    near AS (SELECT tw.comp, tw.v FROM tw JOIN x ON tw.u = x.x AND tw.comp = x.comp)
    SELECT (SELECT max(step) FROM tw) + 1, comp, u, v FROM (SELECT tw.comp, u, v FROM tw JOIN x ON tw.comp = x.comp WHERE u <> x AND v <> x UNION SELECT a.comp, a.v, b.v FROM near a JOIN near b ON a.comp = b.comp AND a.v <> b.v))),
wd AS (SELECT comp, max(n) AS width FROM (SELECT step, comp, min(n) AS n FROM (SELECT step, comp, u, count(*) AS n FROM tw GROUP BY ALL) GROUP BY ALL) GROUP BY comp)"""
_ECC = "ec AS (SELECT s, max(d) AS ecc FROM r GROUP BY s)"
_GREEDY = f"""gs(step, node, n, gain) AS (SELECT 0, node_id, 0::BIGINT, NULL::BIGINT FROM nodes
  UNION ALL SELECT g.step + 1, g.node, g.n + CASE WHEN r.t IS NULL THEN 0 ELSE 1 END, CASE WHEN g.node = b.node THEN b.g ELSE g.gain END
    FROM gs g CROSS JOIN (SELECT c.node, count(*) AS g FROM gs c JOIN r ON r.s = c.node JOIN gs o ON o.node = r.t AND o.n < {K} WHERE c.gain IS NULL AND c.n < {K} GROUP BY c.node ORDER BY g DESC, c.node LIMIT 1) b
    LEFT JOIN r ON r.s = b.node AND r.t = g.node)"""


def _random(runs: int) -> str:
    return f"""od AS MATERIALIZED (SELECT run, node_id AS node, md5(run || ':' || node_id || ':{SEED}') AS h, row_number() OVER (PARTITION BY run ORDER BY md5(run || ':' || node_id || ':{SEED}'), node_id) AS i FROM nodes, range({runs}) t(run)),
rr(i, run, node, n, st) AS (SELECT 0::BIGINT, run, node, 0::BIGINT, FALSE FROM od
  UNION ALL SELECT q.i + 1, q.run, q.node, q.n + CASE WHEN r.t IS NOT NULL AND c.n < {K} THEN 1 ELSE 0 END, q.st OR (q.node = c.node AND c.n < {K})
    FROM rr q JOIN (SELECT x.run, x.node, x.n FROM rr x JOIN od ON od.run = x.run AND od.node = x.node AND od.i = x.i + 1) c ON c.run = q.run LEFT JOIN r ON r.s = c.node AND r.t = q.node)"""


_LAST = "(SELECT run, node FROM rr WHERE i = (SELECT max(i) FROM rr) AND st)"


def _removal(start: str) -> str:
    """Rounds of :func:`placement.remove_redundant`, from stations (node) of one run."""
    return f"""rd(i, node) AS (SELECT 0, node FROM {start}
  UNION ALL (WITH cv AS (SELECT t, count(*) AS n FROM rd JOIN r ON r.s = rd.node GROUP BY t), sp AS (SELECT rd.node FROM rd JOIN r ON r.s = rd.node JOIN cv USING (t) GROUP BY rd.node HAVING min(cv.n) > {K}),
    gone AS (SELECT a.node FROM sp a WHERE NOT EXISTS (SELECT 1 FROM sp b JOIN r x ON x.s = b.node JOIN r y ON y.s = a.node AND y.t = x.t WHERE b.node < a.node))
    SELECT i + 1, node FROM rd WHERE node NOT IN (SELECT node FROM gone) AND EXISTS (SELECT 1 FROM gone))),
rm AS MATERIALIZED (SELECT node FROM rd WHERE i = (SELECT max(i) FROM rd))"""


_SWAPS = f"""cv AS MATERIALIZED (SELECT t, count(*) AS n FROM rm JOIN r ON r.s = rm.node GROUP BY t),
c0 AS (SELECT rm.node AS out, r.t AS into_ FROM rm JOIN r ON r.s = rm.node WHERE r.t NOT IN (SELECT node FROM rm)),
c1 AS MATERIALIZED (SELECT out, into_ FROM c0 JOIN r ON r.s = out JOIN cv ON cv.t = r.t LEFT JOIN r i ON i.s = into_ AND i.t = r.t GROUP BY out, into_ HAVING bool_and(i.t IS NOT NULL OR n > {K})),
sw AS MATERIALIZED (SELECT out, into_, rm.node AS other, {{'i': into_, 'o': out, 'x': rm.node}} AS key_ FROM c1 JOIN rm ON rm.node <> out JOIN r ON r.s = rm.node JOIN cv ON cv.t = r.t LEFT JOIN r o ON o.s = out AND o.t = r.t LEFT JOIN r i ON i.s = into_ AND i.t = r.t
  GROUP BY out, into_, rm.node HAVING min(n - CASE WHEN o.t IS NULL THEN 0 ELSE 1 END + CASE WHEN i.t IS NULL THEN 0 ELSE 1 END) > {K}),
tc AS MATERIALIZED (SELECT DISTINCT key_, t FROM sw JOIN r ON r.s IN (into_, out, other)), fs AS (SELECT t, min(key_) AS key_ FROM tc GROUP BY t)"""
_M = MATCH
_LATTICE = f"""{_PLAIN}, cl AS (SELECT DISTINCT y // {COARSE} AS y, x // {COARSE} AS x FROM o),
nodes AS MATERIALIZED (SELECT y || '_' || x AS node_id, (y + 0.5::DOUBLE) * {COARSE / 1e6!r}::DOUBLE AS lat, (x + 0.5::DOUBLE) * {COARSE / 1e6!r}::DOUBLE AS lon FROM cl),
pr AS (SELECT y || '_' || x AS m, (y + 1) || '_' || x AS n FROM cl UNION ALL SELECT y || '_' || x, y || '_' || (x + 1) FROM cl),
edges AS MATERIALIZED (SELECT least(m, n) AS src, greatest(m, n) AS dst, round({hav("a.lat", "a.lon", "b.lat", "b.lon")}, 3) AS dist_m FROM pr JOIN nodes a ON a.node_id = m JOIN nodes b ON b.node_id = n),
adj AS MATERIALIZED (SELECT src AS u, dst AS v, dist_m AS w FROM edges UNION ALL SELECT dst, src, dist_m FROM edges),
pe AS (SELECT src, dst, dist_m AS len, a.lat AS alat, a.lon AS alon, b.lat - a.lat AS dlat, b.lon - a.lon AS dlon FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst),
pj AS (SELECT trip_id, pos, lat, lon, src, dst, len, alat, alon, dlat, dlon, greatest(0, least(1, ((lon - alon) * cos(radians(lat)) * dlon * cos(radians(lat)) + (lat - alat) * dlat) / (dlon * cos(radians(lat)) * dlon * cos(radians(lat)) + dlat * dlat))) AS t
  FROM o JOIN pe ON lat BETWEEN least(alat, alat + dlat) - 0.05 AND greatest(alat, alat + dlat) + 0.05 AND lon BETWEEN least(alon, alon + dlon) - 0.05 AND greatest(alon, alon + dlon) + 0.05),
fd AS MATERIALIZED (SELECT *, src || '|' || dst AS p FROM (SELECT trip_id, pos, lat, lon, src, dst, len, t, {hav("lat", "lon", "(alat + t * dlat)", "(alon + t * dlon)")} AS off FROM pj) WHERE off <= {_M["reach_m"]}),
ln AS (SELECT a.trip_id, a.pos, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS line FROM o a JOIN o b ON b.trip_id = a.trip_id AND b.pos = a.pos + 1),
{_dist("nodes", "WHERE r.d + a.w <= 60000")},
en AS MATERIALIZED (SELECT *, src AS e, t * len AS ed FROM fd UNION ALL SELECT *, dst, (1 - t) * len FROM fd),
wy AS (SELECT x.trip_id, x.pos, x.p AS p, y.p AS q, y.off, min(CASE WHEN x.p = y.p THEN abs(y.t - x.t) * x.len ELSE x.ed + r.d + y.ed END) AS m FROM en x JOIN en y ON y.trip_id = x.trip_id AND y.pos = x.pos + 1 JOIN r ON r.s = x.e AND r.t = y.e GROUP BY ALL),
sp AS MATERIALIZED (SELECT wy.trip_id, wy.pos + 1 AS pos, p, q, round(abs(m - line) / {_M["beta_m"]}::DOUBLE + 0.5::DOUBLE * pow(off / {_M["sigma_m"]}::DOUBLE, 2), 6) AS cost FROM wy JOIN ln ON ln.trip_id = wy.trip_id AND ln.pos = wy.pos WHERE m <= line * {_M["detour"]}::DOUBLE + {_M["slack_m"]}::DOUBLE),
vt(trip_id, pos, p, via, total) AS (SELECT trip_id, pos, p, NULL::VARCHAR, round(0.5::DOUBLE * pow(off / {_M["sigma_m"]}::DOUBLE, 2), 6) FROM fd WHERE pos = 0
  UNION ALL SELECT x.trip_id, x.pos, x.q, arg_min(x.p, (x.total, x.p)), min(x.total) FROM (SELECT sp.trip_id, sp.pos, sp.p, sp.q, vt.total + sp.cost AS total FROM vt JOIN sp ON sp.trip_id = vt.trip_id AND sp.pos = vt.pos + 1 AND sp.p = vt.p) x GROUP BY x.trip_id, x.pos, x.q),
ve AS MATERIALIZED (SELECT * FROM vt),
nd AS (SELECT trip_id, max(pos) AS pos FROM o GROUP BY trip_id),
bk(trip_id, pos, p, via) AS (SELECT trip_id, pos, arg_min(p, (total, p)), arg_min(coalesce(via, ''), (total, p)) FROM ve JOIN nd USING (trip_id, pos) GROUP BY trip_id, pos
  UNION ALL SELECT ve.trip_id, ve.pos, ve.p, ve.via FROM bk JOIN ve ON ve.trip_id = bk.trip_id AND ve.pos = bk.pos - 1 AND ve.p = bk.via)"""
ORACLES = {
    "eccentricity": f"{_W}{_C}, {_dist('nodes')}, {_ECC} SELECT s AS node_id, round(ecc, 3) AS ecc FROM ec",
    "treewidth": f"{_W}{_C}, {_LABELS}, {_TW} SELECT c AS component, max(coalesce(width, 0))::INT AS width FROM cc LEFT JOIN wd ON comp = c GROUP BY c",
    "graph_metrics": f"""{_W}{_C}, {_LABELS}, {_TW}, {_dist('nodes')}, {_ECC},
g AS (SELECT u AS node_id, count(*) AS degree FROM adj GROUP BY u), t AS (SELECT a.u AS node_id, count(*) AS triangles FROM adj a JOIN adj b ON b.u = a.u AND a.v < b.v JOIN edges e ON e.src = a.v AND e.dst = b.v GROUP BY a.u),
cl AS (SELECT avg(CASE WHEN coalesce(degree, 0) < 2 THEN 0 ELSE 2.0::DOUBLE * coalesce(triangles, 0) / (degree * (degree - 1)) END) AS clustering FROM nodes LEFT JOIN g USING (node_id) LEFT JOIN t USING (node_id)),
bb AS (SELECT count(*) AS n, min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1 FROM nodes),
bs AS (SELECT *, {hav('((y0 + y1) / 2)', 'x0', '((y0 + y1) / 2)', 'x1')} * {hav('y0', 'x0', 'y1', 'x0')} / 1e6 AS area FROM bb)
SELECT n AS node_count, (SELECT count(*) FROM edges) AS edge_count, round(2.0::DOUBLE * (SELECT count(*) FROM edges) / n, 6) AS avg_degree, round((SELECT max(ecc) FROM ec), 6) AS diameter_m, round(clustering, 6) AS clustering,
  round((SELECT avg(dist_m) FROM edges), 6) AS avg_edge_len_m, round(n / area, 6) AS density_km2, (SELECT count(DISTINCT c) FROM cc) AS components, round((SELECT min(ecc) FROM ec WHERE ecc > 0), 6) AS radius_m, (SELECT max(width)::INT FROM wd) AS treewidth FROM bs, cl""",
    "place_greedy": f"{_R}, {_GREEDY}, pk AS (SELECT node, gain FROM gs WHERE step = (SELECT max(step) FROM gs) AND gain IS NOT NULL) SELECT node AS node_id, row_number() OVER (ORDER BY gain DESC, node)::INT AS rank, (SELECT count(*) FROM pk) AS objective, (SELECT count(*) FROM nodes) AS total_nodes FROM pk",
    "place_random": f"{_R}, {_random(RUNS)}, pk AS (SELECT run, node FROM {_LAST}), bt AS (SELECT run, count(*) AS size FROM pk GROUP BY run ORDER BY size, run LIMIT 1) SELECT node AS node_id, row_number() OVER (ORDER BY h, node)::INT AS rank, size AS objective, (SELECT count(*) FROM nodes) AS total_nodes FROM pk JOIN bt USING (run) JOIN od USING (run, node)",
    "coverage_counts": f"{_R} SELECT t AS node_id, count(*) AS n FROM r WHERE s IN (SELECT node_id FROM nodes WHERE lat > 50) GROUP BY t",
    "under_covered": f"{_R}, cv AS (SELECT t, count(*) AS n FROM r WHERE s IN (SELECT node_id FROM nodes WHERE lat > 50) GROUP BY t) SELECT node_id, coalesce(n, 0) AS n FROM nodes LEFT JOIN cv ON t = node_id WHERE coalesce(n, 0) < {K}",
    "redundant_removed": f"{_R}, {_removal('(SELECT node_id AS node FROM nodes)')} SELECT node AS node_id FROM rm",
    "swaps": f"{_R}, {_random(1)}, {_removal(f'(SELECT node FROM {_LAST})')}, {_SWAPS} SELECT DISTINCT out, into_ AS \"into\" FROM sw WHERE key_ NOT IN (SELECT a.key_ FROM tc a JOIN fs USING (t) WHERE a.key_ <> fs.key_)",
    "restricted_list": f"{_R}, gn AS (SELECT s AS node, count(*) AS g FROM r GROUP BY s), ev AS (SELECT * FROM gn ORDER BY md5(node || ':0:{SEED}:0'), node LIMIT 200) SELECT node AS node_id, g AS gain FROM ev WHERE g >= (SELECT ceil(round(max(g) - 0.3::DOUBLE * (max(g) - min(g)), 9)) FROM ev)",
    "map_match": f"{_W}{_LATTICE} SELECT trip_id, pos, src AS a, dst AS b, round(t, 6) AS t FROM bk JOIN fd USING (trip_id, pos, p)",
}
QUERIES = {f.__name__: f for f in (eccentricity, graph_metrics, treewidth, place_greedy, place_random, place_grasp, coverage_counts, under_covered, redundant_removed, swaps, restricted_list, map_match, map_match_lines)}
