"""Queries over hierarchical cells, with SQL that goes by angles and recursion where the library goes by vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from roadloom.functions import hexagons as H
from roadloom.operators import road_graph
from roadloom.plans import catalog
from roadloom.plans.staging import staged

FINE, WIDE = 9, 6


def hex_hierarchy(s, d):
    """Cells with their points, those of the cells around them, and of the wider cell that they belong to."""
    points = catalog._plain(s, d).select(H.cell(F.col("lat"), F.col("lon"), FINE).alias("c"), "lat", "lon")
    cells = staged(points.groupBy("c").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon")).withColumn("p", H.parent(F.col("c"), WIDE)), "cells")
    wide = cells.groupBy("p").agg(F.sum("n").alias("n_parent"), F.count("*").alias("cells_parent"))
    around = cells.select("c", F.explode(H.neighbours(F.col("c"), FINE)).alias("o")).join(cells.select(F.col("c").alias("o"), F.col("n").alias("m")), "o")
    around = around.groupBy("c").agg(F.sum("m").alias("n_around"))
    rows = cells.join(wide, "p").join(around, "c", "left")
    return rows.select(H.text_of(F.col("c")).alias("cell"), H.text_of(F.col("p")).alias("parent"), "n", "lat", "lon", F.coalesce("n_around", F.lit(0)).alias("n_around"), "n_parent", "cells_parent")


def hex_graph(s, d):
    """The road graph merged by the cells of a configuration, as the service builds it: its nodes."""
    config = road_graph.DEFAULTS.updated(cell_resolution=FINE)
    g = road_graph.merged_graph(road_graph.matched_points(catalog._plain(s, d), None), road_graph.cell_encoder(config))
    return g.nodes.select("node_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


def _tables() -> str:
    ico = H._icosahedron()
    faces = ", ".join(f"({f}, {lat!r}::DOUBLE, {lon!r}::DOUBLE, {az!r}::DOUBLE)" for f, (lat, lon, az) in enumerate(H.FACES))
    bases = ", ".join(f"({f}, {a}, {b}, {cell}, {turns})" for (f, a, b), (cell, turns) in sorted(ico.base.items()))
    digits = ", ".join(f"({d}, {a}, {b})" for d, a, b in ((0, 0, 0), (1, -1, -1), (2, 0, 1), (3, -1, 0), (4, 1, 0), (5, 0, -1), (6, 1, 1)))
    return f"faces(f, fla, flo, faz) AS (VALUES {faces}), bases(f, a, b, base, turns) AS (VALUES {bases}), digs(d, da, db) AS (VALUES {digits})"


_SIZE = repr(math.sqrt(7) ** FINE / H.UNIT)
_TILT = repr(math.asin(math.sqrt(3 / 28)) if FINE % 2 else 0.0)
#: Points with their lattice point, then all coarser ones, then digits turned to the base cell's plane (4 6 2 3 1 5 counterclockwise).
_CELLS = f"""{_tables()},
ang AS (SELECT seq, lat, lon, trip_id, pos, f, faz - atan2(sin(radians(lon) - flo) * cos(radians(lat)), cos(fla) * sin(radians(lat)) - sin(fla) * cos(radians(lat)) * cos(radians(lon) - flo)) - {_TILT}::DOUBLE AS th,
  sin(fla) * sin(radians(lat)) + cos(fla) * cos(radians(lat)) * cos(radians(lon) - flo) AS cs FROM o, faces),
near AS (SELECT * FROM ang QUALIFY row_number() OVER (PARTITION BY seq ORDER BY cs DESC) = 1),
xy AS (SELECT *, tan(acos(cs)) * {_SIZE}::DOUBLE * cos(th) AS x, tan(acos(cs)) * {_SIZE}::DOUBLE * sin(th) AS y FROM near),
ax AS (SELECT *, x - y / sqrt(3.0::DOUBLE) AS q, y * 2 / sqrt(3.0::DOUBLE) AS r FROM xy),
ar AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM ax),
ad AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM ar),
fx AS (SELECT *, (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT AS uq, (CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END)::BIGINT AS ur FROM ad),
spots AS MATERIALIZED (SELECT f, uq + ur AS a, ur AS b, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM fx GROUP BY ALL),
up AS (SELECT f, a AS a0, b AS b0, {FINE} AS lvl, a, b, []::INT[] AS ds FROM spots
  UNION ALL SELECT up.f, a0, b0, lvl - 1, ca, cb, list_prepend(d, ds) FROM (SELECT *, CASE WHEN lvl % 2 = 1 THEN round((3 * a - b) / 7.0::DOUBLE) ELSE round((2 * a + b) / 7.0::DOUBLE) END::BIGINT AS ca, CASE WHEN lvl % 2 = 1 THEN round((a + 2 * b) / 7.0::DOUBLE) ELSE round((3 * b - a) / 7.0::DOUBLE) END::BIGINT AS cb FROM up WHERE lvl > 0) up
  JOIN digs ON da = up.a - CASE WHEN lvl % 2 = 1 THEN 2 * ca + cb ELSE 3 * ca - cb END AND db = up.b - CASE WHEN lvl % 2 = 1 THEN 3 * cb - ca ELSE ca + 2 * cb END),
tops AS (SELECT up.f, a0, b0, base, ds, turns[coalesce(list_filter(ds, lambda x: x <> 0)[1], 0) + 1] AS t FROM up JOIN bases USING (f, a, b) WHERE lvl = 0),
own AS (SELECT f, a0 AS a, b0 AS b, base, list_transform(ds, lambda x: CASE WHEN x = 0 THEN 0 ELSE [4, 6, 2, 3, 1, 5][(list_position([4, 6, 2, 3, 1, 5], x) - 1 + t) % 6 + 1] END) AS ds FROM tops),
ids AS MATERIALIZED (SELECT f, a, b, {{id}} AS cell, {{wide}} AS parent FROM own)"""


def _id(resolution: int) -> str:
    digits = " + ".join([f"ds[{r}]::BIGINT * {8 ** (15 - r)}" for r in range(1, resolution + 1)])
    return f"lower(hex({1 << 59 | resolution << 52 | (1 << 3 * (15 - resolution)) - 1} + base::BIGINT * {1 << 45} + {digits}))"


_WITH = f"WITH RECURSIVE {catalog._PLAIN}, " + _CELLS.format(id=_id(FINE), wide=_id(WIDE))
ORACLES = {
    "hex_hierarchy": f"""{_WITH}, cells AS (SELECT * FROM spots JOIN ids USING (f, a, b)),
around AS (SELECT c.f, c.a, c.b, sum(o.n) AS n_around FROM cells c JOIN digs ON d > 0 JOIN cells o ON o.f = c.f AND o.a = c.a + da AND o.b = c.b + db GROUP BY ALL)
SELECT cell, parent, n, lat, lon, coalesce(n_around, 0)::BIGINT AS n_around, sum(n) OVER (PARTITION BY parent)::BIGINT AS n_parent, count(*) OVER (PARTITION BY parent) AS cells_parent FROM cells LEFT JOIN around USING (f, a, b)""",
    "hex_graph": f"{_WITH} SELECT CASE WHEN count(*) = 1 THEN min(trip_id || '_' || pos) ELSE 'cell_' || cell END AS node_id, round(avg(fx.lat), 7) AS lat, round(avg(fx.lon), 7) AS lon FROM fx JOIN ids ON ids.f = fx.f AND ids.a = uq + ur AND ids.b = ur GROUP BY cell",
}
QUERIES = {f.__name__: f for f in (hex_hierarchy, hex_graph)}
