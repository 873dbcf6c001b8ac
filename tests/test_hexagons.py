"""Hierarchical cells: published cells, round trips on the whole globe, and the hierarchy's own rules."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from roadloom.functions import hexagons as H
from roadloom.functions.geo import haversine


def everywhere(spark, n=3000):
    """Points all over, and some close to the twelve pentagons."""
    free = spark.range(n).select(F.degrees(F.asin(F.rand(1) * 2 - 1)).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    ico = H._icosahedron()
    rows = [ico.point(*ico.home[b][3][:2]) for b in ico.pentagons]
    near = spark.createDataFrame([(math.degrees(math.asin(z)), math.degrees(math.atan2(y, x))) for x, y, z in rows], "la double, lo double")
    near = near.select("la", "lo", F.explode(F.sequence(F.lit(1), F.lit(60))))
    return free.unionByName(near.select((F.col("la") + F.rand(3) * 4 - 2).alias("lat"), (F.col("lo") + F.rand(4) * 4 - 2).alias("lon")))


def test_published_cells(spark):
    known = [(37.769377, -122.388903, 9, "89283082e73ffff"), (37.3615593, -122.0553238, 7, "87283472bffffff"), (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"), (40.689167, -74.044444, 10, "8a2a1072b59ffff")]
    for lat, lon, resolution, text in known:
        r = spark.createDataFrame([(lat, lon)], "lat double, lon double").select(H.cell(F.col("lat"), F.col("lon"), resolution).alias("c"))
        r = r.select(H.text_of(F.col("c")).alias("t"), (H.cell_of_text(F.lit(text)) == F.col("c")).alias("same"), H.resolution_of(F.col("c")).alias("r")).collect()[0]
        assert (r.t, r.same, r.r) == (text, True, resolution)


def test_tables_of_the_icosahedron():
    ico = H._icosahedron()
    centres = [ico.point(*ico.home[b][3][:2]) for b in range(122)]
    assert len({tuple(round(v, 6) for v in p) for p in centres}) == 122
    assert ico.pentagons == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
    # Base cells are numbered from north to south.
    assert all(p[2] > q[2] - 1e-9 for p, q in zip(centres, centres[1:], strict=False))


@pytest.mark.parametrize("resolution", [0, 1, 4, 15])
def test_middle_lies_in_its_cell(spark, resolution):
    c = everywhere(spark).select("lat", "lon", H.cell(F.col("lat"), F.col("lon"), resolution).alias("c")).withColumn("m", H.centre(F.col("c")))
    c = c.withColumn("d", haversine(F.col("lat"), F.col("lon"), F.col("m.lat"), F.col("m.lon")))
    got = c.agg(F.count_if(H.cell(F.col("m.lat"), F.col("m.lon"), resolution) != F.col("c")).alias("lost"), F.max("d").alias("far"), F.count_if(F.col("c").isNull()).alias("none")).collect()[0]
    # Cells are at most about a quarter larger than on average across.
    assert (got.lost, got.none) == (0, 0) and got.far < 1_107_712 / 7 ** (resolution / 2) * 1.4


@pytest.mark.parametrize("resolution", [0, 1])
def test_parents_and_children(spark, resolution):
    c = everywhere(spark).select(H.cell(F.col("lat"), F.col("lon"), resolution).alias("c")).distinct().withColumn("kids", H.children(F.col("c"), resolution + 2))
    own = F.when(H.is_pentagon(F.col("c")), 41).otherwise(49)
    rows = c.select("c", (F.size("kids") == own).alias("all"), F.explode("kids").alias("k"))
    rows = rows.withColumn("m", H.centre(F.col("k"))).select("c", "all", "k", (H.parent(F.col("k"), resolution) == F.col("c")).alias("up"), (H.cell(F.col("m.lat"), F.col("m.lon"), resolution + 2) == F.col("k")).alias("there"))
    got = rows.agg(F.bool_and("all"), F.bool_and("up"), F.bool_and("there"), F.count("*") == F.countDistinct("k")).collect()[0]
    assert list(got) == [True, True, True, True]


def test_every_cell_of_a_resolution_is_a_child_of_a_base_cell(spark):
    base = spark.range(122).select((F.lit(1 << 59 | H._unused(0)) + F.col("id") * (1 << 45)).cast("long").alias("c"))
    for resolution in (1, 2):
        assert base.select(F.explode(H.children(F.col("c"), resolution)).alias("k")).distinct().count() == 2 + 120 * 7**resolution


@pytest.mark.parametrize("resolution", [0, 1, 8])
def test_neighbours(spark, resolution):
    """Six of them, five around a pentagon, each a neighbour back and no farther than two cells' sizes."""
    if resolution <= 2:
        base = spark.range(122).select((F.lit(1 << 59 | H._unused(0)) + F.col("id") * (1 << 45)).cast("long").alias("c"))
        cells = base.select(F.explode(H.children(F.col("c"), resolution)).alias("c"))
    else:
        cells = everywhere(spark, 1000).select(H.cell(F.col("lat"), F.col("lon"), resolution).alias("c")).distinct()
    cells = cells.withColumn("near", H.neighbours(F.col("c"), resolution))
    sides = F.when(H.is_pentagon(F.col("c")), 5).otherwise(6)
    rows = cells.select("c", (F.size("near") == sides).alias("all"), F.explode("near").alias("o"))
    rows = rows.select("all", F.array_contains(H.neighbours(F.col("o"), resolution), F.col("c")).alias("back"), (F.col("c") != F.col("o")).alias("other"))
    got = rows.agg(F.bool_and("all"), F.count_if(~F.col("back")), F.bool_and("other")).collect()[0]
    assert list(got) == [True, 0, True]


def test_odd_values(spark):
    rows = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("inf")), (90.0, 0.0), (-90.0, 180.0), (0.0, 180.0), (0.0, -180.0)], "lat double, lon double")
    got = [r.c for r in rows.select(H.cell(F.col("lat"), F.col("lon"), 5).alias("c")).collect()]
    assert got[:4] == [None] * 4 and None not in got[4:] and got[6] == got[7]
    none = spark.range(1).select(F.lit(None).cast("long").alias("c"))
    r = none.select(H.centre(F.col("c")).alias("m"), H.parent(F.col("c"), 3).alias("p"), H.children(F.col("c"), 3).alias("k"), H.neighbours(F.col("c"), 3).alias("o")).collect()[0]
    assert list(r) == [None] * 4
    coarse = rows.where("lat = 90").select(H.cell(F.col("lat"), F.col("lon"), 5).alias("c"))
    assert list(coarse.select(H.parent(F.col("c"), 6), H.children(F.col("c"), 4), H.neighbours(F.col("c"), 4)).collect()[0]) == [None] * 3
    with pytest.raises(ValueError):
        H.cell(F.col("lat"), F.col("lon"), 16)
