from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roadloom.operators.city import SEGMENTS
from roadloom.operators.gazetteer import SETTLEMENTS, boundary_by_name, find_settlements, plain_name
from roadloom.plans.service import RoadService


def town(name, country, size, x=17.0, box=True):
    ring = [(x, 48.0), (x + 0.1, 48.0), (x + 0.1, 48.1), (x, 48.1)]
    return (name, [ring], *((48.0, 48.1, x, x + 0.1) if box else (None,) * 4), country, size)


TOWNS = [
    town("Bratislava", "sk", 475_000), town("Žilina", "sk", 82_000, 18.0), town("Zlín", "cz", 74_000, 19.0), town("Nové Mesto", "sk", 20_000, 20.0), town("Nové Mesto", "cz", 10_000, 21.0), town("Nové Mesto", "cz", 12_000, 22.0, False),
    town("Großkrut", "at", 1600), town(None, "sk", 5), town("", "sk", 5), town("–", "sk", 5), town("Wien", None, None),
]


def test_names(spark):
    rows = spark.createDataFrame([("Žilina", "zilina"), ("  Nové-Mesto (nad Váhom)", "nove mesto nad vahom"), ("GROSSKRUT", "grosskrut"), ("Großkrut", "grosskrut"), ("Ångström Łódź", "angstrom łodz"), (None, None), ("!?", "")], "name string, want string")
    assert all(r["got"] == r["want"] for r in rows.select("*", plain_name(F.col("name")).alias("got")).collect())


def test_find(spark):
    towns = spark.createDataFrame(TOWNS, SETTLEMENTS)
    asked = [("bratislva", None), ("ŽILINA", None), ("zilina", "cz"), ("nove mesto", None), ("nove mesto", "cz"), ("grosskrutt", "at"), ("qqqq", None), ("", None), (None, None), ("Wien", None), ("wien", "at")]
    queries = spark.createDataFrame([*asked, asked[0]], "query string, country string")
    got = {(r["query"], r["asked_country"]): (r["name"], r["country"], r["size"], round(r["score"], 3)) for r in find_settlements(queries, towns).collect()}
    assert got == {
        ("bratislva", None): ("Bratislava", "sk", 475_000, 0.737), ("ŽILINA", None): ("Žilina", "sk", 82_000, 1.0), ("nove mesto", None): ("Nové Mesto", "sk", 20_000, 1.0),
        ("nove mesto", "cz"): ("Nové Mesto", "cz", 12_000, 1.0), ("grosskrutt", "at"): ("Großkrut", "at", 1600, 0.842), ("Wien", None): ("Wien", None, 0, 1.0),
    }
    both = find_settlements(spark.createDataFrame([("nove mesto", None)], "query string, country string"), towns, 5).orderBy("rank").collect()
    assert [(r["rank"], r["country"]) for r in both] == [(1, "sk"), (2, "cz")]
    assert find_settlements(queries.limit(0), towns).count() == 0 and find_settlements(queries, towns.limit(0)).count() == 0


def test_city_by_name(spark, tmp_path):
    spark.createDataFrame(TOWNS, SETTLEMENTS).write.parquet(f"file://{tmp_path}/towns")
    b = boundary_by_name(spark, f"file://{tmp_path}/towns", "Zilna")
    assert (b.min_lon, b.max_lat, len(b.rings)) == (18.0, 48.1, 1)
    assert boundary_by_name(spark, f"file://{tmp_path}/towns", "nove mesto", "cz").min_lon == 22.0
    with pytest.raises(ValueError, match="city not found"):
        boundary_by_name(spark, f"file://{tmp_path}/towns", "Zilina", "at")
    rows = [(1, 10, 11, True, True, "ROAD", [(48.05, 18.01), (48.06, 18.02), (48.07, 18.03)]), (2, 20, 21, True, True, "ROAD", [(48.05, 17.01), (48.06, 17.02)])]
    spark.createDataFrame(rows, SEGMENTS).write.parquet(f"file://{tmp_path}/segments")
    g = RoadService(spark, f"file://{tmp_path}/graphs").import_city_by_name(f"file://{tmp_path}/segments", f"file://{tmp_path}/towns", "žilina", 1)
    assert sorted(r["node_id"] for r in g.nodes.collect()) == ["10", "11", "1_p1"]
