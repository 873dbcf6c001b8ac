from __future__ import annotations

import pytest
from compare import connect, rows_of, rows_of_sql

from roadloom.plans import catalog, catalog_cells, catalog_files, catalog_graphs, catalog_roads

QUERIES = catalog.QUERIES | catalog_cells.QUERIES | catalog_files.QUERIES | catalog_graphs.QUERIES | catalog_roads.QUERIES
ORACLES = catalog.ORACLES | catalog_cells.ORACLES | catalog_files.ORACLES | catalog_graphs.ORACLES | catalog_roads.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    want = rows_of_sql(connect(sf), ORACLES[name], df.columns)
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_files_are_numbered_in_the_order_of_their_chunks(spark, sf, monkeypatch):
    """More than ten files, whose numbers are of different lengths."""
    monkeypatch.setattr(catalog_files, "CHUNK", 50)
    sql = ORACLES["csv_points"]
    assert "// 1000 AS chunk" in sql
    df = catalog_files.csv_points(spark, sf)
    assert rows_of(df) == rows_of_sql(connect(sf), sql.replace("// 1000 AS chunk", "// 50 AS chunk"), df.columns)


def test_city_of_any_size(spark, sf, monkeypatch):
    """The limit of an import doesn't hold for the query, whose SQL has none."""
    from roadloom.operators import city, metrics

    monkeypatch.setattr(city, "guard_size", lambda g, most: metrics.guard_size(g, 5))
    df = catalog.city_nodes(spark, sf)
    assert rows_of(df) == rows_of_sql(connect(sf), ORACLES["city_nodes"], df.columns)
