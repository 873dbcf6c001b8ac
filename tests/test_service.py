from __future__ import annotations

import pytest

from roadloom.operators.road_graph import graph_to_request
from roadloom.plans.config import PipelineConfig, PlacementRequest
from roadloom.plans.service import RoadService, response


def test_from_file_to_stations(spark, tmp_path):
    lines = ["lat,lon,timestamp,trip"] + [f"{48 + i * 0.001:.6f},17.1,2024-01-01T10:{i:02d}:00Z,{1 + i // 10}" for i in range(20)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    service = RoadService(spark, f"file://{tmp_path}/graphs")
    assert service.samples(str(tmp_path)) == ["a.csv"]
    graph = service.import_sample(str(tmp_path), "a.csv", 1)
    assert sorted(r["component_id"] for r in graph.nodes.collect()) == [0] * 10 + [1] * 10
    assert service.metrics(graph).first()["edge_count"] == 18
    wire = graph_to_request(graph)
    assert len(wire["nodes"]) == 20 and len(wire["edges"]) == 18
    got = service.place(wire, PlacementRequest("GREEDY", 1, 120))
    rows = response(got).collect()
    assert len(rows) == got.objective == 8 and {r["total_nodes"] for r in rows} == {20}
    service.configs.update(1, k=1, max_radius_m=120.0, iterations=2)
    assert service.place_by_config(graph, 1).objective >= 7
    with pytest.raises(ValueError, match="k must be.*; .*grasp_alpha|grasp_alpha.*"):
        PipelineConfig(k=0, grasp_alpha=2)
    with pytest.raises(ValueError):
        graph_to_request(graph, 5)


def test_scopes_delete_what_they_staged(spark, tmp_path):
    import os

    from roadloom.plans.staging import scope, shared_dir, staged

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scope(spark) as keep:
        staged(spark.range(3).toDF("a"), "gone")
        with scope(spark) as inner:
            kept = inner(staged(spark.range(4).toDF("a"), "handed on"))
            staged(kept, "gone")
        keep(kept)
    assert kept.count() == 4 and len(set(os.listdir(folder)) - before) == 1


def test_settings_outlive_the_process(spark, tmp_path):
    """Settings are found again by another service; first use saves a copy of the defaults of that time."""
    from concurrent.futures import ThreadPoolExecutor

    from roadloom.plans.config import DEFAULTS
    from roadloom.plans.settings import StoredConfigs

    root = f"file://{tmp_path}/s"
    first = StoredConfigs(spark, root)
    assert first.latest().count() == 0 and first.active(1) == DEFAULTS
    first.update(2, k=5, country="cz")
    later = StoredConfigs(spark, root, DEFAULTS.updated(k=7))
    assert (later.active(1).k, later.active(2).k, later.active(2).country, later.active(3).k) == (2, 5, "cz", 7)
    assert later.reset(2).k == 7 and StoredConfigs(spark, root).active(2).country is None
    with pytest.raises(ValueError):
        later.update(1, k=0)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: later.update(9, k=10 + i), range(3)))
    rows = later._rows().where("user_id = 9").collect()
    assert len({r["revision"] for r in rows}) == len(rows) == 3
    got = {r["user_id"]: r["k"] for r in StoredConfigs(spark, root).of(spark.range(1, 5).withColumnRenamed("id", "user_id")).collect()}
    assert got == {1: 2, 2: 7, 3: 7, 4: 2}
