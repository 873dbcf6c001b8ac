from __future__ import annotations

import itertools
import json
import math
import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadloom.functions.geo import haversine_m, in_rings
from roadloom.operators import city, trips
from roadloom.operators.matching import RoadMatcher
from roadloom.operators.road_graph import Graph, build_road_graph, grid_encoder, matched_points, merged_graph
from roadloom.plans.config import DEFAULTS
from roadloom.sources import points as src

GPX = """<?xml version="1.0"?><gpx version="1.1"><metadata><time>2024-01-01T00:00:00Z</time></metadata><wpt lat="1" lon="1"/>
<trk><name>7</name><trkseg><trkpt lat="48.1" lon="17.1"><time>2024-01-01T10:00:00Z</time></trkpt><trkpt lat="48.2" lon="17.2"/></trkseg><trkseg></trkseg></trk>
<trk><trkseg><trkpt lat="48.3" lon="17.3"><time>2024-01-01T11:00:00+01:00</time></trkpt></trkseg></trk></gpx>"""


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_gpx(spark, tmp_path):
    rows = src.read_points(spark, write(tmp_path / "a.gpx", GPX)).orderBy("seq").collect()
    got = [(r["trip_id"], r["lat"], r["ts"].strftime("%H:%M")) for r in rows]
    assert got == [(1, 48.1, "10:00"), (1, 48.2, "00:00"), (3, 48.3, "10:00")]


def test_csv(spark, tmp_path):
    text = "﻿Time, Longitude ,lat,Trip\n2024-01-01T10:00:00Z,17.1,48.1,4\n\n2024-01-01,17.2,48.2,x\n17\n,17.3,48.3,\n"
    rows = src.read_points(spark, write(tmp_path / "a.csv", text)).orderBy("seq").collect()
    assert [(r["trip_id"], r["lat"], r["lon"], r["ts"] is None) for r in rows] == [(4, 48.1, 17.1, False), (1, 48.2, 17.2, True), (1, 48.3, 17.3, True)]
    only = src.read_points(spark, write(tmp_path / "b.csv", "lat,lng\n1,2\n")).first()
    assert (only["trip_id"], only["ts"]) == (1, None)
    for name, bad in (("c", "lat,x\n1,2\n"), ("d", "lat,lon\n"), ("e", "")):
        with pytest.raises(ValueError):
            src.read_points(spark, write(tmp_path / f"{name}.csv", bad))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        src.read_points(spark, write(tmp_path / "f.csv", "lat,lon\n1,2\nzz,3\n")).collect()


def test_many_csv_files(spark, tmp_path):
    """A thousand files with headers of different order in one set of jobs, lines cut into blocks; all in order."""
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for i in range(1000):
        names = random.Random(i).sample(["lat", "LNG", "trip", "x"], 4)
        rows = [{"lat": f"{i / 100}", "LNG": f"{j / 1000}", "trip": f"{i % 3}", "x": ""} for j in range(300 if i == 7 else 2)]
        write(folder / f"f{i:04}.csv", ",".join(names) + "\n\n" + "\n".join(",".join([r[n] for n in names] + ["."]) for r in rows) + "\n")
        want += [(f"f{i:04}.csv", i % 3, float(r["lat"]), float(r["LNG"])) for r in rows]
    began = time.perf_counter()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = src.read_folder(spark, f"file://{folder}")
        rows = got.orderBy("file", "seq").select(F.substring_index("file", "/", -1), "trip_id", "lat", "lon").collect()
        assert got.select("file", "seq").distinct().count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in rows] == want
    assert time.perf_counter() - began < 120
    write(folder / "empty.csv", "lat,lon\n\n")
    with pytest.raises(ValueError, match="no points"):
        src.read_folder(spark, f"file://{folder}")
    write(folder / "empty.csv", "lat,lat\n1,2\n")
    with pytest.raises(ValueError, match="empty.csv"):
        src.read_folder(spark, f"file://{folder}")


def test_geojson(spark, tmp_path):
    f = lambda kind, props: '{"features":[{"geometry":{"type":"%s","coordinates":[17.1,48.1]},"properties":{%s}}]}' % (kind, props)  # noqa: E731, UP031
    rows = src.read_points(spark, write(tmp_path / "a.geojson", f("Point", '"timestamp":"2024-01-01T10:00:00Z"'))).collect()
    assert [(r["trip_id"], r["lat"], r["lon"], r["ts"]) for r in rows] == [(1, 48.1, 17.1, datetime(2024, 1, 1, 10))]
    for name, kind, props in (("b", "Point", ""), ("c", "LineString", '"timestamp":"2024-01-01T10:00:00Z"')):
        with pytest.raises(Exception, match="feature"):
            src.read_points(spark, write(tmp_path / f"{name}.json", f(kind, props))).collect()


def test_dispatch_and_samples(spark, tmp_path):
    write(tmp_path / "a.csv", "lat,lon\n1,2\n")
    assert src.list_samples(str(tmp_path)) == ["a.csv"]
    assert src.read_sample(spark, str(tmp_path), "a.csv").count() == 1
    for bad in ("../a.csv", "x/a.csv", "none.csv"):
        with pytest.raises(ValueError):
            src.read_sample(spark, str(tmp_path), bad)
    with pytest.raises(ValueError):
        src.read_points(spark, "file:///x.GPX")


def fold(rows, limit):
    out, last = [], None
    for i, (seq, lat, us) in enumerate(sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))):
        ok, go = True, us is not None
        if i and us is not None and last is not None:
            secs = (us - last[1]) // 1_000_000
            if secs <= 0:
                go = False
            else:
                ok = go = haversine_m(last[0], 17.0, lat, 17.0) / secs <= limit / 3.6
        if ok:
            out.append(seq)
        if go:
            last = (lat, us)
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.one_of(st.none(), st.integers(0, 40_000_000))), min_size=1, max_size=25))
def test_speed_fold(spark, pairs):
    rows = [(i, 48 + y * 0.0005, us) for i, (y, us) in enumerate(pairs)]
    df = spark.createDataFrame([(i, 1, y, 17.0, us) for i, y, us in rows] + [(100, 2, 48.0, 17.0, 5)], "seq long, trip_id int, lat double, lon double, us long").selectExpr("seq", "trip_id", "lat", "lon", "timestamp_micros(us) as ts")
    got = sorted(r["seq"] for r in trips.speed_filter(df, 30).collect())
    assert got == fold(rows, 30) + [100]


def test_merge_is_a_quotient(spark):
    rows = [(0, 1, 48.00001, 17.00001, None), (1, 1, 48.00002, 17.00001, None), (2, 1, 48.01, 17.0, None), (3, 2, 48.00003, 17.00001, None), (4, 2, 48.0101, 17.0001, None)]
    df = spark.createDataFrame(rows, "seq long, trip_id int, lat double, lon double, ts timestamp")
    g = build_road_graph(df, DEFAULTS, cell=grid_encoder(5000))
    assert sorted(r["node_id"] for r in g.nodes.collect()) == ["cell_9600_3400", "cell_9602_3400"]
    assert g.edges.count() == 1


def test_invalid_coordinates(spark):
    df = spark.createDataFrame([(90.0, 180.0), (91.0, 0.0), (0.0005, 0.0005), (0.0, 0.5), (float("nan"), 1.0), (None, 1.0)], "lat double, lon double")
    assert [tuple(r) for r in trips.valid_points(df).collect()] == [(90.0, 180.0), (0.0, 0.5)]


def test_city(spark, tmp_path):
    seg = lambda i, a, b, fwd, env, pts: (i, a, b, fwd, False, env, [(y, x) for y, x in pts])
    rows = [
        seg(1, 10, 11, True, "ROAD", [(48.1, 17.1), (48.15, 17.1), (48.2, 17.1)]), seg(1, 10, 11, True, "ROAD", [(48.1, 17.1), (48.15, 17.1), (48.2, 17.1)]),
        seg(2, 11, 12, True, "FERRY", [(48.2, 17.1), (48.3, 17.1)]), seg(3, 11, 13, False, "ROAD", [(48.2, 17.1), (48.3, 17.2)]), seg(4, 20, 21, True, "ROAD", [(50.0, 17.1), (50.1, 17.1)]),
    ]
    df = spark.createDataFrame(rows, city.SEGMENTS)
    df.write.parquet(f"file://{tmp_path}/segments")
    place = write(tmp_path / "city.geojson", '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[17,48],[17.5,48],[17.5,48.5],[17,48.5]]]}}],"type":"FeatureCollection"}')
    b = city.read_boundary(spark, place)
    g = city.extract_city(city.read_segments(spark, f"file://{tmp_path}/segments"), b)
    assert sorted(r["node_id"] for r in g.nodes.collect()) == ["10", "11", "1_p1"] and g.edges.count() == 2
    with pytest.raises(ValueError):
        city.extract_city(df, b, max_nodes=2)
    with pytest.raises(ValueError):
        city.read_boundary(spark, write(tmp_path / "none.geojson", '{"type":"FeatureCollection","features":[]}'))


def test_city_with_parts_and_holes():
    import json

    rings = [[[[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[3, 3], [6, 3], [6, 6], [3, 6], [3, 3]]], [[[20, 0], [21, 0], [21, 1], [20, 0]]]]
    b = city.boundary_of(json.dumps({"type": "Feature", "bbox": [-1, -2, 20.9, 9], "geometry": {"type": "MultiPolygon", "coordinates": rings}}))
    assert len(b.rings) == 3 and (b.min_lat, b.max_lat, b.min_lon, b.max_lon) == (-2, 9, -1, 20.9)
    assert city.boundary_of(json.dumps({"type": "Polygon", "coordinates": rings[0]})).max_lon == 9


def test_long_borders(spark):
    rng = random.Random(2)
    ring = [(math.cos(a) * r, math.sin(a) * r) for a, r in ((i * math.tau / 900, rng.uniform(0.5, 1)) for i in range(900))]
    hole = [(x * 0.3, y * 0.3) for x, y in ring]
    points = [(rng.uniform(-1.1, 1.1), rng.uniform(-1.1, 1.1)) for _ in range(600)] + ring[:50]
    df = spark.createDataFrame(points, "lon double, lat double")

    def sides():
        return [(a, b) for r in (ring, hole) for a, b in zip(r, [*r[1:], r[0]], strict=True)]

    def inside(x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides()) % 2 == 1

    def off(x, y):
        best = 9.0
        for a, b in sides():
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(x - a[0] - t * dx, y - a[1] - t * dy))
        return best

    for buffer_m in (0.0, 3000.0):
        got = [r[0] for r in df.select(in_rings(F.col("lat"), F.col("lon"), [ring, hole], buffer_m)).collect()]
        want = [inside(x, y) or (buffer_m > 0 and off(x, y) <= buffer_m / 111_000) for x, y in points]
        assert sum(g != w for g, w in zip(got[:600], want[:600], strict=True)) == 0 and True in got and False in got
        assert buffer_m == 0 or all(got[600:])


def test_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    gpx = '<gpx><trk><trkseg><trkpt lat="1" lon="2"><time>2024-01-01T10:00:00Z</time></trkpt></trkseg><trkseg><trkpt lat="3" lon="4"/></trkseg></trk></gpx>'
    for name, text in (("a.gpx", gpx), ("b.gpx", gpx), ("c.csv", "lon,lat\n2,1\n"), ("d.csv", "lat,trip,lon\n1,7,2\n5,8,6\n")):
        write(tmp_path / "in" / name, text)
    rows = src.read_folder(spark, f"file://{tmp_path}/in")
    assert sorted((r["file"].rsplit("/", 1)[1], r["trip_id"], r["lat"], r["lon"]) for r in rows.collect()) == [
        ("a.gpx", 1, 1, 2), ("a.gpx", 2, 3, 4), ("b.gpx", 1, 1, 2), ("b.gpx", 2, 3, 4), ("c.csv", 1, 1, 2), ("d.csv", 7, 1, 2), ("d.csv", 8, 5, 6)]
    merged = src.merged_files(rows).orderBy("seq").collect()
    assert [(r["seq"], r["trip_id"], r["lat"]) for r in merged] == [(0, 1, 1), (1, 2, 3), (2, 3, 1), (3, 4, 3), (4, 5, 1), (5, 6, 1), (6, 7, 5)]
    write(tmp_path / "in" / "e.txt", "x")
    with pytest.raises(ValueError):
        src.read_folder(spark, f"file://{tmp_path}/in")


def grid(spark, lat0, lon0, n=4, step=0.01):
    """A square grid of roads and its links; longitudes beyond 180 degrees go on at -180."""
    wide = step / math.cos(math.radians(lat0))
    at = {f"{y}.{x}": (lat0 + y * step, (lon0 + x * wide + 180) % 360 - 180) for y in range(n) for x in range(n)}
    edges = []
    for y in range(n):
        for x in range(n):
            for y2, x2 in ((y + 1, x), (y, x + 1)):
                if y2 < n and x2 < n:
                    a, b = sorted((f"{y}.{x}", f"{y2}.{x2}"))
                    edges.append((a, b, haversine_m(*at[a], *at[b])))
    nodes = spark.createDataFrame([(k, y, x, False, None, None) for k, (y, x) in at.items()], "node_id string, lat double, lon double, off_road boolean, first_seen timestamp, last_seen timestamp")
    return Graph(nodes, spark.createDataFrame(edges, "src string, dst string, dist_m double")), at, edges, wide


def plain_match(m, at, edges, trip):
    """Viterbi over all edges, with shortest paths by relaxation."""
    dist = {(a, b): 0.0 if a == b else math.inf for a in at for b in at}
    for a, b, w in edges:
        dist[a, b] = dist[b, a] = w
    for k in at:
        for a in at:
            for b in at:
                dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])

    def places(y, x):
        out = {}
        for a, b, w in edges:
            east = math.cos(math.radians(y))
            turn = lambda d: (d + 540) % 360 - 180
            dx, dy, px, py = turn(at[b][1] - at[a][1]), at[b][0] - at[a][0], turn(x - at[a][1]), y - at[a][0]
            t = max(0.0, min(1.0, (px * dx * east**2 + py * dy) / (dx * dx * east**2 + dy * dy)))
            off = haversine_m(y, x, at[a][0] + t * dy, at[a][1] + t * dx)
            if off <= m.reach_m:
                out[a, b] = (t, w, off)
        return out

    best, back, last = None, [], None
    for y, x in trip:
        here = places(y, x)
        cost = {p: 0.5 * (off / m.sigma_m) ** 2 for p, (_, _, off) in here.items()}
        if best is None:
            new, via = {p: round(c, 6) for p, c in cost.items()}, {}
        else:
            line, new, via = haversine_m(*last[0], y, x), {}, {}
            for q, (t2, w2, _) in here.items():
                for p in sorted(best):
                    t, w, _ = last[1][p]
                    way = abs(t - t2) * w if p == q else min(da + dist[e, f] + db for e, da in ((p[0], t * w), (p[1], (1 - t) * w)) for f, db in ((q[0], t2 * w2), (q[1], (1 - t2) * w2)))
                    total = best[p] + round(abs(way - line) / m.beta_m + cost[q], 6)
                    if way <= m.detour * line + m.slack_m and total < new.get(q, math.inf):
                        new[q], via[q] = total, p
        if not new:
            return None
        best, last = new, ((y, x), here)
        back.append(via)
    q = min(best, key=lambda p: (best[p], p))
    path = [q]
    for via in reversed(back[1:]):
        path.append(via[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("lat0, lon0", [(48.0, 17.0), (69.0, 179.985), (-0.015, -0.02)])
def test_matching_against_all_edges(spark, lat0, lon0):
    g, at, edges, wide = grid(spark, lat0, lon0)
    m, rng = RoadMatcher(g, reach_m=400.0, sigma_m=150.0, beta_m=300.0), random.Random(int(lat0))
    walks = []
    for _ in range(6):
        y, x = rng.randint(0, 3), rng.randint(0, 3)
        trip = []
        for _ in range(8):
            trip.append((lat0 + y * 0.01 + rng.uniform(-0.0025, 0.0025), (lon0 + x * wide + rng.uniform(-0.0025, 0.0025) * wide / 0.01 + 180) % 360 - 180))
            y, x = rng.choice([(v, u) for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if 0 <= v < 4 and 0 <= u < 4])
        walks.append(trip)
    walks.append([walks[0][0], (lat0 + 0.3, lon0)])  # out of reach
    df = spark.createDataFrame([(i, p, y, x) for i, t in enumerate(walks) for p, (y, x) in enumerate(t)], "trip_id int, pos int, lat double, lon double")
    got = {}
    for r in m.match_points(df).orderBy("trip_id", "pos").collect():
        got.setdefault(r["trip_id"], []).append((r["a"], r["b"]))
    want = {i: plain_match(m, at, edges, t) for i, t in enumerate(walks)}
    assert want[6] is None and got == {i: p for i, p in want.items() if p}
    # The geometry goes along roads: between its ends, each step joins neighbours.
    lines, where = {}, {(round(y, 9), round(x, 9)): k for k, (y, x) in at.items()}
    for r in m.match(df).orderBy("trip_id", "pos").collect():
        lines.setdefault(r["trip_id"], []).append(where.get((round(r["lat"], 9), round(r["lon"], 9))))
    near = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    assert set(lines) == set(got)
    for line in lines.values():
        assert all((a, b) in near for a, b in itertools.pairwise(line[1:-1]))


def test_matching(spark):
    near = [(i, 1, 48.0 + i * 0.001 + 0.00002, 17.0, None) for i in range(5)] + [(9, 2, 20.0, 20.0, None), (10, 2, 20.1, 20.0, None)]
    df = spark.createDataFrame(near, "seq long, trip_id int, lat double, lon double, ts timestamp")
    nodes = spark.createDataFrame([(f"r{i}", 48.0 + i * 0.001, 17.0, False, None, None) for i in range(5)], "node_id string, lat double, lon double, off_road boolean, first_seen timestamp, last_seen timestamp")
    edges = spark.createDataFrame([(f"r{i}", f"r{i + 1}", 111.2) for i in range(4)], "src string, dst string, dist_m double")
    rows = matched_points(df, RoadMatcher(Graph(nodes, edges))).orderBy("trip_id", "pos").collect()
    assert [(r["trip_id"], r["off_road"]) for r in rows] == [(1, False)] * 5 + [(2, True)] * 2
    assert [round(r["lat"], 3) for r in rows[:5]] == [48.0, 48.001, 48.002, 48.003, 48.004]
    assert merged_graph(matched_points(df, None), grid_encoder(1000)).nodes.count() == 7


def test_geojson_is_read_once(spark, tmp_path):
    """No value sends the reader back to the file: what is read follows its size."""
    feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [17.125, 48.25]}, "properties": {"timestamp": "2020-01-01T00:00:00Z"}}
    text = "\ufeff" + json.dumps({"type": "FeatureCollection", "features": [feature] * 2000})
    (tmp_path / "a.geojson").write_text(text, encoding="utf-8")
    read = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = read()
    rows = src.read_geojson(spark, f"file://{tmp_path}/a.geojson").collect()
    assert read() - before < 3 * len(text)
    assert len(rows) == 2000 and {(r["lat"], r["lon"], r["trip_id"]) for r in rows} == {(48.25, 17.125, 1)}


def test_folder_of_one_kind(spark, tmp_path):
    """Files of a named kind are read whatever their names and wherever they lie; those that begin with an underscore
    don't count."""
    from roadloom.sources.points import read_folder

    gpx = lambda lat: f'<gpx><trk><trkseg><trkpt lat="{lat}" lon="17.0"><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>'
    for at, lat in (("a/part-0.txt", 48.5), ("b/c/part-0.txt", 49.5), ("_SUCCESS", None)):
        (tmp_path / "g" / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "g" / at).write_text("" if lat is None else gpx(lat))
    rows = read_folder(spark, str(tmp_path / "g"), "gpx").orderBy("lat").collect()
    assert [(r["file"].rsplit("/g/", 1)[1], r["seq"], r["trip_id"], r["lat"]) for r in rows] == [("a/part-0.txt", 0, 1, 48.5), ("b/c/part-0.txt", 0, 1, 49.5)]
    with pytest.raises(ValueError):
        read_folder(spark, str(tmp_path / "g"), "csv")


@pytest.mark.parametrize("directed", [False, True])
def test_steps_of_few_routes_make_no_table(spark, monkeypatch, directed):
    """Where routes are few, the costs of steps are found in the tasks and no table of steps is written; joining steps
    with their routes matches the same, however small the batches."""
    from roadloom.operators import matching
    from roadloom.operators.routing import DirectedMatcher, Roads

    g, at, edges, wide = grid(spark, 48.0, 17.0)
    own = dict(reach_m=500.0, sigma_m=150.0, beta_m=300.0)
    if directed:
        arcs = [(a, b, w, w / 10) for a, b, w in edges] + [(b, a, w, w / 12) for i, (a, b, w) in enumerate(edges) if i % 3]
        m = DirectedMatcher.on(Roads(g.nodes, spark.createDataFrame(arcs, "src string, dst string, dist_m double, time_s double")), back_m=50.0, slack_s=300.0, **own)
    else:
        m = RoadMatcher(g, **own)
    rng, rows = random.Random(3), []
    for trip in range(5):
        y, x = 1.5, 1
        for pos in range(1 if trip == 4 else 12):
            rows.append((trip, pos, 48.0 + y * 0.01, 17.0 + x * wide))
            y, x = min(3.0, max(0.0, y + rng.uniform(-1, 1))), round(min(3.0, max(0.0, x + rng.uniform(-1, 1))))
    rows.append((3, 12, 60.0, 17.0))  # a trip that ends out of reach
    df = spark.createDataFrame(rows, "trip_id int, pos int, lat double, lon double")
    names, write = [], matching.staged
    monkeypatch.setattr(matching, "staged", lambda rows, name: names.append(name) or write(rows, name))
    both = []
    for most, batch in ((matching.MAX_BROADCAST_ROUTES, "7"), (0, "10000")):
        monkeypatch.setattr(matching, "MAX_BROADCAST_ROUTES", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        names.clear()
        both.append((sorted(map(tuple, m.match_points(df).collect())), sorted(map(tuple, m.match(df).collect()))))
        assert ("steps" in names) == (most == 0)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert both[0] == both[1] and {r[0] for r in both[0][0]} == {0, 1, 2, 4} and len(both[0][1]) > 20
