"""PBF files that the test writes, and segments of hand-made ways."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from roadloom.operators.city import SEGMENTS, drivable
from roadloom.operators.ways import PER_WAY, segments_of
from roadloom.sources.pbf import read_pbf, signed, varints

NODES, WAYS = "id long, lat double, lon double", "id long, tags map<string,string>, refs array<long>"


def varint(n):
    out = b""
    n %= 1 << 64
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return varint((n << 1) ^ (n >> 63))


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def deltas(values):
    return b"".join(zig(int(b) - int(a)) for a, b in zip([0, *values], values))


def blob(kind, content, packed=True):
    body = field(3, zlib.compress(content)) + field(2, len(content)) if packed else field(1, content)
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def node_block(nodes, dense=True, step=100, offset=0):
    raw = lambda v: round((v * 1e9 - offset) / step)
    if dense:
        lists = [(1, [n[0] for n in nodes]), (8, [raw(n[1]) for n in nodes]), (9, [raw(n[2]) for n in nodes])]
        group = field(2, b"".join(field(k, deltas(v)) for k, v in lists))
    else:
        group = b"".join(field(1, varint(1 << 3) + zig(i) + varint(8 << 3) + zig(raw(a)) + varint(9 << 3) + zig(raw(o))) for i, a, o in nodes)
    return field(1, field(1, b"")) + field(2, group) + field(17, step) + field(19, offset) + field(20, offset)


def way_block(ways):
    words = ["", *sorted({x for _, tags, _ in ways for kv in tags.items() for x in kv})]
    at = {w: i for i, w in enumerate(words)}
    pack = lambda v: b"".join(varint(x) for x in v)
    group = b"".join(field(3, field(1, i) + field(2, pack(at[k] for k in t)) + field(3, pack(at[v] for v in t.values())) + field(8, deltas(r))) for i, t, r in ways)
    return field(1, b"".join(field(1, w.encode()) for w in words)) + field(2, group)


def pbf(nodes, ways, features=("OsmSchema-V0.6", "DenseNodes")):
    cut = len(nodes) // 2
    parts = [blob("OSMHeader", b"".join(field(4, f.encode()) for f in features)), blob("OSMData", node_block(nodes[:cut])), blob("OSMData", node_block(nodes[cut:], False, 1000, 7000), False)]
    return b"".join(parts + [blob("OSMData", way_block(ways[i : i + 3])) for i in range(0, len(ways), 3)])


def made():
    rng = np.random.default_rng(4)
    nodes = [(int(i), round(float(a), 6), round(float(o), 6)) for i, a, o in zip(rng.permutation(4000)[:300] - 50, rng.uniform(-89, 89, 300), rng.uniform(-179, 179, 300))]
    ids = [n[0] for n in nodes]
    ways = [(7 + 10**10 * (i % 2) + i, {"highway": "residential", "name": f"Šípová {i}"} if i % 4 else {}, [ids[int(k)] for k in rng.integers(0, 300, rng.integers(0, 9))]) for i in range(40)]
    return nodes, ways


@pytest.mark.parametrize("size", [1 << 25, 1])
def test_pbf(spark, tmp_path, size):
    nodes, ways = made()
    (tmp_path / "a.osm.pbf").write_bytes(pbf(nodes, ways))
    path = f"file://{tmp_path}/a.osm.pbf"
    read_pbf(spark, path, "nodes")  # registers
    read = lambda what: spark.read.format("osm_pbf").option("elements", what).option("partitionBytes", size).load(path)
    assert sorted((r["id"], round(r["lat"], 6), round(r["lon"], 6)) for r in read("nodes").collect()) == sorted(nodes)
    assert sorted((r["id"], r["tags"], r["refs"]) for r in read("ways").collect()) == sorted(ways, key=lambda w: w[0])
    assert read("ways").rdd.getNumPartitions() == (1 if size > 1 else 3 + -(-len(ways) // 3))


def test_bad_files(spark, tmp_path):
    nodes, ways = made()
    good = pbf(nodes, ways)
    for i, bad in enumerate((good[:-5], b"\0\0\0\x05hello", pbf(nodes, ways, ("HistoricalInformation",)), blob("OSMData", node_block(nodes)))):
        (tmp_path / f"{i}.pbf").write_bytes(bad)
        with pytest.raises(Exception, match="ends within|no PBF|HistoricalInformation|no header|wire type"):
            read_pbf(spark, f"file://{tmp_path}/{i}.pbf", "ways").collect()
    with pytest.raises(Exception, match="elements"):
        read_pbf(spark, f"file://{tmp_path}/0.pbf", "relations")


def test_numbers():
    values = [0, 1, 127, 128, 300, 2**35, 2**63, 2**64 - 1]
    assert varints(memoryview(b"".join(map(varint, values)))).tolist() == values
    assert signed(varints(memoryview(b"".join(map(zig, [0, -1, 1, -(2**40), 2**40]))))).tolist() == [0, -1, 1, -(2**40), 2**40]


def plain(nodes, ways):
    """(way, base, adj, points) by walking along each way."""
    at = {i: (a, o) for i, a, o in nodes}
    lines = {}
    for i, tags, refs in ways:
        if tags and tags.get("highway") not in (None, "footway") or tags and tags.get("route") == "ferry":
            line = [r for r in refs if r in at]
            line = [r for k, r in enumerate(line) if not k or line[k - 1] != r]
            if len(line) > 1:
                lines[i] = line
    uses = {}
    for line in lines.values():
        for k, r in enumerate(line):
            uses[r] = uses.get(r, 0) + (2 if k in (0, len(line) - 1) else 1)
    out = []
    for i, line in lines.items():
        cuts = [k for k, r in enumerate(line) if uses[r] > 1]
        out += [(i * PER_WAY + n, line[a], line[b], [at[r] for r in line[a : b + 1]]) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out)


def test_segments(spark, tmp_path):
    nodes, ways = made()
    ids = [n[0] for n in nodes]
    ways += [
        (100, {"highway": "primary"}, [ids[0], ids[1], ids[2], ids[0]]), (101, {"highway": "primary"}, [ids[5], 99999, ids[5], ids[6], ids[6]]),
        (102, {"highway": "footway"}, ids[:4]), (103, {"route": "ferry"}, ids[10:13]), (104, {"highway": "primary"}, [99999, 99998]), (105, {"highway": "road"}, [ids[20], ids[21], ids[20], ids[22]]),
    ]
    (tmp_path / "b.pbf").write_bytes(pbf(nodes, ways))
    by_file = segments_of(*[read_pbf(spark, f"{tmp_path}/b.pbf", e) for e in ("nodes", "ways")])
    by_rows = segments_of(spark.createDataFrame(nodes + nodes[:3] + [(None, 1.0, 2.0), (3_999_999, None, 1.0)], NODES), spark.createDataFrame(ways + ways[:2] + [(None, {"highway": "road"}, ids[:3]), (200, None, ids[:3]), (201, {"highway": "road"}, None)], WAYS))
    for got in (by_file, by_rows):
        rows = sorted((r["edge_id"], r["base"], r["adj"], [(round(p["lat"], 6), round(p["lon"], 6)) for p in r["geometry"]]) for r in got.collect())
        assert rows == plain(nodes, ways)
    assert [f.name for f in by_rows.schema][:7] == [c.split()[0] for c in SEGMENTS.split(", ")[:7]]
    empty = segments_of(spark.createDataFrame([], NODES), spark.createDataFrame([], WAYS))
    assert empty.count() == 0


def test_tags(spark):
    tags = [
        {"highway": "primary"}, {"highway": "primary", "oneway": "yes"}, {"highway": "primary", "oneway": "-1"}, {"highway": "service", "junction": "roundabout"}, {"highway": "service", "junction": "roundabout", "oneway": "no"},
        {"highway": "residential", "access": "private"}, {"highway": "residential", "access": "private", "motor_vehicle": "yes"}, {"highway": "bridleway"}, {"route": "ferry"}, {"route": "ferry", "motorcar": "no"},
        {"highway": "trunk", "maxspeed": "50"}, {"highway": "trunk", "maxspeed": "30 mph", "tunnel": "yes"}, {"highway": "trunk", "maxspeed": "walk", "bridge": "no"}, {"highway": "steps"}, {"building": "yes"},
    ]
    df = segments_of(spark.createDataFrame([(i, 1.0, float(i)) for i in range(40)], NODES), spark.createDataFrame([(i, t, [2 * i, 2 * i + 1]) for i, t in enumerate(tags)], WAYS))
    got = {r["edge_id"] // PER_WAY: (r["car_fwd"], r["car_bwd"], r["road_env"], round(r["speed_kmh"], 3)) for r in df.collect()}
    assert got == {
        0: (True, True, "ROAD", 65), 1: (True, False, "ROAD", 65), 2: (False, True, "ROAD", 65), 3: (True, False, "ROAD", 20), 4: (True, True, "ROAD", 20), 5: (False, False, "ROAD", 30), 6: (True, True, "ROAD", 30),
        7: (False, False, "ROAD", 20), 8: (True, True, "FERRY", 6), 9: (False, False, "FERRY", 6), 10: (True, True, "ROAD", 45), 11: (True, True, "TUNNEL", 43.452), 12: (True, True, "ROAD", 70),
    }
    assert sorted(r["edge_id"] // PER_WAY for r in drivable(df).collect()) == [0, 1, 2, 3, 4, 6, 10, 11, 12]
