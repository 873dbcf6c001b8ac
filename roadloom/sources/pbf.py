"""OpenStreetMap's PBF files as a data source of Spark: ``spark.read.format("osm_pbf")``.

A file is a row of blobs, each compressed by itself, so a partition is a run of blobs. Planning reads the blobs' short
headers only; tasks open the file at their place. Paths are those that Arrow's file systems know.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ELEMENTS = {"nodes": "id long, lat double, lon double", "ways": "id long, tags map<string, string>, refs array<long>"}
#: Bytes of blobs in a partition; the most that the format allows of a header and a blob.
PARTITION_BYTES, MAX_HEADER, MAX_BLOB = 32 << 20, 64 << 10, 64 << 20
_FEATURES = {"OsmSchema-V0.6", "DenseNodes"}


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field of a message: an integer, or the bytes of what has a length."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            if at + size > end:
                raise ValueError("a field reaches beyond its message")
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind} isn't known")


def varints(data: memoryview) -> np.ndarray:
    """A packed list of unsigned integers: the groups of seven bits, shifted by their place in a number, are summed."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 128)
    if not len(ends) or ends[-1] != len(b) - 1:
        raise ValueError("a packed list ends within a number")
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers: the lowest bit is the sign."""
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def _single(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


@dataclass
class _Block:
    strings: list[memoryview]
    groups: list[memoryview]
    step: int = 100
    lat: int = 0
    lon: int = 0

    @staticmethod
    def of(data: memoryview) -> _Block:
        out = _Block([], [])
        for number, value in fields(data):
            if number == 1:
                out.strings = [v for n, v in fields(value) if n == 1]
            elif number == 2:
                out.groups.append(value)
            elif number in (17, 19, 20):
                value = value - (1 << 64) if value >= 1 << 63 else value
                setattr(out, {17: "step", 19: "lat", 20: "lon"}[number], value)
        return out

    def degrees(self, raw: np.ndarray, offset: int) -> np.ndarray:
        return (offset + self.step * raw) / 1e9


def nodes_of(block: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for group in block.groups:
        plain: list[tuple[int, int, int]] = []
        for number, value in fields(group):
            if number == 2:
                packed = {n: v for n, v in fields(value) if n in (1, 8, 9)}
                ids, lat, lon = (np.cumsum(signed(varints(packed.get(n, memoryview(b""))))) for n in (1, 8, 9))
                if not len(ids) == len(lat) == len(lon):
                    raise ValueError("dense nodes have lists of different length")
                yield ids, block.degrees(lat, block.lat), block.degrees(lon, block.lon)
            elif number == 1:
                f = {n: v for n, v in fields(value) if n in (1, 8, 9)}
                plain.append((_single(f[1]), _single(f[8]), _single(f[9])))
        if plain:
            ids, lat, lon = np.array(plain, np.int64).T
            yield ids, block.degrees(lat, block.lat), block.degrees(lon, block.lon)


def ways_of(block: _Block) -> Iterator[tuple[int, list, np.ndarray]]:
    text = [bytes(s).decode("utf-8", "replace") for s in block.strings]
    for group in block.groups:
        for number, value in fields(group):
            if number == 3:
                f = {n: v for n, v in fields(value) if n in (1, 2, 3, 8)}
                keys, values = (varints(f.get(n, memoryview(b""))).tolist() for n in (2, 3))
                # Of a tag that is repeated, the last counts.
                tags = {text[k]: text[v] for k, v in zip(keys, values, strict=True)}
                yield f[1], list(tags.items()), np.cumsum(signed(varints(f.get(8, memoryview(b"")))))


def _read_exactly(stream, size: int) -> bytes:
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("the file ends within a blob")
    return data


def _header(stream) -> tuple[str, int] | None:
    """Type and size of the next blob; None at the end."""
    head = stream.read(4)
    if not head:
        return None
    size = int.from_bytes(head, "big")
    if len(head) < 4 or size > MAX_HEADER:
        raise ValueError("this is no PBF file")
    f = dict(fields(memoryview(_read_exactly(stream, size))))
    if f.get(3, MAX_BLOB + 1) > MAX_BLOB:
        raise ValueError("a blob is larger than the format allows")
    return bytes(f[1]).decode(), f[3]


def _content(blob: bytes) -> memoryview:
    f = dict(fields(memoryview(blob)))
    if 1 in f:
        return f[1]
    if 3 in f:
        return memoryview(zlib.decompress(f[3]))
    raise ValueError("a blob is neither raw nor compressed by zlib")


@dataclass
class BlobRun(InputPartition):
    """The blobs of a file that begin from ``start`` on and before ``end``."""

    path: str
    start: int
    end: int


class PbfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))
        self.elements = options.get("elements", "nodes")

    def partitions(self) -> list[BlobRun]:
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        if not names:
            raise ValueError(f"no files in {self.path}")
        return [run for name in names for run in self._runs(fs, name)]

    def _runs(self, fs: pa.fs.FileSystem, name: str) -> Iterator[BlobRun]:
        with fs.open_input_file(name) as f:
            first, seen = 0, False
            while head := _header(f):
                kind, size = head
                at = f.tell()
                if kind == "OSMHeader":
                    wanted = {bytes(v).decode() for n, v in fields(_content(_read_exactly(f, size))) if n == 4}
                    if wanted - _FEATURES:
                        raise ValueError(f"{name} needs {sorted(wanted - _FEATURES)}")
                    seen = True
                f.seek(at + size)
                if at + size - first >= self.size:
                    yield BlobRun(name, first, at + size)
                    first = at + size
            if not seen:
                raise ValueError(f"{name} has no header")
            if f.tell() > first:
                yield BlobRun(name, first, f.tell())

    def read(self, partition: BlobRun) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start)
            while f.tell() < partition.end:
                kind, size = _header(f)
                data = _read_exactly(f, size)
                if kind == "OSMData":
                    yield from self._rows(_Block.of(_content(data)))

    def _rows(self, block: _Block) -> Iterator[pa.RecordBatch]:
        if self.elements == "nodes":
            for ids, lat, lon in nodes_of(block):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lat), pa.array(lon)], names=["id", "lat", "lon"])
            return
        rows = list(ways_of(block))
        if rows:
            ids, tags, refs = zip(*rows, strict=True)
            columns = [pa.array(ids, pa.int64()), pa.array(tags, pa.map_(pa.string(), pa.string())), pa.array(refs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "tags", "refs"])


class PbfSource(DataSource):
    """Options: path (a file or folder), elements (``nodes`` or ``ways``), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        kind = self.options.get("elements", "nodes")
        if kind not in ELEMENTS:
            raise ValueError(f"elements are {' or '.join(ELEMENTS)}, not {kind}")
        return ELEMENTS[kind]

    def reader(self, schema) -> PbfReader:
        return PbfReader({k.lower(): v for k, v in self.options.items()})


def read_pbf(spark: SparkSession, path: str, elements: str) -> DataFrame:
    """The nodes (id, lat, lon) or ways (id, tags, refs) of a PBF file, or of all in a folder."""
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").option("elements", elements).load(path if "://" in path else f"file://{path}")
