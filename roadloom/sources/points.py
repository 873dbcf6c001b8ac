"""Readers of GPS tracks: GPX, CSV and GeoJSON become (seq, trip_id, lat, lon, ts)."""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.plans.order import ranked
from roadloom.plans.staging import staged

POINTS = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("trip_id", T.IntegerType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("ts", T.TimestampType())]
)
_GPX = "metadata STRUCT<time: STRING>, trk ARRAY<STRUCT<name: STRING, trkseg: ARRAY<STRUCT<trkpt: ARRAY<STRUCT<_lat: DOUBLE, _lon: DOUBLE, time: STRING>>>>>>"
_GEOJSON = "features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: ARRAY<STRING>>, properties: STRUCT<timestamp: STRING, trip_id: INT>>>"
#: Instants as ISO 8601 gives them in UTC or with an offset; a bare date is none.
_INSTANT = r"^[+-]?\d{4,10}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|z|[+-]\d{2}(:?\d{2})?)$"
#: Accepted headers, in lower case.
ALIASES = {"lat": ("lat", "latitude"), "lon": ("lon", "longitude", "lng"), "ts": ("timestamp", "time", "datetime"), "trip_id": ("trip_id", "trip", "tripid")}


def instant(text: Column) -> Column:
    """The instant of an ISO string, else null."""
    return F.when(F.trim(text).rlike(_INSTANT), F.trim(text).try_cast("timestamp"))


def _file(with_file: bool) -> list[Column]:
    return [F.col("_metadata.file_path").alias("file")] if with_file else []


def read_gpx(spark: SparkSession, path: str | list[str], with_file: bool = False, nested: bool = False) -> DataFrame:
    """Track points; every segment is a trip, counted from 1 across a file's tracks, empty ones too. A point without a
    time has the file's. Routes and waypoints don't count. ``with_file``: a column ``file`` comes first. ``nested``: files
    in the folders below are read too."""
    rows = spark.read.option("recursiveFileLookup", nested).format("xml").option("rowTag", "gpx").schema(_GPX).load(path)
    kept = ["file"] if with_file else []
    segments = rows.select(*_file(with_file), F.col("metadata.time").alias("whole"), F.posexplode(F.flatten(F.transform("trk", lambda t: F.coalesce(t["trkseg"], F.array())))).alias("s", "seg"))
    points = segments.select(*kept, "whole", "s", F.posexplode("seg.trkpt").alias("p", "pt"))
    return points.select(
        *kept, ((F.col("s").cast("long") * F.lit(1 << 32)) + F.col("p")).alias("seq"), (F.col("s") + 1).cast("int").alias("trip_id"),
        F.col("pt._lat").alias("lat"), F.col("pt._lon").alias("lon"), instant(F.coalesce("pt.time", "whole")).alias("ts"),
    )


def _parsed(lines: DataFrame, at: dict[str, Column], *kept: str, value: str = "value") -> DataFrame:
    """Points of data lines whose fields stand at the places ``at``, null for those that aren't there."""
    cells = lines.where(F.trim(value) != "").withColumn("_c", F.split(F.regexp_replace(value, ",+$", ""), ","))
    cells = cells.where(F.size("_c") > F.greatest(at["lat"], at["lon"]))
    field = lambda k: F.trim(F.get("_c", at[k]))
    return cells.select(*kept, F.coalesce(field("trip_id").try_cast("int"), F.lit(1)).alias("trip_id"), field("lat").cast("double").alias("lat"), field("lon").cast("double").alias("lon"), instant(field("ts")).alias("ts"))


def places(header: Column) -> dict[str, Column]:
    """Where the fields stand by a header line, from 0; null for those that aren't there. Of equal names the last
    counts, of a field's names the first of :data:`ALIASES`."""
    names = F.reverse(F.transform(F.split(F.ltrim(header, F.lit("\ufeff")), ","), lambda h: F.lower(F.trim(h))))
    at = lambda a: F.size(names) - F.nullif(F.array_position(names, a), F.lit(0)).cast("int")
    return {k: F.coalesce(*[at(a) for a in aliases]) for k, aliases in ALIASES.items()}


def parse_csv(lines: DataFrame, header: str, value: str = "value", seq: str = "seq") -> DataFrame:
    """Points of the data lines in ``lines``, whose columns are named by ``header``.

    Fields are split at commas, without quoting. Blank and short lines are skipped. A bad latitude or longitude fails
    the query; a bad or absent timestamp is null; a bad or absent trip is 1.
    """
    names = {h.strip().lower(): i for i, h in enumerate(header.lstrip("\ufeff").split(","))}
    at = {k: next((names[a] for a in aliases if a in names), None) for k, aliases in ALIASES.items()}
    if at["lat"] is None or at["lon"] is None:
        raise ValueError("a CSV file needs a latitude and a longitude column")
    rows = _parsed(lines.withColumnRenamed(seq, "seq"), {k: F.lit(i).cast("int") for k, i in at.items()}, "seq", value=value)
    return rows.select("seq", "trip_id", "lat", "lon", "ts")


def read_csv(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """Points of CSV files in UTF-8, with or without a byte-order mark, each with a header of its own; a file without
    the columns or without points is an error. ``with_file``: a column ``file`` comes first.

    Any number of files is read in one plan: lines are written with their file and block, the first line of each file
    is its header, and headers join back to the lines. A point's seq grows with its line in the file: it is the place
    where its block begins and the number of lines since, which are fewer than the bytes in between.
    """
    paths = [path] if isinstance(path, str) else path
    at = F.monotonically_increasing_id()
    lines = staged(spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), "value"), "lines")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.min_by(F.when(F.col("block") == 0, F.col("value")), "at").alias("header"))
    blocks = staged(blocks, "blocks")
    heads = blocks.where("block = 0").select("file", F.col("first").alias("top"), *[c.alias(f"at_{k}") for k, c in places(F.col("header")).items()])
    heads = staged(heads, "headers")
    wrong = [r["file"] for r in heads.where("at_lat is null or at_lon is null").select("file").limit(5).collect()]
    if wrong:
        raise ValueError(f"a CSV file needs a latitude and a longitude column: {', '.join(sorted(wrong))}")
    rows = lines.join(blocks.select("file", "block", "first"), ["file", "block"]).join(heads, "file").where(F.col("at") != F.col("top"))
    rows = rows.withColumn("seq", F.col("block") + F.col("at") - F.col("first"))
    points = _parsed(rows, {k: F.col(f"at_{k}") for k in ALIASES}, "file", "seq")
    if points.select("file").distinct().count() < len(paths):
        raise ValueError("a CSV file is empty or has no points")
    return points.select(*(["file"] if with_file else []), "seq", "trip_id", "lat", "lon", "ts")


def read_geojson(spark: SparkSession, path: str | list[str], with_file: bool = False, nested: bool = False) -> DataFrame:
    """Point features; coordinates are (lon, lat). A missing timestamp or another geometry fails the query; a
    missing trip_id is 1. ``with_file``: a column ``file`` comes first. ``nested``: files in the folders below are read
    too.

    A file is read as one text in UTF-8 and parsed from memory: the JSON source would go back to the file for each
    number that is kept as it is written."""
    rows = spark.read.option("recursiveFileLookup", nested).text(path, wholetext=True)
    kept = ["file"] if with_file else []
    parsed = F.from_json(F.ltrim("value", F.lit("\ufeff")), _GEOJSON).alias("j")
    f = rows.select(*_file(with_file), parsed).select(*kept, F.posexplode("j.features").alias("seq", "f"))
    c = F.col("f.geometry.coordinates")
    fail = lambda test, value, why: F.when(test, value).otherwise(F.raise_error(F.lit(why)).cast("string"))
    is_point = (F.coalesce(F.col("f.geometry.type"), F.lit("Point")) == "Point") & (F.size(c) >= 2)
    return f.select(
        *kept, F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("f.properties.trip_id"), F.lit(1)).alias("trip_id"),
        fail(is_point, c[1], "a feature is not a Point").cast("double").alias("lat"), fail(is_point, c[0], "a feature is not a Point").cast("double").alias("lon"),
        instant(fail(F.col("f.properties.timestamp").isNotNull(), F.col("f.properties.timestamp"), "a feature has no timestamp")).alias("ts"),
    )


_READERS = {"gpx": read_gpx, "csv": read_csv, "geojson": read_geojson, "json": read_geojson}


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Read by extension, which is case-sensitive."""
    kind = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    if kind not in _READERS:
        raise ValueError(f"unsupported file format: {path}")
    return _READERS[kind](spark, path)


def read_folder(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """(file, seq, trip_id, lat, lon, ts) of all files in a folder and those below, each read by its extension; seq and
    trip_id are those within the file, see :func:`merged_files`. Names that begin with a dot or underscore don't count.

    With a ``kind`` (gpx or geojson), all files are of it, whatever their names, and Spark finds them; without, the
    driver lists them one by one, as it must see their extensions."""
    if kind is not None:
        if kind not in ("gpx", "geojson"):
            raise ValueError(f"files of this kind are read by their names only: {kind}")
        return _READERS[kind](spark, folder, with_file=True, nested=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, by_kind = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), {}
    while found.hasNext():
        file = found.next().getPath()
        if not file.getName().startswith((".", "_")):
            by_kind.setdefault(file.getName().rsplit(".", 1)[-1], []).append(file.toString())
    if not by_kind or set(by_kind) - set(_READERS):
        raise ValueError(f"unsupported file format in {folder}: {sorted(set(by_kind) - set(_READERS))}" if by_kind else f"no files in {folder}")
    parts = []
    for kind, paths in sorted(by_kind.items()):
        parts.append(_READERS[kind](spark, paths, with_file=True))
    return functools.reduce(DataFrame.unionByName, parts)


def merged_files(points: DataFrame) -> DataFrame:
    """Points of many files (file, seq, trip_id, ...) as those of one: trips numbered by file and trip from 1, points by
    file and seq from 0."""
    trips = ranked(points.select("file", "trip_id").distinct(), "file", "trip_id", out="n")
    rows = points.join(trips, ["file", "trip_id"]).withColumn("trip_id", (F.col("n") + 1).cast("int")).drop("n").withColumnRenamed("seq", "own")
    return ranked(rows, "file", "own", out="seq").select("seq", "trip_id", "lat", "lon", "ts")


def list_samples(folder: str) -> list[str]:
    return sorted(f for f in os.listdir(folder) if "." in f)


def read_sample(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if "/" in name or "\\" in name or ".." in name:
        raise ValueError("a sample's name must not hold a path")
    if name not in list_samples(folder):
        raise ValueError(f"no sample named {name}")
    return read_points(spark, os.path.join(folder, name))


def points_of_events(events: DataFrame) -> DataFrame:
    """GPS points made from an event table, for tests and benchmarks without coordinates of their own: trips are
    users, coordinates are whole micro-degrees that follow from the event's id, and some are invalid, without a time
    or repeated."""
    i, u = F.col("event_id"), F.col("user_id")
    lat = F.when(i % 97 == 0, 0).when(i % 89 == 0, 95_000_000).otherwise(48_000_000 + (u % 5) * 1_000_000 + ((i * 7919) % 10007) * 20)
    lon = F.when(i % 97 == 0, 0).otherwise(17_000_000 + ((i * 104729) % 10009) * 20)
    ts = F.when(i % 41 == 0, None).otherwise(F.col("ts").cast("timestamp"))
    points = events.select(i.alias("seq"), u.cast("int").alias("trip_id"), (lat / 1e6).alias("lat"), (lon / 1e6).alias("lon"), ts.alias("ts"))
    return points.unionByName(points.where("seq % 53 = 0").withColumn("seq", F.col("seq") + 1_000_000_000))
