"""Cleaning of trips: valid coordinates, plausible speeds, no exact duplicates, at least two points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.geo import haversine_m, valid_coordinate

COLUMNS = ("seq", "trip_id", "lat", "lon", "ts")


def valid_points(points: DataFrame) -> DataFrame:
    return points.where(valid_coordinate(F.col("lat"), F.col("lon")))


def trip_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("trip_id").agg(F.count("*").alias("n_points"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def in_order(points: DataFrame) -> W:
    return W.partitionBy("trip_id").orderBy(F.asc_nulls_last("ts"), "seq")


def speed_filter(points: DataFrame, max_speed_kmh: float = 200.0) -> DataFrame:
    """Drop points that can't be reached in time from the last accepted point that has a time.

    Whole seconds count. A point without a time, or in the same second, is kept but isn't compared with afterwards;
    a trip's first point is always kept. The fold goes through sorted partitions batch by batch with one carried
    point, so a trip of any length needs no more memory than a batch.
    """
    limit = max_speed_kmh / 3.6
    rows = points.select(*COLUMNS).repartition("trip_id").sortWithinPartitions("trip_id", F.asc_nulls_last("ts"), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip, last = object(), None
        for b in batches:
            ids, lats, lons = (b.column(i).to_pylist() for i in (1, 2, 3))
            times = b.column(4).cast(pa.int64()).to_pylist()
            keep = np.ones(b.num_rows, bool)
            for i, (t, y, x, us) in enumerate(zip(ids, lats, lons, times, strict=True)):
                if t != trip:
                    trip, last = t, None
                    if us is not None:
                        last = (y, x, us)
                    continue
                if us is None:
                    continue
                if last is None:
                    last = (y, x, us)
                    continue
                seconds = (us - last[2]) // 1_000_000
                if seconds <= 0:
                    continue
                if haversine_m(last[0], last[1], y, x) / seconds <= limit:
                    last = (y, x, us)
                else:
                    keep[i] = False
            yield b.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def distinct_points(points: DataFrame) -> DataFrame:
    """The first of points equal in trip, place and time: partial minima, without a sort."""
    same = ["trip_id", "lat", "lon", "ts"]
    rest = [c for c in points.columns if c not in same]
    first = points.groupBy(*same).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return first.select(*[c if c in same else F.col(f"r.{c}").alias(c) for c in points.columns])


def long_trips(points: DataFrame, least: int = 2) -> DataFrame:
    sizes = points.groupBy("trip_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return points.join(sizes, "trip_id", "left_semi")


def clean_trips(points: DataFrame, max_speed_kmh: float = 200.0) -> DataFrame:
    """All steps in their order: coordinates, speeds, duplicates, length."""
    return long_trips(distinct_points(speed_filter(valid_points(points), max_speed_kmh)))


def numbered(points: DataFrame) -> DataFrame:
    """Points with ``pos`` from 0 along their trip."""
    return points.withColumn("pos", F.row_number().over(in_order(points)) - 1)
