from __future__ import annotations

from roadloom.operators import trips
from roadloom.streaming.speed import stream_speed_filter


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 2, 48.0 + (i * 37 % 11) * 0.01, 17.0, i * 60_000_000) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, trip_id int, lat double, lon double, us long").selectExpr("seq", "trip_id", "lat", "lon", "timestamp_micros(us) as ts")
    for part in range(2):
        df.where(f"seq div 20 = {part}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"file://{tmp_path}/in")
    query = stream_speed_filter(stream, 100).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(r["seq"] for r in spark.table("kept").collect())
    want = sorted(r["seq"] for r in trips.speed_filter(df, 100).collect())
    assert got == want and 2 < len(got) < 40


def test_trips_expire(spark, tmp_path):
    """The state of trips that have ended goes, though the query stops and goes on from its checkpoint in between; late
    points are dropped, and what is left equals the batch."""
    hour = 3_600_000_000
    rows = [(trip * 100 + i, trip, 48.0 + (i * 37 % 11) * 0.01, 17.0, 10**15 + trip * 2 * hour + i * 60_000_000) for trip in range(12) for i in range(20)]
    late = [(9999, 0, 48.0, 17.0, 10**15 + 30 * 60_000_000)]
    read = lambda r: spark.createDataFrame(r, "seq long, trip_id int, lat double, lon double, us long").selectExpr("seq", "trip_id", "lat", "lon", "timestamp_micros(us) as ts")
    held = []
    for turn in range(4):
        for trip in range(turn * 3, turn * 3 + 3):
            read([r for r in rows if r[1] == trip]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        if turn == 3:
            read(late).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(read(rows).schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        kept = stream_speed_filter(stream, 100, expire_s=1800.0, late_s=600.0)
        query = kept.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted(r["seq"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == sorted(r["seq"] for r in trips.speed_filter(read(rows), 100).collect())
    assert max(held) <= 3
