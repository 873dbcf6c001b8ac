"""The speed filter over a stream: one carried point per trip."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadloom.functions.geo import haversine_m

_SCHEMA = "seq long, trip_id int, lat double, lon double, ts timestamp"


def stream_speed_filter(points: DataFrame, max_speed_kmh: float = 200.0, expire_s: float | None = None, late_s: float = 3600.0) -> DataFrame:
    """The points of a stream (seq, trip_id, lat, lon, ts) that can be reached in time from the trip's last accepted
    point that has a time. Points of one micro-batch are taken in order of time; one that comes before the carried
    point is kept and not compared with, as one of the same second is.

    ``expire_s``: a trip's carried point is forgotten when the stream's time has passed it by so many seconds, so that
    state doesn't grow with all trips that ever were; a later point begins the trip anew. The stream's time is the
    latest one seen less ``late_s``; points before it come too late and are dropped. Without ``expire_s`` every trip's
    point is carried for ever, and nothing is late.
    """
    limit = max_speed_kmh / 3.6
    if expire_s is not None:
        points = points.withWatermark("ts", f"{int(late_s * 1000)} milliseconds")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"], na_position="last")
        keep = []
        for y, x, ts in zip(rows["lat"], rows["lon"], rows["ts"], strict=True):
            ok = True
            if not pd.isna(ts):
                us = ts.value // 1000
                seconds = (us - last[2]) // 1_000_000 if last else 1
                if last is None:
                    last = (y, x, us)
                elif seconds > 0:
                    ok = haversine_m(last[0], last[1], y, x) / seconds <= limit
                    last = (y, x, us) if ok else last
            keep.append(ok)
        if last:
            state.update(last)
            if expire_s is not None:
                # A time of the past would be refused: the trip then goes with the next step of the stream's time.
                state.setTimeoutTimestamp(max(int(last[2] / 1000 + expire_s * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    return points.groupBy("trip_id").applyInPandasWithState(fold, _SCHEMA, "lat double, lon double, us long", "append", GroupStateTimeout.NoTimeout if expire_s is None else GroupStateTimeout.EventTimeTimeout)
