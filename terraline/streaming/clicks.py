"""The debounce over a stream of clicks: state is each user's last accepted click."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terraline.operators.clicks import METRES, SECONDS, accepted
from terraline.streaming.ordered import ordered_fold


def debounce_stream(clicks: DataFrame, by: str = "user_id", late: str = "10 seconds", seconds: float = SECONDS, metres: float = METRES, idle_seconds: float | None = 3600.0) -> DataFrame:
    """The accepted rows of a streaming (by, ts, lat, lon, ...): what ``operators.clicks.debounce`` accepts of the same rows,
    in whatever order they come within ``late``. A click is compared with no click from over ``idle_seconds`` before it,
    and a user's state goes once the watermark is as far."""

    def fold(known, us, row):
        now = us / 1e6
        last = None if known is None else (known[0] / 1e6, known[1], known[2])
        if accepted(last, now, row["lat"], row["lon"], seconds, metres, idle_seconds):
            return (us, float(row["lat"]), float(row["lon"])), ()
        return known, None

    return ordered_fold(clicks.withWatermark("ts", late), by, "ts", fold, "us long, lat double, lon double", idle_seconds=idle_seconds)
