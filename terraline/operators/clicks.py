"""Debounced clicks: one is accepted if it is late and far enough from the last accepted one."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

#: Seconds and metres.
SECONDS, METRES = 0.5, 10.0


def accepted(last, ts: float, lat: float, lon: float, seconds: float = SECONDS, metres: float = METRES, idle: float | None = None) -> bool:
    if last is None or (idle is not None and ts - last[0] > idle):
        return True
    if ts - last[0] < seconds:
        return False
    h = math.sin(math.radians(lat - last[1]) / 2) ** 2 + math.cos(math.radians(last[1])) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - last[2]) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) >= metres


def debounce(clicks: DataFrame, by: str = "user_id", seconds: float = SECONDS, metres: float = METRES, idle_seconds: float | None = None) -> DataFrame:
    """The accepted rows of (by, ts, lat, lon, ...): each user's clicks in order, compared with the last accepted one, unless
    that is more than ``idle_seconds`` ago.
    The fold is carried over sorted batches of a partition, so no user's clicks are gathered in memory."""
    names = clicks.columns

    def run(frames):
        user, last = None, None
        for frame in frames:
            keep = []
            for i, (u, t, lat, lon) in enumerate(zip(frame[by], frame["ts"], frame["lat"], frame["lon"])):
                if u != user:
                    user, last = u, None
                now = t.timestamp()
                if accepted(last, now, lat, lon, seconds, metres, idle_seconds):
                    last = (now, lat, lon)
                    keep.append(i)
            yield frame.iloc[keep][names] if keep else pd.DataFrame(columns=names)

    return clicks.repartition(by).sortWithinPartitions(by, "ts").mapInPandas(run, clicks.schema)
