"""Folds over a stream's rows in the order of their time, a state a key.

Rows of a micro-batch come in any order, and later micro-batches may hold earlier rows. A key's rows therefore wait in state
until the watermark has passed them; an event-time timer a key wakes it for the earliest one, and all that the watermark
has passed go through the fold in order. Rows behind the watermark are dropped by Spark before they come here. With ``idle``
a second use of the timer removes a key's state once nothing can meet it any more, so state grows with the keys of
that span and not with all that ever came. State lies in RocksDB, as its operator wants it (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The time's column on its way through the state; Spark renames columns that begin with an underscore there.
MICROS = "event_micros"

#: fold(state or None, microseconds, row) to (new state, values of the new columns, or None for no row).
Fold = Callable[[tuple | None, int, dict[str, Any]], tuple[tuple, tuple | None]]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, columns: list[str], waiting: T.StructType, state: str, added: list[str], idle: int | None):
        self.fold, self.columns, self.kinds, self.state, self.added, self.idle = fold, columns, waiting, state, added, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.state)
        self.waiting = handle.getListState("waiting", self.kinds)

    def handleInputRows(self, key, rows, timerValues):
        came = [tuple(None if v is pd.NaT or v is pd.NA or v != v else v for v in r) for frame in rows for r in frame[self.columns].astype(object).itertuples(index=False)]
        yield from self.upto(timerValues.getCurrentWatermarkInMs(), came)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.upto(timerValues.getCurrentWatermarkInMs(), [])

    def upto(self, watermark: int, came: list[tuple]):
        """Folds what the watermark has passed and sets the timer for what has not."""
        held = [*(self.waiting.get() if self.waiting.exists() else ()), *came]
        held.sort(key=lambda r: r[0])
        known = self.known.get() if self.known.exists() else None
        out, rest, last = [], [], None
        for r in held:
            if r[0] > watermark * 1000:
                rest.append(r)
                continue
            known, new = self.fold(known, r[0], dict(zip(self.columns, r)))
            last = r[0]
            if new is not None:
                out.append((*r, *new))
        if last is not None:
            self.known.update(tuple(known))
        (self.waiting.put(rest) if rest else self.waiting.clear())
        self.next(watermark, rest, known, last)
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, *self.added])

    def next(self, watermark: int, rest: list[tuple], known: tuple | None, last: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(max(watermark + 1, -(-rest[0][0] // 1000)))
        elif self.idle is not None and known is not None:
            # The state's first value is the time from which idleness counts.
            ends = (int(known[0]) + self.idle) // 1000 + 1
            if ends <= watermark:
                self.known.clear()
            else:
                self.handle.registerTimer(ends)

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, by: str, ts: str, fold: Fold, state: str, added: str = "", idle_seconds: float | None = None) -> DataFrame:
    """``stream`` (with a watermark on ``ts``) in order of time and ``added`` columns as ``fold`` gives them. With
    ``idle_seconds`` the first field of ``state`` is a time in microseconds, and a state is removed that long after it."""
    rest = [f for f in stream.schema.fields if f.name != ts]
    more = T._parse_datatype_string(added).fields if added else []
    micros = T.StructField(MICROS, T.LongType())
    waiting = T.StructType([micros, *rest])
    processor = _Ordered(fold, [f.name for f in waiting.fields], waiting, state, [f.name for f in more], None if idle_seconds is None else int(idle_seconds * 1e6))
    out = T.StructType([micros, *rest, *more])
    folded = stream.withColumn(MICROS, F.unix_micros(ts)).groupBy(by).transformWithStateInPandas(processor, out, "append", "eventTime")
    return folded.select(*[F.timestamp_micros(MICROS).alias(ts) if c == ts else c for c in stream.columns], *[f.name for f in more])
