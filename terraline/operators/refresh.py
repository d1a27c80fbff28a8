"""Layers of results that are computed again only if something they rest on has changed.

A layer's key is a digest of its name and version and of the keys of its inputs; a table's key is a digest of its
schema and rows, whatever their order. The result is kept as Parquet in a folder named by layer and key: the same inputs
find it there, in this session or another one, until its time to live is over; other inputs make another folder, and going
back to earlier inputs finds the earlier result. How many rows a layer wrote is observed while it is written.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Fixed value: seconds that a result is kept.
TIME_TO_LIVE = 3600


@dataclass(frozen=True)
class Layer:
    """``make`` takes the tables of ``inputs`` in their order; ``version`` stands for its parameters."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: str = ""


def digest(*parts: object) -> str:
    return sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:32]


def content_key(table: DataFrame) -> str:
    """Equal for tables of equal schemas and rows; one aggregate over the table."""
    ordered = sorted(table.columns)
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *ordered).cast("decimal(38,0)"))
    return digest(table.select(*ordered).schema.json(), *table.agg(F.count("*"), total(1), total(2)).first())


@dataclass(frozen=True)
class Store:
    """Kept results below ``folder``, for ``seconds`` from when they were written."""

    spark: SparkSession
    folder: str
    seconds: float = TIME_TO_LIVE

    def _at(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder.rstrip("/"), *names)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def written_at(self, layer: str, key: str) -> float | None:
        """Seconds since 1970, if the result is there and whole."""
        path, files = self._at(layer, key, "_SUCCESS")
        return files.getFileStatus(path).getModificationTime() / 1000 if files.exists(path) else None

    def kept(self, layer: str, key: str, now: float) -> DataFrame | None:
        at = self.written_at(layer, key)
        return None if at is None or now - at >= self.seconds else self.spark.read.parquet(self._at(layer, key)[0].toString())

    def keep(self, layer: str, key: str, table: DataFrame) -> tuple[DataFrame, int]:
        """Writes a result; (the table as it is kept, its rows)."""
        seen, path = Observation(), self._at(layer, key)[0].toString()
        table.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path), seen.get["rows"]

    def expire(self, now: float) -> int:
        """Removes results that are past their time; how many."""
        root, files = self._at()
        gone = 0
        for layer in files.listStatus(root) if files.exists(root) else ():
            for key in files.listStatus(layer.getPath()):
                at = self.written_at(layer.getPath().getName(), key.getPath().getName())
                if at is not None and now - at >= self.seconds:
                    gone += files.delete(key.getPath(), True)
        return gone


@dataclass(frozen=True)
class Refreshed:
    """``tables`` by layer, none for those that failed; ``statuses``: (layer, status, rows, key, error), with status kept,
    computed, failed, or waiting if an input has failed."""

    tables: dict[str, DataFrame]
    statuses: DataFrame


def refresh(layers: list[Layer], inputs: dict[str, DataFrame], store: Store, now: float | None = None) -> Refreshed:
    """Brings layers up to date; each stands after those it rests on. A layer that fails leaves the others as they are, and
    those that rest on it without a result."""
    now = time.time() if now is None else now
    tables, keys, said = dict(inputs), {name: content_key(t) for name, t in inputs.items()}, []
    for layer in layers:
        if any(name not in tables for name in layer.inputs):
            said.append((layer.name, "waiting", None, None, "without " + ", ".join(n for n in layer.inputs if n not in tables)))
            continue
        key = digest(layer.name, layer.version, *(keys[name] for name in layer.inputs))
        found = store.kept(layer.name, key, now)
        status, rows, error = "kept", None, None
        if found is None:
            try:
                found, rows = store.keep(layer.name, key, layer.make(*(tables[name] for name in layer.inputs)))
                status = "computed"
            except Exception as lost:  # whatever a layer runs into is its status
                status, error = "failed", f"{type(lost).__name__}: {str(lost).splitlines()[0] if str(lost) else ''}"[:200]
        else:
            rows = found.count()
        if found is not None:
            tables[layer.name], keys[layer.name] = found, key
        said.append((layer.name, status, rows, key, error))
    statuses = store.spark.createDataFrame(said, "layer string, status string, rows long, key string, error string")
    return Refreshed({layer.name: tables[layer.name] for layer in layers if layer.name in tables}, statuses)
