"""Pruning and minifying of JSON documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that go at every depth.
PRUNED = ("interface", "expect", "designer", "restore")




def _pruned(x, keys):
    if isinstance(x, dict):
        return {k: _pruned(v, keys) for k, v in x.items() if k not in keys}
    return [_pruned(v, keys) for v in x] if isinstance(x, list) else x


def prune_minify(text: Column, keys: tuple[str, ...] = PRUNED) -> Column:
    """The document without ``keys`` and without blanks, in its own key order; null if it is no JSON."""
    drop = frozenset(keys)

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else json.dumps(_pruned(json.loads(v), drop), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return values.map(one)

    return clean(text)


def reduction(docs: DataFrame, text: str, minified: str) -> DataFrame:
    """Adds size_before, size_after (characters) and reduction in percent; null for an empty document."""
    a, b = F.length(text), F.length(minified)
    return docs.withColumns({"size_before": a, "size_after": b, "reduction": F.when(a > 0, 100.0 * (a - b) / a)})
