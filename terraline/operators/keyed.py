"""Keyed tables: upserts, inserts of absent keys, deletes, scans of JSON maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``table`` with the rows of ``changes``: they replace whole rows of their keys. Of several changes of one key the last
    by ``order`` counts (by all its values if none is given)."""
    others = [F.col(order).desc_nulls_last()] if order else [F.col(c).desc_nulls_last() for c in table.columns if c != key]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*others or [F.lit(0)]))
    new = changes.withColumn("_place", place).where("_place = 1").select(F.col(key).alias("_key"), F.struct(*[c for c in table.columns]).alias("_new"))
    old = table.select(F.col(key).alias("_old_key"), F.struct(*table.columns).alias("_old"))
    both = old.join(new, F.col("_old_key") == F.col("_key"), "full")
    return both.select(F.coalesce("_new", "_old").alias("r")).select("r.*")


def insert_absent(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with the rows whose keys it lacked, and the rows that were refused. Of several new rows of one key the
    first by ``order`` (by all its values if none is given) goes in and the rest are refused."""
    others = [F.col(order)] if order else [F.col(c).asc_nulls_first() for c in rows.columns if c != key]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*others or [F.lit(0)]))
    dealt = rows.withColumn("_place", place).join(table.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    new = F.col("_known").isNull() & (F.col("_place") == 1)
    return table.unionByName(dealt.where(new).select(*table.columns)), dealt.where(~new).select(*rows.columns)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def json_map(text: Column, fields: tuple[str, ...]) -> Column:
    """array<struct<code, fields...>> of a JSON object of objects; entries that aren't objects are left out, and a list
    or no JSON gives null."""
    entries = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    rows = F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].alias("code"), e["value"].startswith("{").alias("_ok"), *[F.get_json_object(e["value"], f"$.{f}").alias(f) for f in fields]))
    return F.when(~F.ltrim(text).startswith("["), F.filter(rows, lambda r: r["_ok"]))


def json_rows(text: Column) -> Column:
    """array<struct<code, fields: map>> of a JSON object of objects with whatever fields each has, values as JSON texts."""
    entries = F.map_entries(F.from_json(text, T.MapType(T.StringType(), T.StringType())))
    rows = F.transform(F.filter(entries, lambda e: e["value"].startswith("{")), lambda e: F.struct(e["key"].alias("code"), F.from_json(e["value"], T.MapType(T.StringType(), T.StringType())).alias("fields")))
    return F.when(~F.ltrim(text).startswith("["), rows)


def map_status(text: Column) -> Column:
    """"no data" for nothing, null, {} or a falsy value, "format" where no entry is an object, else "ok"."""
    t = F.trim(text)
    return F.when(t.isNull() | t.isin("", "null", "{}", "[]", "0", "false", '""'), "no data").when(F.coalesce(F.size(json_rows(text)), F.lit(0)) <= 0, "format").otherwise("ok")


def all_fields(rows: DataFrame) -> list[str]:
    """The fields that any of the rows (code, fields) has, in order; the only thing that comes to the driver."""
    return sorted(r[0] for r in rows.select(F.explode(F.map_keys("fields"))).distinct().collect())


def unioned(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows (code, fields) as a table: code first, then every field of any row, null where a row lacks it."""
    names = all_fields(rows) if names is None else names
    return rows.select("code", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names if n != "code"])


def repdigits(spark, value: int, status: str, stamp: str) -> DataFrame:
    """Codes 11111 to 99999 with a value, a status and a given time."""
    return spark.range(1, 10).select(F.repeat(F.col("id").cast("string"), 5).alias("code"), F.lit(status).alias("status"), F.lit(value).alias("value"), F.lit(stamp).alias("timestamp"), F.lit("repdigit").alias("type"))
