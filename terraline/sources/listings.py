"""Listings of files, kept graphs, mirrors and plain sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the first character of a text file that says it is UTF-8.
MARK = "﻿"


def documents(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(name, value) of the text files below a folder whose names end so, in any case; each is one value."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("name"), "value").where(F.lower("name").endswith(suffix))


def archives(spark: SparkSession, path: str, suffix: str = ".zip") -> DataFrame:
    """(name, length, sha256, content) of the binary files below a folder whose names end so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_name").alias("name"), "length", F.sha2("content", 256).alias("sha256"), "content").where(F.lower("name").endswith(suffix))


def preview(texts: DataFrame, text: str = "value", most: int = 500) -> DataFrame:
    """Adds the first characters of each text."""
    return texts.withColumn("preview", F.substring(text, 1, most))


def json_files(entries: DataFrame) -> DataFrame:
    """(name, url) of the files ending in .json, in any case, of a listing (type, name, download_url)."""
    return entries.where((F.col("type") == "file") & F.lower("name").endswith(".json")).select("name", F.col("download_url").alias("url"))


def cache_archives(entries: DataFrame) -> DataFrame:
    """(name, url, size_kb) of the archives of kept graphs in a listing (name, download_url, size)."""
    return entries.where(F.col("name").endswith("_cache.zip")).select("name", F.coalesce("download_url", F.lit("")).alias("url"), F.expr("coalesce(size, 0) div 1024").alias("size_kb"))


def valid_members(names: DataFrame, prefix: str = "osm_graph_", suffix: str = ".parquet") -> DataFrame:
    """Names of an archive with ``valid``: kept graphs only, without a folder."""
    n = F.col("name")
    return names.withColumn("valid", n.startswith(prefix) & n.endswith(suffix) & ~n.contains("/") & ~n.contains("\\"))


def to_import(given: DataFrame, kept: DataFrame, key: str = "cache_key") -> DataFrame:
    """Given graphs with ``action``: "skipped" where the key is kept already, else "imported"."""
    have = kept.select(key, F.lit(True).alias("_kept")).distinct()
    return given.join(have, key, "left").withColumn("action", F.when(F.col("_kept"), "skipped").otherwise("imported")).drop("_kept")


def copy_graphs(spark: SparkSession, source: str, target: str, kept: DataFrame, key: str = "cache_key") -> DataFrame:
    """Appends the graphs of ``source``, Parquet by ``key``, that ``target`` lacks, and returns what was done by key."""
    given = spark.read.parquet(source)
    found = to_import(given.select(key).distinct(), kept, key)
    new = given.join(F.broadcast(found.where("action = 'imported'").select(key)), key, "left_semi")
    new.write.mode("append").partitionBy(key).parquet(target)
    return found


def cache_stats(files: DataFrame) -> DataFrame:
    """(count, size_mb) of files (path, length)."""
    return files.agg(F.count("*").alias("count"), (F.coalesce(F.sum("length"), F.lit(0)) / (1024.0 * 1024.0)).alias("size_mb"))


def mirrors_in_order(mirrors: Column, last_good: Column) -> Column:
    """The mirrors to try: the one that worked last, then the others in their order, each once."""
    return F.array_distinct(F.concat(F.when(last_good.isNotNull(), F.array(last_good)).otherwise(F.array().cast("array<string>")), mirrors))


def first_answer(answers: DataFrame, mirrors: Column) -> DataFrame:
    """(request, mirror, status, error) from answers (request, mirror, ok, retriable, error), tried in the order of an
    array of mirrors: the first that is good, or the first failure that no other mirror can mend, else "none reachable"."""
    tried = answers.withColumn("at", F.array_position(mirrors, F.col("mirror"))).where("at > 0")
    ends = tried.where("ok or not retriable").groupBy("request").agg(F.min_by(F.struct("mirror", "ok", "error"), "at").alias("e"))
    return tried.select("request").distinct().join(ends, "request", "left").select("request", "e.mirror", F.when(F.col("e.ok"), "ok").when(F.col("e").isNotNull(), "failed").otherwise("none reachable").alias("status"), F.when(~F.col("e.ok"), F.col("e.error")).alias("error"))


def fetch_status(code: Column) -> Column:
    """What an answer's code says about a source."""
    return F.when(code == 200, "ok").when(code == 401, "wrong key").when(code == 403, "no access").when(code == 429, "too many requests").otherwise(F.format_string("error %d", code))


def merged(defaults: DataFrame, remote: DataFrame) -> DataFrame:
    """Settings (key, value): remote values for keys that the defaults have; other keys are not taken."""
    r = remote.groupBy("key").agg(F.first("value").alias("_remote"))
    return defaults.join(r, "key", "left").select("key", F.coalesce("_remote", "value").alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header that begins with the UTF-8 mark; for small reports only."""
    first, *rest = df.columns
    df.withColumnRenamed(first, MARK + first).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def minified_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.json$", "_minified.json")
