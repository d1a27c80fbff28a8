"""Exact dedup against a persistent index of digests, in Spark expressions only.

A text's digest is the SHA-256 of its bytes with A-Z in lower case. The index is an external table of (digest, keep_id,
batch), a folder of Parquet files partitioned by batch, bucketed and sorted by digest: whoever knows the folder opens it
again in a new session. A batch of documents is deduplicated in these steps:

1. Digests are written beside document ids; texts are read once and stay where they are.
2. Rows are aggregated by digest, first within each task, so a group of copies of any size sends one row a task.
3. What is left is anti-joined with the index: both sides are bucketed by digest, so only the batch is shuffled and the
   index is merged bucket by bucket. Digests that it didn't have are appended as the batch's partition.
4. Each row looks up its group. Groups with over ``1 / HEAVY`` of all rows, of which there are at most ``HEAVY``, are
   broadcast; the rows of all others meet their groups in a merge by digest, no key of which is heavy.

A batch that is run again under its name sees the index as it was without it and replaces its own partition, so a driver
that was lost half way can start over.

Defined results: a null text is empty; of equal texts the row with the largest id stays, null ids last, and of rows that
repeat an id one; texts that an earlier batch holds all go, to its ``keep_id``; ``group_size`` counts the batch's own rows;
columns named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraline.session import discard, written

#: Groups of copies that may be broadcast: those with more than one row in so many.
HEAVY = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case and nothing else; texts of ASCII alone take Spark's faster ``lower``."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """An index's folder, its table's name in this session and its number of buckets, which never changes."""

    folder: str
    table: str
    buckets: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)


def open_index(spark: SparkSession, folder: str, kind: str = "bigint", buckets: int | None = None) -> DigestIndex:
    """Opens the index in ``folder``, or makes it with ``buckets`` (by default the session's shuffle partitions) for ids of
    type ``kind``. The number of buckets lies in the folder, as the table's own property would be lost with the session."""
    place = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    files = place("rows").getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place("rows"))
    note = place("_format").toString()
    if files.exists(place("_format")):
        known = spark.read.json(note).first()
        buckets, kind = known.buckets, known.kind
    else:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(kind).alias("kind")).coalesce(1).write.json(note)
    name = "digests_" + md5(folder.encode()).hexdigest()
    spark.sql(f"create table if not exists {name} (digest binary, keep_id {kind}, batch string) using parquet partitioned by (batch) clustered by (digest) sorted by (digest) into {buckets} buckets location '{folder}/rows'")
    spark.sql(f"msck repair table {name}")  # batches that other sessions have added
    return DigestIndex(folder, name, buckets)


def verdicts(docs: DataFrame, index: DigestIndex, batch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept), a row for each row of ``docs``; adds the batch to the index."""
    spark = docs.sparkSession
    digests = written(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("_row")), "digests")
    best = F.max(F.struct("doc_id", "_row"))
    groups = written(digests.groupBy("digest").agg(best.alias("_best"), F.count("*").alias("group_size")), "digest-groups")
    by_bucket = groups.repartition(index.buckets, "digest").hint("merge")
    earlier = index.rows(spark).where(F.col("batch") != batch)
    new = written(by_bucket.join(earlier, "digest", "left_anti").select("digest", F.col("_best.doc_id").alias("keep_id")), "new-digests")
    new.repartition(index.buckets, "digest").createOrReplaceTempView(f"new_{index.table}")
    name = batch.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"insert overwrite table {index.table} partition (batch = '{name}') select digest, keep_id from new_{index.table}")
    spark.catalog.dropTempView(f"new_{index.table}")
    discard(new)
    met = by_bucket.join(index.rows(spark), "digest")
    groups = written(met.select("digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("_best._row")).alias("_keep")), "digest-keepers")
    many = F.col("group_size") > F.lit(digests.count()) / HEAVY
    heavy, light = F.broadcast(groups.where(many)), groups.where(~many)
    found = digests.join(heavy, "digest").unionByName(digests.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest"))
    return found.select("doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("_row") == F.col("_keep"), F.lit(False)).alias("kept"))


def without_copies(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, by the verdicts on them; of rows that repeat id and text one."""
    mine = docs.withColumn("_digest", digest(F.col(text)))
    stay = found.where("kept").select(F.col("digest").alias("_d"), F.col("doc_id").alias("_i"))
    left = mine.join(stay, (F.col("_digest") == F.col("_d")) & F.col(doc_id).eqNullSafe(F.col("_i")), "left_semi")
    return left.groupBy("_digest").agg(F.first(F.struct(*docs.columns)).alias("_one")).select("_one.*")
