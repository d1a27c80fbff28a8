"""Ordered folds over streams: the same as their batch forms in whatever order rows come, and state that goes."""

import random

import pytest
from pyspark.sql import functions as F

from terraline.functions import payoff
from terraline.operators import clicks
from terraline.streaming.clicks import debounce_stream
from terraline.streaming.ordered import use_rocksdb
from terraline.streaming.rollover import rollover_stream

START = 1_700_000_000


def micro_batches(spark, df, ts, path, seconds, seed):
    """``df`` in files of some seconds each, of rows in any order, each row up to one file early or late."""
    rng = random.Random(seed)
    rows = sorted(df.collect(), key=lambda r: (r[ts].timestamp() // seconds + rng.choice([0, 0, 1]), rng.random()))
    cut = [rows[i : i + 25] for i in range(0, len(rows), 25)]
    for k, some in enumerate(cut):
        spark.createDataFrame(some, df.schema).coalesce(1).write.parquet(f"{path}/part={k:03d}")


def run(spark, tmp_path, df, ts, make, name, seconds=5):
    micro_batches(spark, df, ts, f"{tmp_path}/in", seconds, 3)
    use_rocksdb(spark)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table(name).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(1)
    rows = [(k, k % 5, START + rng.uniform(0, 40), 20 + rng.randint(0, 2) * 0.00007, 100.0, "own") for k in range(160)] + [(1000 + k, 3, START + 400.0 + k, 20.0, 100.0, None) for k in range(20)]
    made = spark.createDataFrame(rows, "id long, user_id int, t double, lat double, lon double, note string")
    return made.select("id", "user_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "lat", "lon", "note")


def test_clicks_in_any_order(spark, many, tmp_path):
    """All rows but the last span's, for which the watermark has not come yet, as in the batch; users' states go."""
    got, held = run(spark, tmp_path, many, "ts", lambda s: debounce_stream(s, late="20 seconds", idle_seconds=60.0), "clicks_any")
    want = clicks.debounce(many, idle_seconds=60.0).collect()
    seen = lambda rows: sorted((r.id, r.user_id, r.ts, r.lat, r.note or "") for r in rows if r.ts.timestamp() < START + 300)
    assert seen(got) == seen(want) and 5 < len(seen(want)) < 160
    assert held[-1] < max(held)


def test_rollover_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, k % 3, START + 0.7 * k, rng.choice([True, False, None]), rng.choice([None, 1.5, -2.0]), rng.uniform(-9, 9), rng.choice([0.0, 5.0, 7.0]), 6.0, 3.0, 2.0, 4.0) for k in range(120)]
    made = spark.createDataFrame(rows, "id long, k int, t double, on boolean, b1 double, b2 double, x0_1 double, x0_2 double, refConst double, constant1 double, constant2 double")
    df = made.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t")
    got, _ = run(spark, tmp_path, df, "ts", lambda s: rollover_stream(s, "k", "ts", "on", late="20 seconds"), "rolls_any")
    close = lambda v: None if v is None else round(v, 9)
    said = {r.id: (close(r.b1_new), close(r.b2_new)) for r in got}
    want = {r.id: (close(r.b1_new), close(r.b2_new)) for r in payoff.rollover(df, "k", "ts", "on").collect()}
    assert len(said) > 60 and all(want[k] == v for k, v in said.items())
    assert len({v for v in want.values()}) > 20


def test_an_idle_user_starts_anew(spark):
    rows = [(1, START, 20.0, 100.0), (1, START + 30, 20.0, 100.0), (1, START + 100, 20.0, 100.0)]
    df = spark.createDataFrame(rows, "user_id int, t long, lat double, lon double").select("user_id", F.timestamp_seconds("t").alias("ts"), "lat", "lon")
    assert clicks.debounce(df).count() == 1 and clicks.debounce(df, idle_seconds=60.0).count() == 2
