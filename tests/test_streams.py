"""Each stream gives what its batch operator gives over the same input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.operators import account
from jobloom.streaming import streams


def run(spark, df, name, mode="append", sink=None):
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True)
    q = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()
    return None if sink else spark.table(name)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    """``transformWithState`` needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def folder(tmp_path, spark, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_daily_counts(spark, sf_dir, events):
    got = {tuple(r) for r in run(spark, streams.daily_counts(events), "daily", "complete").collect()}
    want = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("day"), "event_type").count()
    assert got == {tuple(r) for r in want.collect()}


def test_visits(spark, sf_dir, events):
    got = run(spark, streams.visits(events, "6 hours", late="60 days"), "visits", "complete").select("user_id", F.col("started").cast("timestamp_ntz"), "n")
    want = account.visits(spark.read.parquet(f"{sf_dir}/events.parquet"), "6 hours").select("user_id", "started", "n")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_changed_snapshots(spark, tmp_path):
    stream = folder(tmp_path, spark, [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None), (2, 2, ""), (1, 4, "a")], "source_id long, poll long, body string")
    assert {(r.source_id, r.poll) for r in run(spark, streams.changed_snapshots(stream), "changed").collect()} == {(1, 1), (1, 3), (1, 4), (2, 1)}


def test_absences_close_at_the_second_miss(spark, tmp_path):
    stream = folder(tmp_path, spark, [(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (2, 1, "c"), (2, 2, None)], "source_id long, poll long, external_id string")
    assert {tuple(r) for r in run(spark, streams.absences(stream), "absent").collect()} == {(1, "b", 1, False), (1, "b", 2, True), (2, "c", 1, False)}


def test_unique_jobs(spark, tmp_path):
    stream = folder(tmp_path, spark, [("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 00:05:00"), ("y", "2024-01-01 00:01:00")], "job string, at string").withColumn("ts", F.to_timestamp("at"))
    assert sorted(r.job for r in run(spark, streams.unique_jobs(stream, ["job"]), "jobs").collect()) == ["x", "y"]


def test_batches_are_written_once(spark, tmp_path):
    stream = folder(tmp_path, spark, [(1,), (2,)], "id long")
    out = str(tmp_path / "out")
    run(spark, stream, "sink", sink=streams.once_per_batch(out))
    streams.once_per_batch(out)(spark.createDataFrame([(1,), (2,)], "id long"), 0)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]
