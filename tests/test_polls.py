"""Polls: slicing, sweeps, what a fetch means; the stream of fetches against the batch."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from jobloom.sources import polls
from jobloom.streaming import streams

from .test_streams import folder, run


def answer(path, page, total, keys, facets=()):
    jobs = [{"title": f"t{k}{path}" if k else " ", "externalPath": str(k)} for k in keys]
    return (1, path, page, json.dumps({"total": total, "jobPostings": jobs, "facets": [{"facetParameter": n, "values": [{"id": v, "count": c} for v, c in vs]} for n, vs in facets]}))


RESPONSES = "source_id long, path string, page int, body string"


def board(spark, rows, cap=4, size=2):
    df = spark.createDataFrame(rows, RESPONSES)
    return df, [(r.external_id, r.title) for r in polls.workday_board(df, cap, size).orderBy("position").collect()]


def test_a_complete_board_is_read_to_its_first_short_page(spark):
    _, got = board(spark, [answer("", 0, 3, [5, 4]), answer("", 1, 3, [3]), answer("", 2, 3, [9, 8])])
    assert got == [("5", "t5"), ("4", "t4"), ("3", "t3")]


def test_a_slice_is_read_as_far_as_its_cap(spark):
    """Postings of a slice below a high cap are all read; at the vendor's cap a slice ends after 110 pages."""
    rows = [answer("", page, 300, [2 * page + 1, 2 * page + 2]) for page in range(150)]
    assert [int(k) for k, _ in board(spark, rows, cap=1000)[1]] == list(range(1, 301))
    assert [int(k) for k, _ in board(spark, rows, cap=200)[1]] == list(range(1, 221))


def test_slices_of_slices(spark):
    """The facet with most counted values cuts; a slice at the cap is cut by the other one; repeats keep place and take content."""
    two, three = ("b", [("x", 4), ("y", 3)]), ("a", [("1", 5), ("2", 1), ("3", 1)])
    rows = [answer("", 0, 4, [1, 2], [("uncounted", [(str(i), 0) for i in range(9)]), two, three]), answer("a=1", 0, 4, [1, 2], [three, two]), answer("a=1&b=x", 0, 2, [2, 3], [three, two]), answer("a=1&b=y", 0, 1, [1], [two]), answer("a=2", 0, 1, [3]), answer("a=3", 0, 1, [7])]
    df, got = board(spark, rows)
    assert got == [("2", "t2a=1&b=x"), ("3", "t3a=2"), ("1", "t1a=1&b=y"), ("7", "t7a=3")]
    assert polls.missing_slices(df, 4).count() == 0
    df, got = board(spark, rows[:1])
    assert got == [("1", "t1"), ("2", "t2")]
    assert sorted(r.path for r in polls.missing_slices(df, 4).collect()) == ["a=1", "a=2", "a=3"]


def test_sweep(spark):
    """Resumes, skips only a finished and unchanged board, starts anew behind a board that shrank, and waits after a cut-off."""
    state = spark.createDataFrame([(1, 2, "h"), (2, -1, "h"), (3, -1, "old"), (4, 9, "h"), (6, 3, "q")], "source_id long, detail_cursor int, content_hash string")
    boards = spark.createDataFrame([(i, "h", 5) for i in (1, 2, 3, 4, 5)], "source_id long, content_hash string, total int")
    plan = polls.sweep_plan(state, boards, 2)
    assert {(r.source_id, r.first, r.last, r.unchanged) for r in plan.collect()} == {(1, 2, 4, False), (2, 0, 0, True), (3, 0, 2, False), (4, 0, 2, False), (5, 0, 2, False)}
    results = spark.createDataFrame([(1, 1, True), (3, 0, True), (4, 0, False)], "source_id long, filled long, cut_off boolean")
    after = {r.source_id: r.detail_cursor for r in polls.sweep_state(state, plan, results).collect()}
    assert after == {1: 4, 2: -1, 3: 0, 4: 2, 5: 2, 6: 3}
    listing = spark.createDataFrame([(1, i, 5) for i in range(5)] + [(2, i, 2) for i in range(2)], "source_id long, place int, total int")
    ring = polls.ring_requests(listing, spark.createDataFrame([(1, 4), (2, 7)], "source_id long, detail_cursor int"), 3).collect()
    assert {(r.source_id, r.place, r.next_cursor) for r in ring} == {(1, 4, 2), (1, 0, 2), (1, 1, 2), (2, 0, 2), (2, 1, 2)}


@pytest.mark.parametrize(
    ("header", "seconds"),
    [("120", 120), (" 7 ", 7), ("0", 0), ("-3", 0), ("soon", 0), (None, 0), ("", 0), ("Sun, 06 Nov 1994 08:50:37 GMT", 60), ("Sunday, 06-Nov-94 08:50:37 GMT", 60), ("Sun Nov  6 08:50:37 1994", 60), ("Sun, 06 Nov 1994 08:49:00 GMT", 0)],
)
def test_retry_after(spark, header, seconds):
    row = spark.range(1).select(polls.retry_micros(F.lit(header).cast("string"), F.lit("1994-11-06 08:49:37").cast("timestamp_ntz")).alias("s")).first()
    assert row.s == seconds * 1_000_000


LOG = [
    ("00:00", 200, "e1", "m1", "a", None, "changed"), ("00:01", 304, " ", None, None, None, "unchanged"), ("00:02", 200, "e2", None, "a", None, "unchanged"), ("00:03", 200, "", "", "b", None, "changed"),
    ("00:04", 429, None, None, None, "60", "limited"), ("00:05", 200, None, None, "c", None, "paused"), ("00:06", 429, None, None, None, None, "limited"), ("00:10", 200, None, None, "c", None, "paused"), ("00:22", None, None, None, None, None, "failed"),
    ("00:23", 500, None, None, None, None, "failed"), ("00:24", 403, None, None, None, None, "failed"), ("00:25", 200, None, None, "z", None, "paused"), ("06:25", 410, None, None, None, None, "gone"), ("23:00", 200, None, None, "z", None, "paused"),
]
SCHEMA = "source_id long, at string, fetch_id long, status int, etag string, last_modified string, body string, retry_after string"


def log(rows):
    return [(s, f"2024-05-01 {at}:00", i, status, etag, modified, body, retry) for s in (1, 2) for i, (at, status, etag, modified, body, retry, _) in enumerate(rows)]


def test_fetch_outcomes(spark, tmp_path):
    timed = lambda df: df.withColumn("fetched_at", F.col("at").cast("timestamp_ntz"))
    batch = polls.fetch_outcomes(timed(spark.createDataFrame(log(LOG), SCHEMA))).orderBy("source_id", "fetch_id").collect()
    assert [r.outcome for r in batch] == [x[-1] for x in LOG] * 2
    assert [r.consecutive_errors for r in batch][: len(LOG)] == [0, 0, 0, 0, 1, 1, 2, 2, 3, 4, 5, 5, 6, 6]
    assert (batch[1].etag, batch[1].last_modified) == ("e1", "m1") and batch[2].etag == "e2" and batch[3].etag is None
    assert str(batch[6].disabled_until) == "2024-05-01 00:21:00" and str(batch[10].disabled_until) == "2024-05-01 06:24:00" and str(batch[12].disabled_until) == "2024-05-02 06:25:00"
    # The same log in two batches of a stream.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log(LOG)
    for i, part in enumerate(([r for r in rows if r[2] < 6], [r for r in rows if r[2] >= 6])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = timed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*")))
    assert sorted(map(tuple, run(spark, streams.fetch_outcomes(stream), "fetches").collect()), key=repr) == sorted(map(tuple, batch), key=repr)


def test_first_dates(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, "x", "2024-01-03", "2024-01-02", True), (1, "x", "2024-01-05", "2024-01-04", False), (1, "x", "2024-01-04", "2024-01-01", False), (1, "x", "2024-01-06", "2024-01-05", False), (2, "x", "2024-01-01", None, False), (2, "y", "2024-01-01", "2023-01-01", False)]
    schema = "source_id long, external_id string, seen string, posted string, posted_at_is_estimate boolean"
    stream = folder(tmp_path, spark, rows, schema).withColumns({"seen_at": F.col("seen").cast("timestamp_ntz"), "posted_at": F.col("posted").cast("timestamp_ntz")})
    # A stream with a clock does not end by itself.
    q = streams.first_dates(stream).writeStream.outputMode("append").format("memory").queryName("dates").start()
    for _ in range(60):
        if q.awaitTermination(1) or spark.table("dates").count() == 2:
            break
    q.stop()
    got = spark.table("dates").collect()
    assert {(r.source_id, r.external_id, str(r.posted_at)[:10]) for r in got} == {(1, "x", "2024-01-01"), (2, "y", "2023-01-01")}
