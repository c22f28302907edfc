"""A backfill that is stopped and goes on gives what one run gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.operators.backfills import Backfill, classify_fields, close_absent, posting_urls, reparse_locations, skill_counts
from jobloom.sources import store


def test_stopped_and_resumed(spark, tmp_path):
    table = store.written(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("id"), F.lit("live").alias("status"), (F.col("id") % 4).cast("int").alias("missing_count"), F.lit(None).cast("timestamp_ntz").alias("closed_at")), "backfill-test")
    rewrite = lambda batch: close_absent(batch, "2024-01-01 00:00:00")
    once = Backfill(spark, str(tmp_path / "once"), batch_rows=150).run(table, rewrite)
    seen = []

    def killed(k):
        seen.append(k)
        if len(seen) == 3:
            raise KeyboardInterrupt

    halves = Backfill(spark, str(tmp_path / "halves"), batch_rows=150)
    with pytest.raises(KeyboardInterrupt):
        halves.run(table, rewrite, killed)
    assert halves.done() == [0, 1]
    again = []
    got = Backfill(spark, str(tmp_path / "halves"), batch_rows=10).run(table, rewrite, again.append)
    assert again == list(range(2, 7))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, once.collect())) == sorted(map(tuple, rewrite(table).collect()))
    assert [r.changed > 0 for r in halves.progress().collect()] == [True] * 7 and halves.progress().agg(F.sum("rows"), F.sum("changed")).first()[:] == (1000, 500)


def test_urls_of_odd_rows(spark):
    postings = spark.createDataFrame([(1, 1, "x", None, ""), (2, 1, "y", "a", None), (3, 2, "z", None, None), (4, 3, "", None, None), (5, 4, "q", "", None), (6, None, "q", "", None)], "id long, source_id long, external_id string, apply_url string, posting_url string")
    sources = spark.createDataFrame([(1, "smartrecruiters", "b"), (2, "ashby", "b"), (3, "smartrecruiters", "b"), (4, "smartrecruiters", "")], "id long, vendor string, board_token string")
    got = {r.id: (r.apply_url, r.posting_url) for r in posting_urls(postings, sources, "u").collect()}
    assert got == {1: ("u/b/x", "u/b/x"), 2: ("a", "u/b/y"), 3: (None, None), 4: (None, None), 5: ("", None), 6: ("", None)}


def test_no_broadcast(spark, tmp_path):
    """Neither a rewrite nor the count of what it changed sends a side of a join through the driver, however small that looks."""
    postings = spark.createDataFrame([(1, 1, "x", "Backend Engineer", None, None, None, "Berlin, Germany"), (2, None, "y", "Cook", "N1", None, "City1", "Paris, France"), (3, 2, "z", "Cook", None, None, None, None)], "id long, source_id long, external_id string, title string, country string, region string, city string, location_raw string")
    postings = postings.withColumns({"apply_url": F.lit(""), "posting_url": F.lit(""), "field": F.lit(""), "field_confidence": F.lit(0.0), "field_because": F.lit("")})
    table = store.written(postings, "backfill-test")
    sources, skills = spark.createDataFrame([(1, "smartrecruiters", "b")], "id long, vendor string, board_token string"), spark.createDataFrame([(1, "go"), (1, "sql")], "posting_id long, skill string")
    counts = skill_counts(skills)
    for name, rewrite in {"urls": lambda b: posting_urls(b, sources), "fields": lambda b: classify_fields(b, counts), "places": reparse_locations}.items():
        assert "Broadcast" not in rewrite(table)._jdf.queryExecution().executedPlan().toString(), name
        run = Backfill(spark, str(tmp_path / name), batch_rows=2)
        assert sorted(map(tuple, run.run(table, rewrite).collect()), key=repr) == sorted(map(tuple, rewrite(table).collect()), key=repr)
        assert run.progress().agg(F.sum("rows"), F.sum("changed")).first()[:] == (3, {"urls": 1, "fields": 3, "places": 1}[name])


def test_an_empty_table(spark, tmp_path):
    table = store.written(spark.range(0).withColumns({"status": F.lit("live"), "missing_count": F.lit(2), "closed_at": F.lit(None).cast("timestamp_ntz")}), "backfill-test")
    run = Backfill(spark, str(tmp_path / "none"))
    assert run.run(table, lambda b: close_absent(b, "2024-01-01 00:00:00")).count() == 0 and [r[:] for r in run.progress().collect()] in ([], [(0, 0, 0)])
