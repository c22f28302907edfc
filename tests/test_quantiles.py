"""Exact quantiles, and requests that no kept payload answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.operators.quantiles import exact_quantiles
from jobloom.sources import vendors


def test_equal_to_the_built_in_percentile(spark):
    """One group with nine tenths of the rows, many ties, a null group, one row, and no value at all."""
    rows = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 100 == 0, None).when(F.col("id") == 10, "one").when(F.col("id") < 50, "none").otherwise("").alias("g"), ((F.col("id") * 7919) % 61).cast("double").alias("x"))
    rows = rows.withColumn("x", F.when(F.coalesce("g", F.lit("")) != "none", F.col("x")))
    ask = {"low": 0.0, "mid": 0.5, "p90": 0.9, "top": 1.0}
    got = exact_quantiles(rows, ["g"], "x", ask)
    want = rows.where("x IS NOT NULL").groupBy("g").agg(F.count("x").alias("n"), *(F.percentile("x", p).alias(q) for q, p in ask.items()))
    key = lambda r: (r.g is None, r.g or "")
    assert [(r.g, r.n, *(pytest.approx(r[q]) for q in ask)) for r in sorted(want.collect(), key=key)] == [(r.g, r.n, *(r[q] for q in ask)) for r in sorted(got.collect(), key=key)]
    plan = got._jdf.queryExecution().toString()
    assert "percentile" not in plan
    assert exact_quantiles(rows.limit(0), ["g"], "x", ask).count() == 0


def test_replay(spark):
    urls = ["https://boards-api.greenhouse.io/v1/boards/x/jobs", "https://boards-api.greenhouse.io/v1/boards/x/jobs/7", "https://boards-api.greenhouse.io/jobs/", "https://a.bamboohr.com/careers/1/detail", "https://a.bamboohr.com/careers/list", "https://t.wd5.myworkdayjobs.com/wday/cxs/t/s/jobs", "https://t.wd5.myworkdayjobs.com/wday/x"]
    rows = spark.createDataFrame([(u, None) for u in urls], "url string, etag string").select("url", vendors.routed(F.col("url")).alias("to")).collect()
    assert [r.to.payload for r in rows] == ["board-full.json", "detail-pay-ranges.json", "board-full.json", "detail-35.json", "board-full.json", "board-full.json", "detail.json"]
    kept = spark.createDataFrame([("ashby", "board-full.json", "b")], "vendor string, payload string, body string")
    tag = spark.range(1).select(F.sha2(F.lit("b"), 256)).first()[0]
    ask = lambda *rows: vendors.replayed(spark.createDataFrame(list(rows), "url string, etag string"), kept).select("status", "body").collect()
    board = "https://api.ashbyhq.com/x"
    assert [tuple(r) for r in ask((board, None), (board, tag), (board, "old"))] == [(200, "b"), (304, None), (200, "b")]
    for lost in ("https://example.org/", "https://a.keka.com/", None, "no address"):
        with pytest.raises(Exception, match="no kept payload answers"):
            ask((board, None), (lost, None))
