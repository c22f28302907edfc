"""Queries over polls: sliced boards, detail sweeps, fetch outcomes; their payloads and logs are derived from orders and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import raw
from ..sources import polls, store

#: Boards are regions; a posting is an order. Dear ones are listed under the next priority too, with another title.
DEAR = 400000
ORDERED = """SELECT n_regionkey AS source_id, o_orderkey AS k, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, o_orderstatus AS s, o_totalprice AS price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
_SHARE = 25


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("orders", "customer", "nation")
    return spark.sql(ORDERED.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}").replace("JOIN nation", "JOIN {nation}"), **{t: raw(spark, sf_dir, t) for t in names})


def _cap(spark: SparkSession, sf_dir: str) -> int:
    return raw(spark, sf_dir, "orders").count() // _SHARE


def _facet(name: str, values: list[tuple[str, str]]) -> str:
    """SQL for a facet of (value, count expression)."""
    listed = ", ',', ".join(f"""'{{"id":"{v}","count":', CAST({n} AS STRING), '}}'""" for v, n in values)
    return f"""concat('{{"facetParameter":"{name}","values":[', {listed}, ']}}')"""


def board_responses(spark: SparkSession, sf_dir: str, cap: int) -> DataFrame:
    """Answers to list requests: every slice by priority, and by status below it, shows its first ``cap`` postings by key, in pages of 20."""
    base = _ordered(spark, sf_dir)
    again = base.where(f"price > {DEAR} AND p < 5").withColumns({"p": F.col("p") + 1, "again": F.lit(True)})
    rows = base.withColumn("again", F.lit(False)).unionByName(again)
    title = F.concat(F.lit("Engineer "), F.col("k").cast("string"), F.when(F.col("again"), " again").otherwise(""))
    job = F.to_json(F.struct(title.alias("title"), F.concat(F.lit("/job/"), F.col("k").cast("string")).alias("externalPath")))
    by_priority, by_status = F.concat(F.lit("prio="), F.col("p").cast("string")), F.concat(F.lit("&state="), "s")
    whole = rows.where("NOT again").withColumn("path", F.lit(""))
    every = whole.unionByName(rows.withColumn("path", by_priority)).unionByName(rows.withColumn("path", F.concat(by_priority, by_status)))
    counts = every.groupBy("source_id", "path").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("p") == i).alias(f"p{i}") for i in range(1, 6)), *(F.count_if(F.col("s") == x).alias(f"s{x}") for x in "FOP"))
    states = _facet("state", [(x, f"s{x}") for x in "FOP"])
    facets = f"""concat('[{{"facetParameter":"place","values":[{{"id":"x"}},{{"id":"y"}},{{"id":"z"}},{{"id":"w"}},{{"id":"v"}},{{"id":"u"}}]}},', {states}, ',', {_facet("prio", [(str(i), f"p{i}") for i in range(1, 6)])}, ']')"""
    # Ranks within a slice, which a cap bounds: the smallest keys of a slice are chosen by a window limit.
    from pyspark.sql import Window

    ranked = every.withColumn("job", job).withColumn("r", F.row_number().over(Window.partitionBy("source_id", "path").orderBy("k", "again")) - 1).where(F.col("r") < cap)
    pages = ranked.groupBy("source_id", "path", F.floor(F.col("r") / polls.PAGE).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "job"))), lambda x: x["job"]), ",").alias("jobs"))
    body = F.concat(F.lit('{"total":'), F.least(F.col("n"), F.lit(cap)).cast("string"), F.lit(',"facets":'), F.expr(facets), F.lit(',"jobPostings":['), "jobs", F.lit("]}"))
    return pages.join(counts, ["source_id", "path"]).select("source_id", "path", "page", body.alias("body"))


def source_workday_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated boards become complete: by priority, and where that is still too much by status."""
    cap = _cap(spark, sf_dir)
    responses = store.written(board_responses(spark, sf_dir, cap), "responses")
    return polls.workday_board(responses, cap).select("source_id", "external_id", "title", "position")


_BOARD = f"""base AS ({ORDERED}),
listed AS (SELECT source_id, k, p, s, '' AS mark FROM base UNION ALL SELECT source_id, k, p + 1, s, ' again' FROM base WHERE price > {DEAR} AND p < 5),
lim AS (SELECT count(*) // {_SHARE} AS cap FROM orders),
big AS (SELECT source_id, count(*) AS whole FROM base GROUP BY source_id), mid AS (SELECT source_id, p, count(*) AS part FROM listed GROUP BY source_id, p),
sliced AS (SELECT l.*, CASE WHEN part >= cap THEN CASE s WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END ELSE -1 END AS sub, row_number() OVER (PARTITION BY l.source_id, l.p, CASE WHEN part >= cap THEN s END ORDER BY k, mark) AS r, cap
  FROM listed l JOIN mid USING (source_id, p) JOIN big USING (source_id) CROSS JOIN lim WHERE whole >= cap),
read AS (SELECT source_id, k, mark, p * 10 + sub AS slice, r FROM sliced WHERE r <= cap),
plain AS (SELECT source_id, k, '' AS mark, 0 AS slice, row_number() OVER (PARTITION BY source_id ORDER BY k) AS r FROM base JOIN big USING (source_id) CROSS JOIN lim WHERE whole < cap),
every AS (SELECT * FROM read UNION ALL SELECT * FROM plain)"""
_SLICED = f"""WITH {_BOARD}
SELECT source_id, concat('/job/', k::STRING) AS external_id, concat('Engineer ', k::STRING, arg_max(mark, slice * 10000000 + r)) AS title, (row_number() OVER (PARTITION BY source_id ORDER BY min(slice * 10000000 + r)))::INTEGER AS position FROM every GROUP BY source_id, k"""


def source_detail_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls with a budget of a third of the largest board: each detail is fetched once, a third poll from the end shows an unchanged board, and a changed one is swept again."""
    from pyspark.sql import Window

    listing = store.written(_ordered(spark, sf_dir).select("source_id", "k", (F.row_number().over(Window.partitionBy("source_id").orderBy("k")) - 1).alias("place")), "listing")
    boards = listing.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("total")).withColumn("content_hash", F.lit("a"))
    budget = -(-boards.agg(F.max("total")).first()[0] // 3)
    state = spark.createDataFrame([], "source_id bigint, detail_cursor int, content_hash string")
    out = None
    for poll in range(5):
        # In the last poll, Asia's board (the third region) is another one.
        seen = boards.withColumn("content_hash", F.when((F.col("source_id") == 2) & F.lit(poll == 4), "b").otherwise(F.col("content_hash")))
        plan = store.written(polls.sweep_plan(state, seen, budget), "sweep-plan")
        asked = polls.sweep_requests(plan, listing).select("source_id", "k", F.lit(poll).alias("poll"))
        filled = asked.groupBy("source_id").agg(F.count(F.lit(1)).alias("filled")).withColumn("cut_off", F.lit(False))
        state = store.written(polls.sweep_state(state, plan, filled), "sweep-state")
        out = asked if out is None else out.unionByName(asked)
    return out.join(state.select("source_id", "detail_cursor"), "source_id")


_SWEPT = f"""WITH base AS ({ORDERED}), placed AS (SELECT source_id, k, row_number() OVER (PARTITION BY source_id ORDER BY k) - 1 AS place, count(*) OVER (PARTITION BY source_id) AS total FROM base),
lim AS (SELECT ceil(max(total) / 3.0)::BIGINT AS budget FROM placed)
SELECT source_id, k, (place // budget)::INTEGER AS poll, CASE WHEN source_id = 2 AND total > budget THEN budget ELSE -1 END::INTEGER AS detail_cursor FROM placed, lim
UNION ALL SELECT source_id, k, 4, CASE WHEN total > budget THEN budget ELSE -1 END FROM placed, lim WHERE source_id = 2 AND place < budget"""

#: A log from events: a user is a source. Days give bodies, values give the time to wait.
FETCHES = """SELECT user_id AS source_id, ts AS fetched_at, event_id AS fetch_id,
  CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 304 WHEN 'purchase' THEN 429 WHEN 'error' THEN CASE WHEN value > 80 THEN 410 WHEN value > 20 THEN 500 END ELSE CASE WHEN value > 60 THEN 200 ELSE 503 END END AS status,
  CASE WHEN value > 50 THEN concat('e', CAST(CAST(floor(value) AS INT) AS STRING)) ELSE ' ' END AS etag, CASE WHEN value > 30 THEN concat('m', CAST(CAST(floor(value) AS INT) % 5 AS STRING)) END AS last_modified,
  CASE WHEN event_type IN ('view', 'signup') THEN concat('body of ', CAST(CAST(ts AS DATE) AS STRING)) END AS body"""
_WAIT = "CASE WHEN value < 25 THEN CAST(CAST(floor(value * 1000) AS BIGINT) AS STRING) WHEN value < 50 THEN {date} WHEN value < 60 THEN '-5' WHEN value < 70 THEN ' soon' END"


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.col("ts") + F.expr("INTERVAL '9' HOUR")
    date = F.when(F.col("value") < 40, F.date_format(later, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(F.col("ts") - F.expr("INTERVAL '9' HOUR"), "EEEE, dd-MMM-yy HH:mm:ss 'GMT'"))
    events = raw(spark, sf_dir, "events").withColumn("date", date)
    return spark.sql(f"{FETCHES}, {_WAIT.format(date='date')} AS retry_after FROM {{events}}", events=events)


def source_fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls.fetch_outcomes(fetch_log(spark, sf_dir))


_FOLDED = f"""WITH RECURSIVE log0 AS ({FETCHES}, CASE WHEN value < 25 THEN floor(value * 1000)::BIGINT * 1000000 WHEN value < 40 THEN epoch_us(date_trunc('second', ts + INTERVAL '9' HOUR)) - epoch_us(ts) ELSE 0 END AS retry, epoch_us(ts) AS us FROM events),
log AS (SELECT *, CASE WHEN body IS NOT NULL THEN sha256(body) END AS h, row_number() OVER (PARTITION BY source_id ORDER BY us, fetch_id) AS n FROM log0),
run AS (
  SELECT source_id, 0::BIGINT AS n, NULL::BIGINT AS us, NULL::BIGINT AS fetch_id, NULL::VARCHAR AS outcome, 0 AS errors, NULL::BIGINT AS until, NULL::VARCHAR AS etag, NULL::VARCHAR AS modified, NULL::VARCHAR AS hash FROM log WHERE n = 1
  UNION ALL
  SELECT source_id, n, us, fetch_id, what,
    CASE what WHEN 'paused' THEN errors WHEN 'unchanged' THEN 0 WHEN 'changed' THEN 0 ELSE errors + 1 END,
    CASE what WHEN 'paused' THEN until WHEN 'unchanged' THEN until WHEN 'changed' THEN NULL WHEN 'gone' THEN us + 86400000000 WHEN 'limited' THEN us + CASE WHEN retry > 0 THEN retry ELSE 900000000 END ELSE CASE WHEN errors + 1 >= 5 THEN us + 21600000000 ELSE until END END,
    CASE what WHEN 'changed' THEN nullif(new_etag, '') WHEN 'unchanged' THEN coalesce(nullif(trim(new_etag), ''), etag) ELSE etag END,
    CASE what WHEN 'changed' THEN nullif(new_modified, '') WHEN 'unchanged' THEN coalesce(nullif(trim(new_modified), ''), modified) ELSE modified END,
    CASE what WHEN 'changed' THEN h ELSE hash END
  FROM (SELECT l.source_id, l.n, l.us, l.fetch_id, l.retry, l.h, l.etag AS new_etag, l.last_modified AS new_modified, r.errors, r.until, r.etag, r.modified, r.hash,
    CASE WHEN r.until IS NOT NULL AND r.until >= l.us THEN 'paused' WHEN l.status = 304 OR (l.status < 400 AND l.h = r.hash) THEN 'unchanged' WHEN l.status < 400 THEN 'changed' WHEN l.status IN (404, 410) THEN 'gone' WHEN l.status = 429 THEN 'limited' ELSE 'failed' END AS what
    FROM run r JOIN log l ON l.source_id = r.source_id AND l.n = r.n + 1))
SELECT source_id, make_timestamp(us) AS fetched_at, fetch_id, outcome, errors AS consecutive_errors, make_timestamp(until) AS disabled_until, etag, modified AS last_modified, hash AS content_hash FROM run WHERE n > 0"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"source_workday_sliced": source_workday_sliced, "source_detail_sweep": source_detail_sweep, "source_fetch_outcomes": source_fetch_outcomes}
SQL = {"source_workday_sliced": _SLICED, "source_detail_sweep": _SWEPT, "source_fetch_outcomes": _FOLDED}
