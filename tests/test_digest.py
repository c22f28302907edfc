"""A digest is the feed itself, search by search."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.bindings import AS_OF, bound
from jobloom.operators import account, feed
from jobloom.operators.feed import FeedFilter
from jobloom.plans.queries import live_feed, text_index

FILTERS = {
    1: FeedFilter(), 2: FeedFilter(countries=("N1", "N3"), modes=("remote", "hybrid"), field="all"), 3: FeedFilter(yoe=("0-2", "6-8"), comp_min=150000.0, vendors=("ashby", "workday")), 4: FeedFilter(disclosed_only=True, comp_min=200000.0, field="software"),
    5: FeedFilter(query='engineers -"work from home"', field="all"), 6: FeedFilter(skills=("hot plate",), field="all", include_dismissed=True), 7: FeedFilter(countries=("ZZ",), modes=("onsite",), field="all"), 8: FeedFilter(yoe=("nonsense",)),
}
VIEWER = 3


def test_equals_a_page_for_each_search(spark, sf_dir):
    rows, skills, index = live_feed(spark, sf_dir), bound(spark, sf_dir, "posting_skills"), text_index(spark, sf_dir)
    # Everything that is newest is dismissed, so that dismissals matter.
    dismissed = rows.where("status = 'live'").withColumn("at", feed.freshness()).orderBy(F.desc("at"), F.desc("id")).limit(5).select(F.lit(VIEWER).cast("long").alias("user_id"), F.col("id").alias("posting_id"))
    since = {i: "1995-01-01 00:00:00" if i % 2 else "2000-06-01 00:00:00" for i in FILTERS}
    candidates = spark.createDataFrame([(VIEWER, i, s) for i, s in since.items()], "user_id long, search_id long, s string").select("user_id", "search_id", F.col("s").cast("timestamp_ntz").alias("since"))
    got = account.digest(candidates, account.filters_frame(spark, FILTERS), rows, AS_OF, posting_skills=skills, dismissed=dismissed, index=index).collect()
    for i, f in FILTERS.items():
        want = feed.page(rows, FeedFilter(**{**f.__dict__, "posted_after": since[i], "limit": 8}), AS_OF, posting_skills=skills, dismissed=dismissed, viewer=VIEWER, index=index).collect()
        own = sorted((r for r in got if r.search_id == i), key=lambda r: r.place)
        assert [r.id for r in own] == [r.id for r in want[:8]], i
        assert all(r.more == (len(want) > 8) for r in own)


def test_floors_are_dollars(spark):
    """Five million rupees are not 150,000 dollars."""
    day = "CAST('2024-01-05' AS TIMESTAMP_NTZ)"
    rows = spark.sql(f"SELECT 1L AS id, 'live' AS status, {day} AS posted_at, {day} AS first_seen_at, CAST(NULL AS STRING) AS country, 'remote' AS mode, 5e6D AS comp_min, 'INR' AS comp_currency, CAST(NULL AS INT) AS yoe_min, 0.9D AS yoe_confidence, 'software' AS field, 'x' AS vendor, 't' AS title, 'd' AS description_text")
    rows = rows.unionByName(rows.withColumns({"id": F.lit(2).cast("long"), "comp_currency": F.lit("USD")}))
    candidates = spark.sql("SELECT 7L AS user_id, 1L AS search_id, CAST('2024-01-01' AS TIMESTAMP_NTZ) AS since")
    none = spark.createDataFrame([], "posting_id long, skill string"), spark.createDataFrame([], "user_id long, posting_id long")
    ask = lambda live: [(r.id, r.place, r.more) for r in account.digest(candidates, account.filters_frame(spark, {1: FeedFilter(comp_min=150000.0)}), live, AS_OF, posting_skills=none[0], dismissed=none[1]).collect()]
    assert ask(rows) == [(2, 1, False)] and ask(rows.where("id = 1")) == [] and ask(rows.where("false")) == []
    with pytest.raises(ValueError):
        account.filters_frame(spark, {1: FeedFilter(bands=("strong",))})


def test_postings_are_read_once(spark, sf_dir, monkeypatch):
    """However many stretches are walked, the joins below the feed and the shared tables are stored once, before the first."""
    names, written = [], account.store.written
    monkeypatch.setattr(account.store, "written", lambda df, name: (names.append(name), written(df, name))[1])
    candidates = spark.sql("SELECT 3L AS user_id, 7L AS search_id, CAST('1990-01-01' AS TIMESTAMP_NTZ) AS since")
    none = spark.createDataFrame([], "posting_id long, skill string"), spark.createDataFrame([], "user_id long, posting_id long")
    asked = account.filters_frame(spark, {7: FeedFilter(vendors=("nobody",), field="all")})
    assert account.digest(candidates, asked, live_feed(spark, sf_dir), AS_OF, posting_skills=none[0], dismissed=none[1]).count() == 0
    assert names[:5] == ["digest-searches", "digest-posts", "digest-hits", "digest-skills", "digest-dismissed"]
    assert len(names) > 6 and set(names[5:]) == {"digest"}


def test_searches_of_one_filter_share_its_list(spark, sf_dir, monkeypatch):
    """Filters meet postings, not searches; what a user dismissed, and a search's mark, cut their own parts of the list."""
    met = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda _: (met.add(1), True)[1], "boolean").asNondeterministic()
    conditions = account.conditions
    monkeypatch.setattr(account, "conditions", lambda: conditions() & counted("id"))
    rows = live_feed(spark, sf_dir).where("status = 'live'").withColumn("at", feed.freshness()).select("id", "at", "mode").orderBy(F.desc("at"), F.desc("id")).collect()
    filters, candidates, users = {}, [], range(1, 11)
    for i in range(400):
        user, remote, everything = i % 10 + 1, i % 3 == 0, i % 4 == 0
        filters[i] = FeedFilter(modes=("remote",) if remote else (), field="all", include_dismissed=everything)
        candidates.append((user, i, rows[(i * 7) % 300 + 3].at))
    hidden = {user: {r.id for r in rows[: 6 * user]} for user in users}
    dismissed = spark.createDataFrame([(user, i) for user in users for i in hidden[user]], "user_id long, posting_id long")
    skills = spark.createDataFrame([], "posting_id long, skill string")
    asked = spark.createDataFrame(candidates, "user_id long, search_id long, since timestamp_ntz")
    got = account.digest(asked, account.filters_frame(spark, filters), live_feed(spark, sf_dir), AS_OF, posting_skills=skills, dismissed=dismissed).collect()
    for user, i, since in candidates:
        f = filters[i]
        want = [r.id for r in rows if r.at > since and (not f.modes or r.mode == "remote") and (f.include_dismissed or r.id not in hidden[user])]
        own = sorted((r for r in got if r.search_id == i), key=lambda r: r.place)
        assert [(r.user_id, r.place, r.id, r.more) for r in own] == [(user, k + 1, x, len(want) > 8) for k, x in enumerate(want[:8])], i
    assert 0 < met.value < 20 * len(rows)


def test_texts_before_the_oldest_mark_are_not_read(spark, sf_dir):
    mark = F.lit("2001-01-01").cast("timestamp_ntz")
    poisoned = live_feed(spark, sf_dir).withColumn("description_text", F.when(feed.freshness() > mark, F.col("description_text")).otherwise(F.raise_error(F.lit("an old text was read"))))
    candidates = spark.sql("SELECT 3L AS user_id, 7L AS search_id, CAST('2001-01-01' AS TIMESTAMP_NTZ) AS since")
    none = spark.createDataFrame([], "posting_id long, skill string"), spark.createDataFrame([], "user_id long, posting_id long")
    f = FeedFilter(query="engineers -remote", field="all")
    got = account.digest(candidates, account.filters_frame(spark, {7: f}), poisoned, AS_OF, posting_skills=none[0], dismissed=none[1]).orderBy("place").collect()
    want = feed.page(live_feed(spark, sf_dir), FeedFilter(**{**f.__dict__, "posted_after": "2001-01-01 00:00:00", "limit": 8}), AS_OF).collect()
    assert got and [r.id for r in got] == [r.id for r in want[:8]]
