"""One query for each operator of the engine, over the bound tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import AS_OF, EVENTS_AS_OF, bound, raw
from ..functions import extract, resume, search, stemming, text
from ..functions.similarity import trigrams
from ..operators import account, backfills, feed, maintenance, rollups, scoring
from ..operators.backfills import Backfill
from ..operators.feed import FeedFilter
from ..operators.text_index import TextIndex
from ..sources import store, vendors
from . import polling
from .feeds import SOURCES

VIEWER = 3
FIRST_DAY, LAST_DAY = "2001-07-24", "2001-08-02"
PROFILE = scoring.Profile(skills=("hot plate", "small ring", "postgresql"), total_yoe=5.0, countries=("N1", "N2"), modes=("remote", "hybrid"), comp_min=150000.0, currency="USD", parse_confidence=0.8)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {**SOURCES, **polling.QUERIES}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.with_sources(*(bound(spark, sf_dir, t) for t in ("job_postings", "sources", "companies")))


_indexes: dict[tuple[str, str], TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of all postings' texts, built once in a session: the original keeps it as a stored column."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not _indexes[key].segments():
        _indexes[key] = TextIndex.build(bound(spark, sf_dir, "job_postings"), store.fresh_dir(spark, "text-index"))
    return _indexes[key]


def with_skills(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    lists = feed.skill_arrays(bound(spark, sf_dir, "posting_skills"))
    return rows.join(lists, rows["id"] == lists["posting_id"], "left").drop("posting_id")


def _filtered(f: FeedFilter) -> Query:
    return lambda spark, sf_dir: live_feed(spark, sf_dir).where(feed.predicate(f, AS_OF)).select("id", "company", "vendor", "title")


FILTERS: dict[str, FeedFilter] = {
    "feed_countries": FeedFilter(countries=("N1", "N3"), field="all"),
    "feed_modes": FeedFilter(modes=("remote", "hybrid")),
    "feed_yoe_bands": FeedFilter(yoe=("3-5", "9+"), field="all"),
    "feed_comp_floor": FeedFilter(comp_min=150000.0, field="all"),
    "feed_comp_floor_disclosed": FeedFilter(comp_min=150000.0, disclosed_only=True),
    "feed_disclosed": FeedFilter(disclosed_only=True, field="software"),
    "feed_field_default": FeedFilter(),
    "feed_posted_within": FeedFilter(posted_within_hours=336, field="all"),
    "feed_posted_after": FeedFilter(posted_after="2001-06-01 00:00:00", field="all"),
    "feed_vendor": FeedFilter(vendors=("ashby", "workday"), field="all"),
}
QUERIES.update({name: _filtered(f) for name, f in FILTERS.items()})


def _page(spark: SparkSession, sf_dir: str, f: FeedFilter) -> DataFrame:
    return feed.page(live_feed(spark, sf_dir), f, AS_OF, index=text_index(spark, sf_dir) if f.query else None)


@query
def feed_newest(spark, sf_dir):
    return _page(spark, sf_dir, FeedFilter(posted_within_hours=336)).select("id", "company", "vendor", "title", "sort_key")


@query
def feed_comp_usd(spark, sf_dir):
    return _page(spark, sf_dir, FeedFilter(sort="comp", field="all")).select("id", "comp_currency", F.round("sort_key", 2).alias("usd"))


@query
def feed_query(spark, sf_dir):
    return _page(spark, sf_dir, FeedFilter(query='backend or "data engineer" -hybrid', field="all", limit=50)).select("id", "title", "sort_key", F.round("rank", 6).alias("rank"))


@query
def feed_sort_relevance(spark, sf_dir):
    return _page(spark, sf_dir, FeedFilter(query="engineer remote", sort="relevance")).select("id", F.round("rank", 6).alias("rank"))


def _ranked_page(spark, sf_dir, f: FeedFilter) -> DataFrame:
    return feed.page(live_feed(spark, sf_dir), f, AS_OF, posting_skills=bound(spark, sf_dir, "posting_skills"), profile=PROFILE)


@query
def feed_sort_match(spark, sf_dir):
    return _ranked_page(spark, sf_dir, FeedFilter(sort="match", field="software", modes=("remote", "hybrid"))).select("id", "score", "band")


@query
def feed_bands(spark, sf_dir):
    return _ranked_page(spark, sf_dir, FeedFilter(bands=("plausible", "stretch"), field="all", limit=50)).select("id", "score", "band")


@query
def feed_rehydrated(spark, sf_dir):
    """A ranked page's ids and places, and the postings that are still live in its order."""
    best = _ranked_page(spark, sf_dir, FeedFilter(sort="match"))
    places = best.select("id", (F.row_number().over(Window.orderBy(F.desc("score"), F.desc_nulls_last("posted_at"), F.desc(feed.freshness()), F.desc("id"))) - 1).alias("place"))
    return feed.rehydrate(places, live_feed(spark, sf_dir).where("mode <> 'onsite'")).select("id", "place", "company", "title")


@query
def feed_items(spark, sf_dir):
    """Whole items of all live postings of the default field, with their companies' place texts."""
    places = bound(spark, sf_dir, "raw_places").select(F.col("id").alias("company_id"), "location_raw")
    rows = live_feed(spark, sf_dir).where(feed.predicate(FeedFilter(), AS_OF)).join(places, "company_id", "left").withColumn("sort_key", feed.freshness())
    lists = ("must_have", "nice_to_have", "must_canon", "nice_canon")
    return feed.items(rows, bound(spark, sf_dir, "posting_skills"), bound(spark, sf_dir, "applications"), VIEWER).select("*", *(F.array_join(c, ",").alias(f"{c}_") for c in lists)).drop(*lists)


@query
def value_lists(spark, sf_dir):
    """(kind, listed): the distinct values of the feed's closed vocabularies, joined in order."""
    postings, sources = bound(spark, sf_dir, "job_postings"), bound(spark, sf_dir, "sources")
    values = [postings.select(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("mode", "status", "field", "comp_currency")] + [sources.select(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("vendor", "tier")]
    return rollups.value_lists(reduce(DataFrame.unionByName, values))


@query
def feed_keyset_page2(spark, sf_dir):
    cursor = feed.encode_cursor({"k": "2001-07-01 00:00:00", "i": 1000})
    return _page(spark, sf_dir, FeedFilter(field="all", cursor=cursor)).select("id", "sort_key")


@query
def feed_not_dismissed(spark, sf_dir):
    rows = feed.without_dismissed(live_feed(spark, sf_dir), bound(spark, sf_dir, "dismissed_postings"), VIEWER)
    return rows.where(feed.predicate(FeedFilter(), AS_OF)).select("id")


@query
def feed_saved_flag(spark, sf_dir):
    return feed.with_saved(live_feed(spark, sf_dir).where("status = 'live'"), bound(spark, sf_dir, "applications"), VIEWER).select("id", "saved")


@query
def feed_skills_all(spark, sf_dir):
    # The two skills that most postings name.
    skills = bound(spark, sf_dir, "posting_skills")
    top = skills.groupBy("skill").count().orderBy(F.desc("count"), "skill").limit(2).select("skill")
    return feed.with_all_skills(live_feed(spark, sf_dir), skills, top).select("id")


@query
def posting_skill_arrays(spark, sf_dir):
    return feed.skill_arrays(bound(spark, sf_dir, "posting_skills")).select("posting_id", F.array_join("must", ",").alias("must"), F.array_join("nice", ",").alias("nice"))


@query
def feed_scored(spark, sf_dir):
    rows = with_skills(spark, sf_dir, live_feed(spark, sf_dir).where("status = 'live'"))
    parts = [F.round(f"{k}_score", 4).alias(f"{k}_score") for k in ("skills", "experience", "location", "compensation", "freshness")]
    return scoring.score(rows, PROFILE, AS_OF).select("id", *parts, "score", "band", F.round("confidence", 4).alias("confidence"), F.array_join("missing", ",").alias("missing"), "headline")


@query
def feed_ranked(spark, sf_dir):
    rows = with_skills(spark, sf_dir, live_feed(spark, sf_dir).where(feed.predicate(FeedFilter(), AS_OF)))
    return scoring.ranked(rows, PROFILE, AS_OF).select("id", "score", "band")


@query
def posting_detail(spark, sf_dir):
    rows = with_skills(spark, sf_dir, live_feed(spark, sf_dir).where("status = 'live'"))
    out = feed.with_saved(scoring.posting_detail(rows, PROFILE, AS_OF), bound(spark, sf_dir, "applications"), VIEWER)
    return out.select("id", "title", "company", "vendor", "country", *(F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("must", "nice")), "saved", "score", "band", "headline")


@query
def band_counts(spark, sf_dir):
    rows = with_skills(spark, sf_dir, live_feed(spark, sf_dir).where("status = 'live'"))
    return scoring.band_counts(scoring.score(rows, PROFILE, AS_OF))


@query
def facets(spark, sf_dir):
    return feed.facets(live_feed(spark, sf_dir))


@query
def market_summary(spark, sf_dir):
    return feed.market_summary(bound(spark, sf_dir, "job_postings"), AS_OF)


def _daily(spark, sf_dir):
    return rollups.source_daily(*(bound(spark, sf_dir, t) for t in ("job_postings", "sources", "posting_skills")), FIRST_DAY, LAST_DAY)


@query
def source_daily(spark, sf_dir):
    return _daily(spark, sf_dir)


@query
def coverage(spark, sf_dir):
    return rollups.coverage(_daily(spark, sf_dir))


@query
def ingest_series(spark, sf_dir):
    return rollups.series(_daily(spark, sf_dir), bound(spark, sf_dir, "sources"))


@query
def activity_weeks(spark, sf_dir):
    return rollups.activity(bound(spark, sf_dir, "application_events"), EVENTS_AS_OF, 3)


@query
def outages(spark, sf_dir):
    return rollups.outages(bound(spark, sf_dir, "job_postings"))


@query
def latency_pct(spark, sf_dir):
    return rollups.latency(bound(spark, sf_dir, "job_postings"), bound(spark, sf_dir, "sources"), spanning_outages=True)


@query
def latency_without_outages(spark, sf_dir):
    return rollups.latency(bound(spark, sf_dir, "job_postings"), bound(spark, sf_dir, "sources"))


@query
def pipeline_counts(spark, sf_dir):
    return account.pipeline(bound(spark, sf_dir, "applications"), VIEWER)


@query
def needs_reply(spark, sf_dir):
    return account.needs_reply(bound(spark, sf_dir, "applications"), EVENTS_AS_OF).select("id", "status", "next_action_at")


@query
def application_transitions(spark, sf_dir):
    return account.transitions(bound(spark, sf_dir, "application_events"))


@query
def application_replay(spark, sf_dir):
    return account.replay(bound(spark, sf_dir, "application_events"))


@query
def high_water(spark, sf_dir):
    return account.high_water(bound(spark, sf_dir, "job_postings"))


@query
def new_since(spark, sf_dir):
    return account.new_since(bound(spark, sf_dir, "saved_searches"), bound(spark, sf_dir, "job_postings"))


@query
def consent_latest(spark, sf_dir):
    return account.latest_consents(bound(spark, sf_dir, "user_consents")).select("id", "user_id", "purpose", "granted_at")


@query
def digest_candidates(spark, sf_dir):
    return account.digest_candidates(*(bound(spark, sf_dir, t) for t in ("saved_searches", "users", "user_consents")), "2024-01-20 00:00:00")


@query
def profile_map(spark, sf_dir):
    x = account.profile_skills(bound(spark, sf_dir, "user_skills"))
    years = F.array_join(F.transform(F.map_entries("years"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("int").cast("string"))), ",")
    return x.select("user_id", years.alias("years"), F.array_join("manual", ",").alias("manual"), F.array_join("resume", ",").alias("resume"))


@query
def application_save(spark, sf_dir):
    """Dismissed postings are saved by who dismissed them, and so are postings applied to."""
    applications = bound(spark, sf_dir, "applications")
    first = applications.groupBy("user_id", "posting_id").agg(F.min_by("status", "id").alias("status"), F.min("created_at").alias("created_at"), F.min("last_activity_at").alias("last_activity_at"))
    asked = bound(spark, sf_dir, "dismissed_postings").select("user_id", "posting_id").unionByName(first.where("status = 'applied'").select("user_id", "posting_id"))
    return account.save_application(first, asked, EVENTS_AS_OF)


@query
def application_unsave(spark, sf_dir):
    applications = bound(spark, sf_dir, "applications")
    return account.unsave_application(applications, applications.where("next_action_at IS NULL").select("user_id", "posting_id")).select("id", "user_id", "posting_id", "status")


def _patched(spark, sf_dir):
    none = lambda kind: F.lit(None).cast(kind)
    applications = bound(spark, sf_dir, "applications").withColumns({"channel": none("string"), "applied_at": none("timestamp_ntz")})
    status = F.when(F.col("status") == "saved", "applied").when(F.col("status") == "applied", "applied").otherwise(none("string"))
    patches = applications.where("next_action_at IS NOT NULL").select("id", status.alias("status"), F.when(F.col("status") == "screening", "referral").alias("channel"), none("date").alias("next_action_at"))
    return account.patch_applications(applications, patches, EVENTS_AS_OF)


@query
def application_patch(spark, sf_dir):
    return _patched(spark, sf_dir)[0].select("id", "status", "channel", "applied_at", "last_activity_at", "next_action_at")


@query
def application_patch_events(spark, sf_dir):
    return _patched(spark, sf_dir)[1]


def _digest_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Saved searches with marks, and filters that differ by user: countries, mode, pay in dollars, field, bands of years, vendor, query, skill."""
    saved = bound(spark, sf_dir, "saved_searches").where("last_seen_max_posted_at IS NOT NULL")
    some = lambda cond, *values: F.when(cond, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>"))
    by = lambda n, k=0: F.col("user_id") % n == k
    searches = saved.select(
        F.col("id").alias("search_id"), some(by(3), "N1", "N2").alias("countries"), some(by(4), "remote").alias("modes"), some(by(7), "3-5", "9+").alias("yoe"), F.when(by(5), 150000.0).alias("comp_min"), by(10).alias("disclosed_only"),
        F.when(by(2), "all").otherwise("").alias("field"), some(by(11), "ashby", "workable").alias("vendors"), some(by(13, 1), "hot plate").alias("skills"), F.when(by(6, 1), "engineers -remote").otherwise("").alias("query"), by(9).alias("include_dismissed"),
    )
    return saved.select("user_id", F.col("id").alias("search_id"), F.col("last_seen_max_posted_at").alias("since")), searches


@query
def digest_replay(spark, sf_dir):
    """Each saved search over the feed since its mark."""
    candidates, searches = _digest_inputs(spark, sf_dir)
    return account.digest(candidates, searches, live_feed(spark, sf_dir), AS_OF, posting_skills=bound(spark, sf_dir, "posting_skills"), dismissed=bound(spark, sf_dir, "dismissed_postings"))


def _searches(spark, sf_dir) -> DataFrame:
    """Saved searches as they are stored; a user's oldest is the default."""
    saved = bound(spark, sf_dir, "saved_searches")
    oldest = saved.groupBy("user_id").agg(F.min("id").alias("_oldest"))
    return saved.join(oldest, "user_id").select("id", "user_id", "name", F.lit("").alias("query"), (F.col("id") == F.col("_oldest")).alias("is_default"), "created_at", F.col("last_digest_at").alias("last_run_at"), "last_seen_max_posted_at")


def _saved(spark, sf_dir):
    """Every sign-up asks to save a search; a cap of 20 refuses some."""
    asked = raw(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("request_id"), F.concat(F.lit("new "), F.col("event_id").cast("string")).alias("name"), F.lit("q=go").alias("query"), (F.col("value") > 70).alias("make_default"))
    return account.create_searches(_searches(spark, sf_dir), asked, bound(spark, sf_dir, "job_postings"), EVENTS_AS_OF, cap=20)


@query
def saved_search_create(spark, sf_dir):
    return _saved(spark, sf_dir)[0]


@query
def saved_search_refused(spark, sf_dir):
    return _saved(spark, sf_dir)[1]


@query
def saved_search_run(spark, sf_dir):
    """Clicks run the user's oldest search; errors would delete searches of others, and delete nothing but their own."""
    searches = _searches(spark, sf_dir)
    clicks = raw(spark, sf_dir, "events").where("event_type = 'click' AND value > 60").select("user_id").distinct()
    runs = searches.where("is_default").join(clicks, "user_id", "left_semi").select("user_id", "id")
    gone = raw(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", (F.col("event_id") + F.floor("value").cast("long") % 9).alias("id"))
    return account.delete_searches(account.run_searches(searches, runs, bound(spark, sf_dir, "job_postings"), EVENTS_AS_OF), gone).select("id", "user_id", "last_run_at", "last_seen_max_posted_at")


@query
def visit_throttle(spark, sf_dir):
    """Every event is a request: one in six hours counts, and after a day it is another visit."""
    users = bound(spark, sf_dir, "users").select("id", F.when(F.col("deletion_requested_at").isNull(), F.col("created_at")).alias("last_active_at"), F.lit(None).cast("timestamp_ntz").alias("previous_visit_at"))
    return account.record_visits(users, raw(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at")), 86400, 21600)


@query
def session_prune(spark, sf_dir):
    sessions = raw(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 5, F.col("ts") + F.expr("INTERVAL '12' HOUR")).alias("expires_at"))
    return account.prune_sessions(sessions, "2024-02-15 00:00:00").select("event_id")


@query
def visit_sessions(spark, sf_dir):
    return account.visits(raw(spark, sf_dir, "events"), "6 hours")


@query
def merged_spans(spark, sf_dir):
    spans = bound(spark, sf_dir, "job_postings").select("company_id", F.to_date("first_seen_at").alias("a"), F.date_add(F.to_date("first_seen_at"), (F.col("id") % 200).cast("int")).alias("b"))
    return account.merge_spans(spans, "company_id", "a", "b")


@query
def dedupe_pairs(spark, sf_dir):
    return maintenance.duplicate_pairs(bound(spark, sf_dir, "job_postings"))


@query
def dedupe_after(spark, sf_dir):
    return maintenance.dedupe(bound(spark, sf_dir, "job_postings")).select("id", "status", "canonical_id")


def _polled(postings: DataFrame) -> DataFrame:
    """A poll: postings with a stated maximum again, those of software with a new body, all with other dates, and new ones beside the hybrid ones."""
    again = postings.where("comp_max IS NOT NULL")
    fresh = postings.where("mode = 'hybrid'").withColumn("id", F.lit(None).cast("long")).withColumn("external_id", F.concat(F.lit("n"), F.col("external_id")))
    rows = again.unionByName(fresh)
    body = F.when((F.col("field") == "software") & F.col("id").isNotNull(), "new body").otherwise("")
    markup = F.when(body != "", F.concat(F.lit("<p>"), body, F.lit("</p>"))).otherwise("")
    return rows.select("company_id", "source_id", "external_id", F.upper("title").alias("title"), body.alias("description_text"), markup.alias("description_html"), (F.col("posted_at") + F.expr("INTERVAL '1' DAY")).alias("posted_at"), F.lit(False).alias("posted_at_is_estimate"), (F.col("parse_confidence") / 2 + 0.3).alias("parse_confidence"))


@query
def upsert_after(spark, sf_dir):
    postings = bound(spark, sf_dir, "job_postings").withColumn("description_html", F.concat(F.lit("<p>"), "description_text", F.lit("</p>")))
    return maintenance.upsert_postings(postings, _polled(postings), AS_OF).select("id", "source_id", "external_id", "title", "description_text", "description_html", "posted_at", "posted_at_is_estimate", F.round("parse_confidence", 4).alias("parse_confidence"), "status", "closed_at", "missing_count")


@query
def reconcile_after(spark, sf_dir):
    postings = bound(spark, sf_dir, "job_postings")
    polled = bound(spark, sf_dir, "sources").where("vendor <> 'ashby'").select(F.col("id").alias("source_id"))
    seen = postings.where("comp_max IS NOT NULL").select("source_id", "external_id")
    return maintenance.reconcile_absent(postings, seen, polled, AS_OF).select("id", "status", "missing_count", "closed_at")


@query
def retier_after(spark, sf_dir):
    return maintenance.retier(bound(spark, sf_dir, "sources"), bound(spark, sf_dir, "watched_companies"), AS_OF).select("id", "tier")


@query
def poll_failed_after(spark, sf_dir):
    sources = bound(spark, sf_dir, "sources").withColumn("disabled_until", F.lit(None).cast("timestamp_ntz"))
    failed = sources.where("tier IN ('a', 'b')").select("id", F.when(F.col("vendor") == "ashby", 1).otherwise(0).alias("retry_hours"))
    return maintenance.poll_failed(sources, failed, AS_OF).select("id", "consecutive_errors", "disabled_until")


@query
def changed_boards(spark, sf_dir):
    pages = raw(spark, sf_dir, "pages")
    snapshots = pages.select(F.col("page_id").alias("source_id"), "html").withColumnRenamed("html", "body")
    last = pages.select(F.col("page_id").alias("source_id"), F.sha2(F.when(F.col("url").contains("7"), F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("content_hash"))
    return maintenance.changed_boards(snapshots, last).select("source_id", "content_hash")


def _boards(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Companies, sources and postings, and a list of boards: those of tiers a and b under capital names, those of companies of tier c with suppliers' slugs, and new ones of suppliers."""
    companies, sources = bound(spark, sf_dir, "companies").select("id", "slug", "name"), bound(spark, sf_dir, "sources")
    tokens = sources.join(companies.select(F.col("id").alias("company_id"), "slug", "name"), "company_id")
    token = F.concat(F.col("slug"), F.lit("-"), F.col("vendor"))
    stored = tokens.select("id", "vendor", token.alias("board_token"), "company_id", "tier")
    kept = tokens.where("tier IN ('a', 'b')").select("slug", F.upper("name").alias("name"), "vendor", token.alias("board_token"))
    supplier = raw(spark, sf_dir, "supplier").select(F.lower("s_name").alias("slug"), F.col("s_name").alias("name"))
    moved = tokens.where("tier = 'c' AND vendor = 'ashby'").select(F.lit("supplier#moved").alias("slug"), F.lit("Moved").alias("name"), "vendor", token.alias("board_token"))
    fresh = supplier.select("slug", "name", F.lit("keka").alias("vendor"), F.concat(F.lit("new-"), "slug").alias("board_token"))
    return companies, stored, bound(spark, sf_dir, "job_postings").select("id", "source_id"), kept.unionByName(moved).unionByName(fresh)


@query
def registry_after(spark, sf_dir):
    """Companies, sources and postings after the list became the registry, one table."""
    companies, sources, postings = maintenance.register_registry(*_boards(spark, sf_dir))
    null = F.lit(None).cast("string")
    rows = [companies.select(F.lit("company").alias("kind"), "id", F.col("slug").alias("a"), F.col("name").alias("b"), F.lit(None).cast("long").alias("of"))]
    rows.append(sources.select(F.lit("source").alias("kind"), "id", F.col("board_token").alias("a"), F.concat_ws("/", "vendor", "tier").alias("b"), F.col("company_id").alias("of")))
    rows.append(postings.select(F.lit("posting").alias("kind"), "id", null.alias("a"), null.alias("b"), F.col("source_id").alias("of")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def replayed_feed(spark, sf_dir):
    """Requests of all sources, lists and details, answered from pages kept as payloads; those of tier b name what they have."""
    sources, companies = bound(spark, sf_dir, "sources"), bound(spark, sf_dir, "companies").select(F.col("id").alias("company_id"), "slug")
    hosts = {"greenhouse": "'https://boards-api.greenhouse.io/v1/boards/'", "ashby": "'https://api.ashbyhq.com/posting-api/job-board/'", "workday": "concat('https://', replace(slug, '#', '-'), '.wd5.myworkdayjobs.com/wday/cxs/')", "personio": "concat('https://', replace(slug, '#', '-'), '.jobs.personio.de/xml?')", "workable": "'https://apply.workable.com/api/'"}
    url = "CASE vendor " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in hosts.items()) + " END"
    rest = "concat(replace(slug, '#', '-'), CASE WHEN tier = 'c' AND vendor = 'greenhouse' THEN concat('/jobs/', CAST(consecutive_errors AS STRING)) WHEN tier = 'a' OR vendor = 'greenhouse' THEN '/jobs' ELSE '/job/1' END)"
    pages = raw(spark, sf_dir, "pages").select("page_id", "html")
    names = spark.createDataFrame([(i, r[2], p) for i, (r, p) in enumerate((r, p) for r in vendors.ROUTES for p in (r[3], r[5]) if p)], "page_id long, vendor string, payload string")
    payloads = names.join(pages, "page_id").select("vendor", "payload", F.col("html").alias("body"))
    known = payloads.select(F.col("vendor").alias("_v"), F.sha2("body", 256).alias("_tag"), "payload").where("payload LIKE 'board%'")
    requests = sources.join(companies, "company_id").withColumn("url", F.concat(F.expr(url), F.expr(rest))).join(known, F.col("vendor") == F.col("_v")).select(F.col("id").alias("source_id"), "url", F.when(F.col("tier") == "b", F.col("_tag")).alias("etag"))
    return vendors.replayed(requests, payloads).select("source_id", "vendor", "payload", "status", F.md5("body").alias("body_md5"))


@query
def retention_after(spark, sf_dir):
    return maintenance.erase_users(bound(spark, sf_dir, "users"), "2024-02-10 00:00:00").select("id", "email", "deleted_at")


@query
def prune_after(spark, sf_dir):
    gone = bound(spark, sf_dir, "job_postings").where("status = 'closed' AND comp_max IS NULL").select("id")
    return maintenance.prune_postings(bound(spark, sf_dir, "applications"), gone).select("id", "posting_id")


@query
def backfill_yoe_confidence(spark, sf_dir):
    return maintenance.backfill_yoe_confidence(bound(spark, sf_dir, "job_postings")).select("id", "yoe_confidence")


def _backfilled(spark, sf_dir, table: DataFrame, rewrite) -> DataFrame:
    """A table stored, then rewritten in some four ranges."""
    stored = store.written(table, "backfill-input")
    run = Backfill(spark, store.fresh_dir(spark, "backfill"), batch_rows=max(1, stored.count() // 4))
    return run.run(stored, rewrite)


@query
def backfill_urls(spark, sf_dir):
    """101. Boards are companies; what personio posts stands for the vendor without links. Dear postings have one already."""
    postings = bound(spark, sf_dir, "job_postings", spread=True).withColumns({"apply_url": F.when(F.col("comp_min") > 300000, "https://a.example"), "posting_url": F.when(F.col("comp_max").isNull(), "").otherwise("https://b.example")})
    sources = bound(spark, sf_dir, "sources").join(bound(spark, sf_dir, "companies").select(F.col("id").alias("company_id"), "slug").hint("merge"), "company_id").select("id", F.when(F.col("vendor") == "personio", "smartrecruiters").otherwise(F.col("vendor")).alias("vendor"), F.col("slug").alias("board_token"))
    sources = store.written(sources, "backfill-sources")
    return _backfilled(spark, sf_dir, postings, lambda batch: backfills.posting_urls(batch, sources)).select("id", "apply_url", "posting_url")


@query
def backfill_close_absent(spark, sf_dir):
    """102, after a poll that showed none of the postings of unknown field."""
    postings = bound(spark, sf_dir, "job_postings", spread=True)
    postings = postings.withColumn("missing_count", F.when(F.col("field") == "unknown", F.col("missing_count") + 1).otherwise(F.col("missing_count")))
    return _backfilled(spark, sf_dir, postings, lambda batch: backfills.close_absent(batch, AS_OF)).select("id", "status", "closed_at")


@query
def backfill_fields(spark, sf_dir):
    """103."""
    postings = bound(spark, sf_dir, "job_postings", spread=True).withColumns({"field_confidence": F.lit(0.0), "field_because": F.lit("")})
    counts = store.written(backfills.skill_counts(bound(spark, sf_dir, "posting_skills", spread=True)), "backfill-skills")
    return _backfilled(spark, sf_dir, postings, lambda batch: backfills.classify_fields(batch, counts)).select("id", "field", "field_confidence", "field_because")


def _placed(spark, sf_dir) -> DataFrame:
    """Postings with the place text of their company."""
    places = bound(spark, sf_dir, "raw_places").select(F.col("id").alias("company_id"), "location_raw").hint("merge")
    return bound(spark, sf_dir, "job_postings", spread=True).join(places, "company_id", "left").withColumn("region", F.lit(None).cast("string"))


@query
def backfill_locations(spark, sf_dir):
    """104."""
    return _backfilled(spark, sf_dir, _placed(spark, sf_dir), backfills.reparse_locations).select("id", "country", "region", "city")


@query
def backfill_locations_again(spark, sf_dir):
    """106 over what 104 left: only rows that still have no country are read again, after their text lost its first word."""
    first = _backfilled(spark, sf_dir, _placed(spark, sf_dir), backfills.reparse_locations)
    return _backfilled(spark, sf_dir, first.withColumn("location_raw", F.regexp_replace("location_raw", "^Customer#0*", "Berlin, ")), backfills.reparse_locations).select("id", "country", "region", "city")


@query
def strip_html(spark, sf_dir):
    return raw(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("text_md5"))


@query
def yoe_extract(spark, sf_dir):
    x = text.years_of_experience(F.col("description_text"))
    return bound(spark, sf_dir, "job_postings").select("id", x.alias("x")).select("id", "x.min", "x.max", "x.confidence")


@query
def mode_classify(spark, sf_dir):
    mode: Column = text.work_mode(F.col("mode"), F.col("city"), F.col("description_text"))
    return bound(spark, sf_dir, "job_postings").select("id", mode.alias("work_mode"))


@query
def comp_parse(spark, sf_dir):
    return bound(spark, sf_dir, "job_postings").select("id", text.compensation(F.col("description_text")).alias("x")).select("id", "x.min", "x.max", "x.currency", "x.period")


@query
def field_classify(spark, sf_dir):
    n = bound(spark, sf_dir, "posting_skills").groupBy("posting_id").agg(F.count(F.lit(1)).alias("n_skills"))
    rows = bound(spark, sf_dir, "job_postings").join(n, F.col("id") == F.col("posting_id"), "left")
    return rows.select("id", text.classify_field(F.col("title"), F.col("n_skills")).alias("x")).select("id", F.col("x.field").alias("guess"), "x.confidence", "x.because")


@query
def parse_confidence(spark, sf_dir):
    n = bound(spark, sf_dir, "posting_skills").groupBy("posting_id").agg(F.count(F.lit(1)).alias("n_skills"))
    rows = bound(spark, sf_dir, "job_postings").join(n, F.col("id") == F.col("posting_id"), "left")
    return rows.select("id", text.parse_confidence(*map(F.col, ("title", "description_text", "country", "mode", "yoe_confidence", "n_skills"))).alias("parsed"))


@query
def vocab_fold(spark, sf_dir):
    return raw(spark, sf_dir, "part").select("p_partkey", text.employment(F.concat(F.lit("Full-"), F.lower("p_type"))).alias("employment"), text.pay_period(F.when(F.col("p_size") % 2 == 0, "per_year").otherwise("Hourly")).alias("period"))


@query
def title_similarity(spark, sf_dir):
    """Names that share a trigram, met by it; pairs without any have similarity 0 and are not listed."""
    names = raw(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("grams", trigrams(F.col("a")))
    posts = names.select("a", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    other = posts.select(F.col("a").alias("b"), F.col("n").alias("m"), "gram")
    shared = posts.join(other, "gram").where("a < b").groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("common"))
    return shared.select("a", "b", F.round(F.col("common") / (F.col("n") + F.col("m") - F.col("common")), 6).alias("sim"))


def _with_kind(spark, sf_dir, column: str, table: str) -> DataFrame:
    """(kind, id, column) of all postings and of a table that has harder cases."""
    postings = bound(spark, sf_dir, "job_postings").select(F.lit("posting").alias("kind"), "id", column)
    return postings.unionByName(bound(spark, sf_dir, table).select(F.lit("document").alias("kind"), "id", column))


@query
def title_normalise(spark, sf_dir):
    return extract.with_titles(_with_kind(spark, sf_dir, "title", "raw_titles")).select("kind", "id", "title_normalised", "seniority")


@query
def location_parse(spark, sf_dir):
    return extract.with_locations(bound(spark, sf_dir, "raw_places")).select("id", "country", "region", "city")


@query
def skill_sections(spark, sf_dir):
    rows = extract.with_skills(_with_kind(spark, sf_dir, "description_text", "raw_bodies"))
    return rows.select("kind", "id", F.explode("skills").alias("x")).select("kind", "id", "x.skill", "x.requirement", "x.confidence")


@query
def resume_parse(spark, sf_dir):
    x = resume.parse(bound(spark, sf_dir, "raw_resumes"), AS_OF)
    skill = F.transform("skills", lambda s: F.concat_ws(":", s["canonical"], s["evidence"], s["years"].cast("int").cast("string")))
    return x.select("id", "email", "phone", F.array_join("links", " ").alias("links"), F.array_join(skill, ",").alias("skills"), "years_of_experience", "confidence", F.array_join("diagnostics", ",").alias("diagnostics"), "n_lines")


SEARCH = 'engineers remotely -"years of experience" or backend'


@query
def search_relevance(spark, sf_dir):
    return search.search(bound(spark, sf_dir, "job_postings").where("status = 'live'").select("id"), SEARCH, index=text_index(spark, sf_dir)).select("id", F.round("rank", 6).alias("rank"))


NEAR = '"engineer (m/f/d)" working experienced'


@query
def search_nearness(spark, sf_dir):
    """A phrase and words asked for together: the rank is how near they stand."""
    index = text_index(spark, sf_dir)
    plan = search.parse(spark, NEAR)
    return search.find(index.hits(plan.terms), plan).select("id", F.round("rank", 6).alias("rank"))


EXCLUDING = "-engineer -hybrid"


@query
def search_after_changes(spark, sf_dir):
    """An index of the live postings, then of a poll that closes those of unknown field and gives those without pay another text."""
    postings = bound(spark, sf_dir, "job_postings").where("status = 'live'")
    index = TextIndex.build(postings, store.fresh_dir(spark, "text-index"), buckets=8)
    changed = postings.where("comp_min IS NULL AND field <> 'unknown'").select("id", "title", F.concat(F.lit("Hybrid work, no engineering. "), F.col("description_text")).alias("description_text"))
    index.apply(changed, removed=postings.where("field = 'unknown'").select("id"))
    out = None
    for asked in (EXCLUDING, SEARCH):
        plan = search.parse(spark, asked)
        found = search.find(index.hits(plan.terms), plan, index.ids()).select(F.lit(asked).alias("asked"), "id", F.round("rank", 6).alias("rank"))
        out = found if out is None else out.unionByName(found)
    return out


@query
def word_stems(spark, sf_dir):
    """Stems of every word of all postings and documents."""
    texts = bound(spark, sf_dir, "job_postings").select(F.concat_ws(" ", "title", "description_text").alias("x")).unionByName(raw(spark, sf_dir, "documents").select(F.col("text").alias("x")))
    words = texts.select(F.explode(stemming.split_words(F.col("x"))).alias("word")).distinct()
    return stemming.with_stems(words)


@query
def quality_precision(spark, sf_dir):
    docs = raw(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).alias("guess"))
    both = docs.join(raw(spark, sf_dir, "labels"), "doc_id")
    hit = F.count_if(F.col("guess") & (F.col("quality") == 1))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(hit / F.count_if(F.col("guess")), 6).alias("precision"), F.round(hit / F.count_if(F.col("quality") == 1), 6).alias("recall"))
