"""What belongs to a user: applications, searches, digests, consents, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import find, hits_of, parse
from ..sources import store
from .feed import FeedFilter, as_of_column, conditions, freshness

# Stages in their order.
STAGES = ("saved", "applied", "screening", "interviewing", "offer", "rejected")


def pipeline(applications: DataFrame, viewer: int | None = None) -> DataFrame:
    """(stage, place, n): every stage in order, zero where there is none."""
    own = applications if viewer is None else applications.where(F.col("user_id") == viewer)
    counts = own.groupBy(F.col("status").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    stages = applications.sparkSession.createDataFrame([(s, i) for i, s in enumerate(STAGES)], "stage string, place int")
    return stages.join(counts, "stage", "left").fillna(0, ["n"])


def needs_reply(applications: DataFrame, as_of: str | Column, limit: int = 5) -> DataFrame:
    """Open applications by next action, those without one last."""
    quiet = as_of_column(as_of) - F.expr("INTERVAL '7' DAY")
    open_ = applications.where(F.col("status").isin("applied", "screening", "interviewing") & ((F.col("last_activity_at") < quiet) | F.col("next_action_at").isNotNull()))
    return open_.orderBy(F.asc_nulls_last("next_action_at"), "last_activity_at", "id").limit(limit)


def transitions(events: DataFrame) -> DataFrame:
    """(application_id, id, from_status, to_status): events that change the status."""
    w = Window.partitionBy("application_id").orderBy("occurred_at", "id")
    return events.withColumn("from_status", F.lag("to_status").over(w)).where(~F.col("from_status").eqNullSafe(F.col("to_status"))).select("application_id", "id", "from_status", "to_status")


def replay(events: DataFrame) -> DataFrame:
    """(application_id, status, n_events, last_activity_at): the state that the events lead to."""
    last = F.max(F.struct("occurred_at", "id", "to_status"))
    return events.groupBy("application_id").agg(last.alias("x"), F.count(F.lit(1)).alias("n_events")).select("application_id", F.col("x.to_status").alias("status"), "n_events", F.col("x.occurred_at").alias("last_activity_at"))


def high_water(postings: DataFrame) -> DataFrame:
    """The latest freshness of a live posting."""
    return postings.where(F.col("status") == "live").agg(F.max(freshness()).alias("high_water"))


def new_since(searches: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, new_since): live postings later than a search's mark, not filtered by the search; no mark counts nothing.

    Postings are counted by instant, marks are instants too: running sums over the instants of
    a day and over the days give what is behind each. No task gets more than a day's instants.
    """
    instants = postings.where(F.col("status") == "live").groupBy(freshness().alias("at")).agg(F.count(F.lit(1)).alias("n"))
    marks = searches.select(F.col("last_seen_max_posted_at").alias("at")).where(F.col("at").isNotNull()).distinct().withColumn("n", F.lit(0).cast("long"))
    every = instants.unionByName(marks).groupBy("at").agg(F.sum("n").alias("n")).withColumn("day", F.to_date("at"))
    behind = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    same_day = every.select("at", "day", behind(Window.partitionBy("day").orderBy(F.desc("at"))).alias("same_day"))
    # One row per day of the calendar.
    later = every.groupBy("day").agg(F.sum("n").alias("n")).select("day", behind(Window.orderBy(F.desc("day"))).alias("later"))
    counts = same_day.join(marks.select("at"), "at", "left_semi").join(later, "day").select("at", (F.col("same_day") + F.col("later")).alias("new_since"))
    return searches.join(counts, searches["last_seen_max_posted_at"] == counts["at"], "left").select("id", F.coalesce("new_since", F.lit(0)).cast("long").alias("new_since"))


def latest_consents(consents: DataFrame) -> DataFrame:
    """The latest open consent per user and purpose."""
    w = Window.partitionBy("user_id", "purpose").orderBy(F.desc("granted_at"), F.desc("id"))
    return consents.where(F.col("withdrawn_at").isNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def withdraw(consents: DataFrame, requests: DataFrame, as_of: str | Column) -> DataFrame:
    """Consents after the latest open one of each requested (user_id, purpose) is withdrawn."""
    hit = latest_consents(consents).join(requests.select("user_id", "purpose").distinct(), ["user_id", "purpose"], "left_semi").select(F.col("id").alias("_hit"))
    joined = consents.join(hit, consents["id"] == hit["_hit"], "left")
    return joined.withColumn("withdrawn_at", F.when(F.col("_hit").isNotNull(), as_of_column(as_of)).otherwise(F.col("withdrawn_at"))).drop("_hit")


def digest_candidates(searches: DataFrame, users: DataFrame, consents: DataFrame, not_before: str | Column, limit: int = 500) -> DataFrame:
    """Searches to send: their user is there and agrees to mail, and the last digest is old enough."""
    agreed = consents.where((F.col("purpose") == "digest_email") & F.col("withdrawn_at").isNull()).select("user_id")
    people = users.where(F.col("deleted_at").isNull()).select(F.col("id").alias("user_id"), "email").join(agreed, "user_id", "left_semi")
    due = searches.where(F.col("last_digest_at").isNull() | (F.col("last_digest_at") < as_of_column(not_before)))
    since = F.greatest(F.coalesce("last_seen_max_posted_at", "created_at"), "last_digest_at")
    return due.join(people, "user_id").select("user_id", "email", F.col("id").alias("search_id"), "name", since.alias("since")).orderBy("user_id", "search_id").limit(limit)


def visits(events: DataFrame, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """(user_id, started, ended, n): visits that end after a gap."""
    window = F.session_window(F.col(time).cast("timestamp"), gap)
    return events.groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


def dismiss(dismissed: DataFrame, new: DataFrame) -> DataFrame:
    """Dismissals after an upsert by (user_id, posting_id); a missing new reason keeps the old one."""
    from .maintenance import merge_frames

    return merge_frames(dismissed, new, ["user_id", "posting_id"], {"reason": lambda o, n: F.coalesce(n, o)} if "reason" in dismissed.columns else {})


def merge_spans(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): overlapping or touching intervals joined."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    islands = spans.withColumn("_new", opened).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def profile_strength(users: DataFrame) -> DataFrame:
    """(id, strength): percent of six checks on n_skills, total_yoe, current_title, countries, modes and comp_min."""
    checks = [F.coalesce("n_skills", F.lit(0)) >= 5, F.col("total_yoe").isNotNull(), F.coalesce("current_title", F.lit("")) != "", F.size("countries") > 0, F.size("modes") > 0, F.col("comp_min").isNotNull()]
    return users.select("id", F.round(sum(c.cast("int") for c in checks) / 6 * 100).cast("int").alias("strength"))


def export(tables: dict[str, DataFrame], viewer: int) -> DataFrame:
    """(kind, row): all of a user's rows as JSON, one per line."""
    out = None
    for kind, df in tables.items():
        own = df.where(F.col("id" if kind == "users" else "user_id") == viewer).select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("row"))
        out = own if out is None else out.unionByName(own)
    return out


def profile_skills(user_skills: DataFrame) -> DataFrame:
    """(user_id, years, own, read): a map from skill to years (0 if not stated), and the ordered lists by origin.

    ``user_skills`` has (user_id, skill, years, origin); of a repeated skill the most years count.
    """
    once = user_skills.groupBy("user_id", "skill").agg(F.max(F.coalesce("years", F.lit(0.0))).alias("years"), F.min("origin").alias("origin"))
    pairs = F.array_sort(F.collect_list(F.struct("skill", "years")))
    of = lambda origin: F.array_sort(F.collect_list(F.when(F.col("origin") == origin, F.col("skill")))).alias(origin)
    return once.groupBy("user_id").agg(F.map_from_entries(pairs).alias("years"), of("manual"), of("resume"))


def ordered_distinct(items: Column) -> Column:
    """A list without blanks and repeats, compared without case and outer blanks; the first spelling stays, in its place."""
    clean = F.filter(F.transform(items, lambda x: F.btrim(x)), lambda x: x != "")
    first = F.transform(clean, lambda x, i: F.when(F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1, x))
    return F.array_compact(first)


def save_application(applications: DataFrame, requests: DataFrame, as_of: str | Column) -> DataFrame:
    """Applications after saves (user_id, posting_id): a new one is saved now, an old one is touched and keeps its state."""
    now = as_of_column(as_of)
    new = requests.select("user_id", "posting_id").distinct().withColumn("_asked", F.lit(True))
    keys = [applications[k] == new[k] for k in ("user_id", "posting_id")]
    both = applications.withColumn("_there", F.lit(True)).join(new, keys, "full_outer")
    old, asked = F.col("_there").isNotNull(), F.col("_asked").isNotNull()
    values = {
        "user_id": F.coalesce(applications["user_id"], new["user_id"]), "posting_id": F.coalesce(applications["posting_id"], new["posting_id"]), "status": F.when(old, applications["status"]).otherwise("saved"),
        "created_at": F.when(old, applications["created_at"]).otherwise(now), "last_activity_at": F.when(asked, now).otherwise(applications["last_activity_at"]),
    }
    return both.select(*((values[c].alias(c) if c in values else applications[c]) for c in applications.columns))


def unsave_application(applications: DataFrame, requests: DataFrame) -> DataFrame:
    """Applications without those of the requests (user_id, posting_id) that are no more than saved."""
    gone = requests.select("user_id", "posting_id").distinct().withColumn("_gone", F.lit(True))
    joined = applications.join(gone, ["user_id", "posting_id"], "left").where(F.col("_gone").isNull() | (F.col("status") != "saved"))
    return joined.select(*applications.columns)


def patch_applications(applications: DataFrame, patches: DataFrame, as_of: str | Column) -> tuple[DataFrame, DataFrame]:
    """(applications, events) after patches (id, status, channel, next_action_at); a null leaves a value as it is.

    A status past saved and withdrawn needs an instant and a channel: now and "other" where there
    is none. An event is made only where the status really changes. One patch for each id.
    """
    now = as_of_column(as_of)
    side = patches.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("status", "channel", "next_action_at")))
    joined = applications.join(side, applications["id"] == side["_id"], "left")
    hit, status = F.col("_id").isNotNull(), F.coalesce("_status", "status")
    past = hit & ~status.isin("saved", "withdrawn")
    values = {
        "status": status, "channel": F.coalesce("_channel", "channel", F.when(past, "other")), "next_action_at": F.coalesce("_next_action_at", "next_action_at"),
        "applied_at": F.coalesce("applied_at", F.when(past, now)), "last_activity_at": F.when(hit, now).otherwise(F.col("last_activity_at")),
    }
    changed = joined.where(hit & ~status.eqNullSafe(F.col("status")))
    events = changed.select(F.col("id").alias("application_id"), F.col("status").alias("from_status"), status.alias("to_status"), now.alias("occurred_at"))
    return joined.select(*((values[c].alias(c) if c in values else F.col(c)) for c in applications.columns)), events


SEARCHES, SESSION_DAYS, THROTTLE_SECONDS = 50, 30, 60


def create_searches(searches: DataFrame, requests: DataFrame, postings: DataFrame, as_of: str | Column, cap: int = SEARCHES) -> tuple[DataFrame, DataFrame]:
    """(searches, refused) after requests (user_id, request_id, name, query, make_default) to save one, in the order of their ids.

    A user has at most ``cap`` searches; what comes later is refused. A new search has its mark at the latest live
    posting, so it begins with nothing new. Its id is the request's. The last accepted request for a default takes it from the others.
    ``searches`` has is_default beside id, user_id, name, query, created_at, last_run_at and last_seen_max_posted_at.
    """
    now = as_of_column(as_of)
    held = searches.groupBy("user_id").agg(F.count(F.lit(1)).alias("_held"))
    # Of any user only the first ``cap`` requests can fit.
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("request_id"))
    first = requests.withColumn("_place", place).where(F.col("_place") <= cap)
    taken = first.join(held, "user_id", "left").where(F.col("_place") + F.coalesce("_held", F.lit(0)) <= cap)
    refused = requests.select("user_id", "request_id").join(taken.select("user_id", "request_id"), ["user_id", "request_id"], "left_anti")
    chosen = taken.groupBy("user_id").agg(F.max(F.when(F.col("make_default"), F.col("request_id"))).alias("_default"))
    mark = high_water(postings).withColumnRenamed("high_water", "_mark")
    # One row, joined by a constant key.
    new = taken.join(chosen, "user_id").withColumn("_one", F.lit(1)).join(F.broadcast(mark.withColumn("_one", F.lit(1))), "_one")
    kinds = dict(searches.dtypes)
    values = {"id": F.col("request_id"), "is_default": F.coalesce(F.col("request_id") == F.col("_default"), F.lit(False)), "created_at": now, "last_run_at": now, "last_seen_max_posted_at": F.col("_mark")}
    fresh = new.select(*((values[c] if c in values else F.col(c) if c in requests.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in searches.columns))
    lost = searches.join(chosen.where(F.col("_default").isNotNull()), "user_id", "left")
    old = lost.select(*(F.when(F.col("_default").isNotNull(), F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_default" else F.col(c) for c in searches.columns))
    return old.unionByName(fresh), refused


def run_searches(searches: DataFrame, runs: DataFrame, postings: DataFrame, as_of: str | Column) -> DataFrame:
    """Searches after runs (user_id, id): their mark moves to the latest live posting. Only a user's own searches run."""
    hit = runs.select("user_id", "id").distinct().withColumn("_run", F.lit(1)).join(F.broadcast(high_water(postings).withColumn("_run", F.lit(1))), "_run")
    joined = searches.join(hit, ["user_id", "id"], "left")
    ran = F.col("_run").isNotNull()
    values = {"last_run_at": F.when(ran, as_of_column(as_of)).otherwise(F.col("last_run_at")), "last_seen_max_posted_at": F.when(ran, F.col("high_water")).otherwise(F.col("last_seen_max_posted_at"))}
    return joined.select(*(values[c].alias(c) if c in values else F.col(c) for c in searches.columns))


def delete_searches(searches: DataFrame, requests: DataFrame) -> DataFrame:
    """Searches without those of the requests (user_id, id)."""
    return searches.join(requests.select("user_id", "id").distinct(), ["user_id", "id"], "left_anti").select(*searches.columns)


def prune_sessions(sessions: DataFrame, as_of: str | Column, days: int = SESSION_DAYS) -> DataFrame:
    """Sessions that have not been over for ``days`` days; those without an end stay."""
    return sessions.where(F.coalesce(F.col("expires_at") >= as_of_column(as_of) - F.make_dt_interval(days=F.lit(days)), F.lit(True)))


def record_visits(users: DataFrame, requests: DataFrame, gap_seconds: int, throttle_seconds: int = THROTTLE_SECONDS) -> DataFrame:
    """Users (id, last_active_at, previous_visit_at, ...) after requests (user_id, at), taken in their order.

    A request within ``throttle_seconds`` of the last one that counted does not count. One that counts after more than
    ``gap_seconds`` moves previous_visit_at to the last activity before it. What counts depends on what counted
    before: a user's requests stream, sorted, through one fold with three values of state.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    start = users.select(F.col("id").alias("user_id"), micros("last_active_at").alias("active"), micros("previous_visit_at").alias("previous"), F.lit(None).cast("long").alias("at"))
    asked = requests.select("user_id", F.lit(None).cast("long").alias("active"), F.lit(None).cast("long").alias("previous"), micros("at").alias("at"))
    rows = start.unionByName(asked.where("at IS NOT NULL AND user_id IS NOT NULL"))
    gap, throttle = gap_seconds * 1_000_000, throttle_seconds * 1_000_000

    def fold(batches):
        user, known, active, previous = None, False, None, None
        out: list = []
        for batch in batches:
            for u, a, p, at in batch.itertuples(index=False):
                if u != user:
                    if known:
                        out.append((user, active, previous))
                    user, known, active, previous = u, False, None, None
                if at != at or at is None:  # the user's own row comes first
                    known, active, previous = True, None if a != a else int(a), None if p != p else int(p)
                elif known and (active is None or active < at - throttle):
                    if active is None or active < at - gap:
                        previous = int(at) if active is None else active
                    active = int(at)
            yield _visits(out)
            out = []
        if known:
            yield _visits([(user, active, previous)])

    moved = rows.repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_first("at")).mapInPandas(fold, "_id long, _active long, _previous long")
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    joined = users.join(moved, users["id"] == moved["_id"])
    values = {"last_active_at": stamp("_active"), "previous_visit_at": stamp("_previous")}
    return joined.select(*(values[c].alias(c) if c in values else users[c] for c in users.columns))


def _visits(rows: list):
    import pandas as pd

    return pd.DataFrame(rows, columns=["_id", "_active", "_previous"]).astype({"_active": "Int64", "_previous": "Int64"})


#: Filters, or rows of their lists, that one broadcast may hold, well under 100 MB; more are shuffled.
BROADCAST_FILTERS = 100_000
#: Ids of postings that one broadcast may hold.
BROADCAST_IDS = 1_000_000
#: Postings of a digest's first stretch, about; each later one ends at this many times as many.
FIRST_STRETCH, STRETCH_GROWTH = 256, 8
#: What the conditions of a digest's searches read of a posting.
DIGEST_COLUMNS = ("id", "status", "country", "mode", "yoe_min", "yoe_confidence", "comp_min", "comp_currency", "field", "vendor")
#: What makes a filter, apart from the user's dismissals.
FILTER_COLUMNS = ("countries", "modes", "yoe", "comp_min", "disclosed_only", "field", "vendors", "skills", "query")


def filters_frame(spark, filters: dict[int, FeedFilter]) -> DataFrame:
    """The columns of ``digest`` from parsed searches by id. Bands need a profile and cannot be asked for in a digest."""
    if any(f.bands for f in filters.values()):
        raise ValueError("bands need the viewer's profile")
    kind = "search_id long, countries array<string>, modes array<string>, yoe array<string>, comp_min double, disclosed_only boolean, field string, vendors array<string>, skills array<string>, query string, include_dismissed boolean"
    rows = [(i, list(f.countries), list(f.modes), list(f.yoe), f.comp_min, f.disclosed_only, f.field, list(f.vendors), list(f.skills), f.query, f.include_dismissed) for i, f in filters.items()]
    return spark.createDataFrame(rows, kind)


def digest(candidates: DataFrame, searches: DataFrame, live: DataFrame, as_of: str | Column, *, posting_skills: DataFrame, dismissed: DataFrame, index=None, shown: int = 8) -> DataFrame:
    """(user_id, search_id, place, id, more): for each candidate (user_id, search_id, since) its newest postings later than ``since``, at most ``shown``, and whether there are more.

    ``searches`` has a search's filter as columns, see ``filters_frame``; the feed's own conditions hold
    (``feed.conditions``), with the text query through ``index`` or the texts themselves, skills and the user's dismissals.
    ``live`` are the feed's rows, with vendor; those before the oldest mark can be in no digest and are left out.

    Searches with one filter have one list of postings, of which a user sees all but the dismissed: what a search gets
    is the part of its user's list (its asker's) that is later than its mark. So filters meet postings, by country and mode, and searches only
    meet the ends of lists. Postings are walked backwards in stretches of growing numbers; an asker that
    has ``shown`` + 1 rows, or whose oldest mark lies behind, drops out, and so does a filter without askers.
    """
    spark = live.sparkSession
    named = lambda *cols: F.sha2(F.to_json(F.struct(*cols)), 256)
    asked = candidates.select("user_id", "search_id", "since").join(searches, "search_id").withColumn("include_dismissed", F.coalesce("include_dismissed", F.lit(False)))
    asked = store.written(asked.withColumns({"filter": named(*FILTER_COLUMNS), "asker": named("user_id", "include_dismissed", *FILTER_COLUMNS)}), "digest-searches")
    oldest = asked.agg(F.min("since")).first()[0]
    filters = asked.select("filter", *FILTER_COLUMNS).distinct()
    queries = [r["query"] for r in filters.where(F.coalesce("query", F.lit("")) != "").select("query").distinct().toLocalIterator()]
    # What every stretch reads is made once: the columns that the conditions need, the skills that are asked for, the dismissals of those who ask.
    texts = ("title", "description_text") if queries and index is None else ()
    recent = live.where((F.col("status") == "live") & (freshness() > as_of_column(oldest and str(oldest))))
    posts = store.written(recent.select(*DIGEST_COLUMNS, *texts, freshness().alias("at")), "digest-posts")
    kept = spark.createDataFrame([], "asker string, id long, at timestamp_ntz")
    if stretches := _stretches(posts):
        # Broadcast semi-joins reach below what ``posting_skills`` and ``dismissed`` join and group; others meet its rows.
        small = lambda df, most: F.broadcast(df) if df.count() <= most else df
        ids = small(posts.select("id"), BROADCAST_IDS)
        hits = store.written(_query_hits(queries, posts, index), "digest-hits")
        wanted = small(filters.select(F.explode("skills").alias("skill")).distinct(), BROADCAST_FILTERS)
        skill_sets = posting_skills.select(F.col("posting_id").alias("id"), "skill").join(wanted, "skill", "left_semi").join(ids, "id", "left_semi")
        skill_sets = store.written(skill_sets.groupBy("id").agg(F.collect_set("skill").alias("_skills")), "digest-skills")
        hidden = dismissed.select("user_id", F.col("posting_id").alias("id")).join(asked.select("user_id").distinct(), "user_id", "left_semi").join(ids, "id", "left_semi")
        hidden = store.written(hidden.distinct(), "digest-dismissed")
        hides = hidden.groupBy("user_id").agg(F.count(F.lit(1)).alias("_hides"))
        most, n = hides.agg(F.coalesce(F.max("_hides"), F.lit(0))).first()[0], filters.count()
        askers = asked.groupBy("asker", "user_id", "filter", "include_dismissed", *FILTER_COLUMNS).agg(F.min("since").alias("since")).join(hides, "user_id", "left")
        askers = store.written(askers.withColumn("_deep", F.when(F.col("include_dismissed"), 0).otherwise(F.coalesce("_hides", F.lit(0))) + shown + 1).drop("_hides"), "digest")
        for high, low in stretches:
            open_ = askers.where(F.col("since") < as_of_column(str(high))).join(kept.groupBy("asker").count().where(F.col("count") > shown), "asker", "left_anti")
            if open_.isEmpty():
                break
            part = posts.where(F.col("at") <= as_of_column(str(high)))
            part = part if low is None else part.where(F.col("at") > as_of_column(str(low)))
            part = part.join(hits, "id", "left").join(skill_sets, "id", "left")
            met = _matched(part, open_.groupBy("filter", *FILTER_COLUMNS).agg(F.min("since").alias("since")), n <= BROADCAST_FILTERS)
            # Of a list's first rows a user has dismissed no more than of all.
            lists = met.withColumn("_n", F.row_number().over(Window.partitionBy("filter").orderBy(F.desc("at"), F.desc("id")))).where(F.col("_n") <= shown + 1 + most)
            lists = F.broadcast(lists) if n * (shown + 1 + most) <= BROADCAST_FILTERS else lists
            seen = open_.drop(*FILTER_COLUMNS).join(lists, "filter").where((F.col("at") > F.col("since")) & (F.col("_n") <= F.col("_deep")))
            seen = seen.join(hidden.withColumn("_hidden", F.lit(True)), ["user_id", "id"], "left").where(F.col("_hidden").isNull() | F.col("include_dismissed")).select("asker", "id", "at")
            best = seen.withColumn("_n", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("at"), F.desc("id")))).where(F.col("_n") <= shown + 1).drop("_n")
            kept = store.written(kept.unionByName(best), "digest")
    w = Window.partitionBy("asker")
    places = kept.withColumn("place", F.row_number().over(w.orderBy(F.desc("at"), F.desc("id"))))
    places = places.withColumn("_next", F.max(F.when(F.col("place") == shown + 1, F.col("at"))).over(w)).where(F.col("place") <= shown)
    own = asked.select("asker", "user_id", "search_id", "since").join(places, "asker").where(F.col("at") > F.col("since"))
    return own.select("user_id", "search_id", "place", "id", F.coalesce(F.col("_next") > F.col("since"), F.lit(False)).alias("more"))


def _stretches(posts: DataFrame) -> list[tuple]:
    """(latest instant, instant before the earliest) of each stretch, newest first; the last one has no end. Edges come from approximate ranks, as only the work depends on them."""
    n, newest = posts.agg(F.count(F.lit(1)), F.max("at")).first()
    if newest is None:
        return []
    sizes = []
    while (size := FIRST_STRETCH * STRETCH_GROWTH ** len(sizes)) < n:
        sizes.append(size)
    edges = [newest]
    for edge in posts.agg(F.percentile_approx("at", F.array(*(F.lit(1 - size / n) for size in sizes)))).first()[0] if sizes else []:
        if edge < edges[-1]:
            edges.append(edge)
    return list(zip(edges, [*edges[1:], None], strict=True))


def _query_hits(queries: list[str], posts: DataFrame, index) -> DataFrame:
    """(id, _queries): the text queries of the searches that find a posting. A driver's loop over distinct queries; without an index the texts are cut once, for the terms of all."""
    spark = posts.sparkSession
    out, plans = spark.createDataFrame([], "q_query string, id long"), {q: parse(spark, q) for q in queries}
    ids, words = posts.select("id"), None
    if plans and index is None:
        words = store.written(hits_of(posts, "id", "title", "description_text", sorted({t for plan in plans.values() for t in plan.terms})), "digest-words")
    for query, plan in plans.items():
        found = find(words, plan, ids) if index is None else find(index.hits(plan.terms), plan, index.ids())
        out = out.unionByName(ids.join(found, "id").select(F.lit(query).alias("q_query"), "id"))
    return out.groupBy("id").agg(F.collect_set("q_query").alias("_queries"))


def _matched(part: DataFrame, filters: DataFrame, small: bool) -> DataFrame:
    """(filter, id, at): postings later than a filter's ``since`` that meet its conditions, with its query and all of its skills. A posting meets only filters that ask for its own country and mode, or for any."""
    keyed = lambda col: F.when(F.size(col) > 0, col).otherwise(F.array(F.lit("*")))
    with_null = F.when(F.size("countries") > 0, F.array_append("countries", F.lit("?"))).otherwise(F.array(F.lit("*")))
    side = filters.withColumn("_country", F.explode(F.array_distinct(with_null))).withColumn("_mode", F.explode(F.array_distinct(keyed(F.col("modes")))))
    side = side.select("filter", "since", "_country", "_mode", *(F.col(c).alias(f"q_{c}") for c in FILTER_COLUMNS))
    part = part.withColumn("_country", F.explode(F.array(F.coalesce("country", F.lit("?")), F.lit("*")))).withColumn("_mode", F.explode(F.array("mode", F.lit("*"))))
    query, skills = F.coalesce("q_query", F.lit("")), F.coalesce("q_skills", F.array().cast("array<string>"))
    # A skill that is asked for twice is there once at most, so it matches nothing.
    there = F.coalesce((query == "") | F.array_contains("_queries", query), F.lit(False))
    there &= F.coalesce((F.size(skills) == 0) | (F.size(F.array_intersect(skills, F.col("_skills"))) == F.size(skills)), F.lit(False))
    met = part.join(F.broadcast(side) if small else side, ["_country", "_mode"]).where((F.col("at") > F.col("since")) & conditions() & there)
    return met.select("filter", "id", "at")
