"""State changes as set-based rewrites: each takes frames and returns the frame after the change."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import trigrams
from .feed import as_of_column

STRIKES, SIMILAR, BACKOFF_ERRORS, BACKOFF_HOURS = 2, 0.9, 5, 6
RETENTION_MONTHS, ERASURE_DAYS = 24, 7


def merge_frames(old: DataFrame, new: DataFrame, keys: list[str], rules: Mapping[str, Callable[[Column, Column], Column]], inserted: Mapping[str, Column] | None = None) -> DataFrame:
    """Full outer join on ``keys``. ``rules`` give a column's value from (old, new) where both rows are there.

    A row of one side only is kept as it is; columns without a rule take the new value.
    Each side holds a key once. A column that only ``old`` has is null in new rows unless
    ``inserted`` gives it a value.
    """
    a, b = old.alias("a"), new.alias("b").withColumn("_new", F.lit(True))
    both = a.withColumn("_old", F.lit(True)).join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    there, fresh = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    out = []
    for c in old.columns:
        o = F.col(f"a.{c}")
        if c not in new.columns:
            out.append(F.when(there, o).otherwise((inserted or {}).get(c, F.lit(None))).cast(old.schema[c].dataType).alias(c))
            continue
        n = F.col(f"b.{c}")
        met = rules[c](o, n) if c in rules else n
        out.append(F.when(there & fresh, met).when(fresh, n).otherwise(o).alias(c))
    return both.select(*out)


def upsert_postings(old: DataFrame, seen: DataFrame, as_of: str | Column) -> DataFrame:
    """Postings after a poll: seen rows are live again; an empty body or markup erases none; a real date stays.

    ``seen`` has (source_id, external_id) and the columns to set, among them description_text,
    description_html, posted_at, posted_at_is_estimate and parse_confidence. Known rows keep
    their id; new ones get one from a hash of source and external id, which a repeated poll
    gives again. ``seen`` holds a key once.
    """
    body = lambda n: F.coalesce(n, F.lit("")) != ""
    kept = lambda o, n: F.when(body(n), n).otherwise(o)
    loose = F.col("a.posted_at_is_estimate") | F.col("a.posted_at").isNull()
    rules = {
        "id": lambda o, n: o,
        "description_text": kept,
        "description_html": kept,
        "posted_at": lambda o, n: F.when(loose, n).otherwise(o),
        "posted_at_is_estimate": lambda o, n: F.when(loose, n).otherwise(F.lit(False)),
        "parse_confidence": lambda o, n: F.when(body(F.col("b.description_text")), n).otherwise(F.greatest(o, n)),
        "first_seen_at": lambda o, n: o,
    }
    extra = {"status": F.lit("live"), "closed_at": F.lit(None).cast("timestamp_ntz"), "missing_count": F.lit(0)}
    new = seen.select("*", *(v.alias(k) for k, v in extra.items() if k not in seen.columns))
    if "first_seen_at" in old.columns and "first_seen_at" not in seen.columns:
        new = new.withColumn("first_seen_at", as_of_column(as_of))
    if "id" in old.columns:
        # 60 bits of md5, which any engine computes alike.
        own = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("source_id").cast("string"), "external_id")), 1, 15), 16, 10).cast("long")
        new = new.withColumn("id", own if "id" not in seen.columns else F.coalesce("id", own))
    return merge_frames(old, new, ["source_id", "external_id"], rules)


def replace_children(old: DataFrame, new: DataFrame, vocabulary: DataFrame, parent: str, key: str) -> DataFrame:
    """Children of the parents in ``new`` are replaced; rows outside the vocabulary vanish."""
    parents = new.select(parent).distinct()
    known = new.join(vocabulary.select(key).distinct(), key, "left_semi")
    return old.join(parents, parent, "left_anti").unionByName(known.select(*old.columns))


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Appends rows whose key is not there yet; among new rows with one key one stays."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti").select(*old.columns))


def reconcile_absent(postings: DataFrame, seen: DataFrame, polled: DataFrame, as_of: str | Column, strikes: int = STRIKES) -> DataFrame:
    """Live postings of polled sources that were not seen miss once more, and close at the last strike.

    ``seen``: (source_id, external_id); ``polled``: source_id. A polled source without any seen
    row has lost all its postings; a source that is not polled is left alone.
    """
    hits = seen.select("source_id", "external_id").distinct().withColumn("_seen", F.lit(True))
    checked = polled.select("source_id").distinct().withColumn("_polled", F.lit(True))
    joined = postings.join(checked, "source_id", "left").join(hits, ["source_id", "external_id"], "left")
    gone = (F.col("status") == "live") & F.col("_polled").isNotNull() & F.col("_seen").isNull()
    missed = F.col("missing_count") + 1
    values = {
        "missing_count": F.when(gone, missed).otherwise(F.col("missing_count")).cast("int"),
        "closed_at": F.when(gone & (missed >= strikes), as_of_column(as_of)).otherwise(F.col("closed_at")),
        "status": F.when(gone & (missed >= strikes), F.lit("closed")).otherwise(F.col("status")),
    }
    return joined.select(*((values[c].alias(c) if c in values else F.col(c)) for c in postings.columns))


def _titles_alike(live: DataFrame, threshold: float) -> DataFrame:
    """(company_id, t, b_t, sim): pairs of different lower-case titles of a company with a similarity of at least ``threshold``.

    Every title of a company counts once, with its trigrams. Of two sets with that similarity
    the first |x| - ceil(threshold * |x|) + 1 elements, in any one order, share one: titles meet
    by company and such a trigram, rarest in the company first, so a large company is split.
    """
    titles = live.select("company_id", F.lower("title").alias("t")).where("t IS NOT NULL").distinct().withColumn("grams", trigrams(F.col("t")))
    grams = titles.select("company_id", "t", F.explode("grams").alias("gram"))
    rare = grams.join(grams.groupBy("company_id", "gram").count(), ["company_id", "gram"])
    ordered = rare.groupBy("company_id", "t").agg(F.array_sort(F.collect_list(F.struct("count", "gram"))).alias("grams")).withColumn("n", F.size("grams"))
    ordered = ordered.withColumn("prefix", F.slice("grams.gram", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")))
    side = ordered.select("company_id", "t", "n", F.col("grams.gram").alias("grams"), F.explode("prefix").alias("gram"))
    b = side.select("company_id", "gram", F.col("t").alias("b_t"), F.col("n").alias("b_n"), F.col("grams").alias("b_grams"))
    met = side.join(b, ["company_id", "gram"]).where((F.col("t") < F.col("b_t")) & (F.least("n", "b_n") >= threshold * F.greatest("n", "b_n") - 1e-9))
    common = F.size(F.array_intersect("grams", "b_grams"))
    close = met.select("company_id", "t", "b_t", (common / (F.col("n") + F.col("b_n") - common)).alias("sim")).where(F.col("sim") >= threshold).distinct()
    return close.unionByName(close.select("company_id", F.col("b_t").alias("t"), F.col("t").alias("b_t"), "sim"))


def duplicate_pairs(postings: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(loser_id, keeper_id): per live posting the most similar strictly better one of another source of its company.

    Postings meet by company and equal title, or through the pairs of titles that are alike;
    no similarity is computed for a pair of postings. Of equally similar ones the lowest id counts.
    """
    live = postings.where(F.col("status") == "live")
    rank = [F.col("parse_confidence"), F.char_length(F.coalesce("description_text", F.lit(""))), -F.unix_micros(F.col("first_seen_at").cast("timestamp")), -F.col("id")]
    side = live.select("company_id", "id", "source_id", F.lower("title").alias("t"), "city", "mode", *(r.alias(f"r{i}") for i, r in enumerate(rank)))
    b = side.select(*(F.col(c).alias(c if c == "company_id" else f"b_{c}") for c in side.columns))
    worse = F.lit(False)
    for i in reversed(range(len(rank))):
        worse = (F.col(f"b_r{i}") > F.col(f"r{i}")) | ((F.col(f"b_r{i}") == F.col(f"r{i}")) & worse)
    same = lambda c, unknown: (F.col(c) == F.col(f"b_{c}")) | unknown(F.col(c)) | unknown(F.col(f"b_{c}"))
    equal = side.join(b, (side["company_id"] == b["company_id"]) & (F.col("t") == F.col("b_t"))).drop(b["company_id"]).withColumn("sim", F.lit(1.0))
    alike = side.join(_titles_alike(live, threshold), ["company_id", "t"]).join(b, ["company_id", "b_t"])
    close = equal.unionByName(alike.select(*equal.columns)).where((F.col("source_id") != F.col("b_source_id")) & worse)
    close = close.where(same("city", lambda x: x.isNull()) & same("mode", lambda x: x == "unknown"))
    best = F.min(F.struct((-F.col("sim")).alias("far"), "b_id"))
    return close.groupBy(F.col("id").alias("loser_id")).agg(best.alias("x")).select("loser_id", F.col("x.b_id").alias("keeper_id"))


def dedupe(postings: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``postings`` after losers are superseded, with canonical_id. All pairs see the state before the change."""
    pairs = duplicate_pairs(postings, threshold)
    lost = F.col("loser_id").isNotNull()
    keep = [c for c in postings.columns if c != "canonical_id"]
    old = F.col("canonical_id") if "canonical_id" in postings.columns else F.lit(None).cast("long")
    return postings.join(pairs, postings["id"] == pairs["loser_id"], "left").select(
        *(F.when(lost, F.lit("superseded")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in keep), F.when(lost, F.col("keeper_id")).otherwise(old).alias("canonical_id")
    )


def claim_due(sources: DataFrame, as_of: str | Column, limit: int, hours: Mapping[str, int] | None = None) -> DataFrame:
    """The ``limit`` sources that are due first, with their next poll; the jitter is a hash of the id, up to five minutes."""
    hours = hours or {"a": 2, "b": 6, "c": 24}
    now = as_of_column(as_of)
    due = sources.where((F.col("next_poll_at") <= now) & (F.col("tier") != "paused") & (F.col("disabled_until").isNull() | (F.col("disabled_until") < now)))
    step = F.when(F.col("tier") == "a", hours["a"]).when(F.col("tier") == "b", hours["b"]).otherwise(hours["c"])
    jitter = F.make_dt_interval(secs=F.pmod(F.xxhash64("id"), F.lit(300)).cast("decimal(18,6)"))
    return due.orderBy("next_poll_at", "id").limit(limit).withColumn("next_poll_at", now + F.make_dt_interval(hours=step) + jitter)


def retier(sources: DataFrame, watched: DataFrame, as_of: str | Column) -> DataFrame:
    """Tiers by who watches and how lately the board changed; paused sources stay paused."""
    now = as_of_column(as_of)
    companies = watched.select(F.col("company_id").alias("_watched")).distinct()
    within = lambda days: F.col("last_changed_at") > now - F.make_dt_interval(days=F.lit(days))
    tier = F.when(F.col("tier") == "paused", F.col("tier")).when(F.col("_watched").isNotNull() | within(7), "a").when(within(30), "b").otherwise("c")
    return sources.join(companies, sources["company_id"] == companies["_watched"], "left").withColumn("tier", tier).drop("_watched")


def poll_failed(sources: DataFrame, failed: DataFrame, as_of: str | Column) -> DataFrame:
    """Bookkeeping after failed polls; ``failed``: (id, retry_hours). A given pause wins; else five errors pause for six hours."""
    now, errors = as_of_column(as_of), F.col("consecutive_errors") + 1
    hit = F.col("_failed").isNotNull()
    until = F.when(F.col("_retry") > 0, now + F.make_dt_interval(hours=F.col("_retry"))).when(errors >= BACKOFF_ERRORS, now + F.make_dt_interval(hours=F.lit(BACKOFF_HOURS))).otherwise(F.col("disabled_until"))
    side = failed.select(F.col("id").alias("_failed"), F.col("retry_hours").alias("_retry"))
    joined = sources.join(side, sources["id"] == side["_failed"], "left")
    values = {"consecutive_errors": F.when(hit, errors).otherwise(F.col("consecutive_errors")), "disabled_until": F.when(hit, until).otherwise(F.col("disabled_until"))}
    return joined.select(*((values[c].alias(c) if c in values else F.col(c)) for c in sources.columns))


def poll_succeeded(sources: DataFrame, polled: DataFrame, as_of: str | Column) -> DataFrame:
    """``polled``: (id, changed). Errors and pauses end; a change moves last_changed_at."""
    side = polled.select(F.col("id").alias("_polled"), F.col("changed").alias("_changed"))
    hit, changed = F.col("_polled").isNotNull(), F.coalesce("_changed", F.lit(False))
    joined = sources.join(side, sources["id"] == side["_polled"], "left")
    values = {
        "consecutive_errors": F.when(hit, 0).otherwise(F.col("consecutive_errors")).cast("int"),
        "last_changed_at": F.when(changed, as_of_column(as_of)).otherwise(F.col("last_changed_at")),
        "disabled_until": F.when(changed, F.lit(None)).otherwise(F.col("disabled_until")) if "disabled_until" in sources.columns else None,
    }
    return joined.select(*((values[c].alias(c) if values.get(c) is not None else F.col(c)) for c in sources.columns))


def changed_boards(snapshots: DataFrame, last: DataFrame) -> DataFrame:
    """Snapshots (source_id, body) whose hash differs from the last one's (source_id, content_hash)."""
    hashed = snapshots.withColumn("content_hash", F.sha2(F.coalesce("body", F.lit("")), 256))
    return hashed.join(last.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti").select("source_id", "body", "content_hash")


def register_boards(sources: DataFrame, boards: DataFrame) -> DataFrame:
    """Registry after an upsert of (vendor, board_token, company) that prunes what is not listed; an empty list is refused."""
    if boards.isEmpty():
        raise ValueError("an empty board list would delete every source")
    listed = boards.dropDuplicates(["vendor", "board_token"])
    kept = sources.join(listed.select("vendor", "board_token"), ["vendor", "board_token"], "left_semi").select(*sources.columns)
    return merge_frames(kept, listed, ["vendor", "board_token"], {})


def register_registry(companies: DataFrame, sources: DataFrame, postings: DataFrame, boards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, sources, postings) after a list of boards (slug, name, vendor, board_token) is the registry.

    Companies are known by slug and take the listed name, sources by (vendor, board_token) and take the listed company, with
    ids of hashes where they are new. Sources that are not listed go with their postings, and companies
    without a source go. An empty list is refused. Of repeated boards and slugs the smallest row counts.
    """
    if boards.isEmpty():
        raise ValueError("an empty board list would delete every source")
    listed = boards.groupBy("vendor", "board_token").agg(F.min(F.struct("slug", "name")).alias("x")).select("vendor", "board_token", "x.slug", "x.name")
    own = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long")
    named = listed.groupBy("slug").agg(F.min("name").alias("name")).withColumn("id", own("slug"))
    companies = merge_frames(companies, named, ["slug"], {"id": lambda o, n: o})
    wanted = listed.join(companies.select("slug", F.col("id").alias("company_id")), "slug").withColumn("id", own("vendor", "board_token")).select("id", "vendor", "board_token", "company_id")
    kept = sources.join(listed.select("vendor", "board_token"), ["vendor", "board_token"], "left_semi").select(*sources.columns)
    sources = merge_frames(kept, wanted, ["vendor", "board_token"], {"id": lambda o, n: o}, {"tier": F.lit("a")})
    postings = postings.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*postings.columns)
    companies = companies.join(sources.select(F.col("company_id").alias("id")), "id", "left_semi").select(*companies.columns)
    return companies, sources, postings


def erase_users(users: DataFrame, as_of: str | Column, days: int = ERASURE_DAYS) -> DataFrame:
    """Users who asked for deletion ``days`` days ago are anonymised: address gone, deleted_at set."""
    now = as_of_column(as_of)
    due = F.col("deleted_at").isNull() & (F.col("deletion_requested_at") < now - F.make_dt_interval(days=F.lit(days)))
    due = F.coalesce(due, F.lit(False))
    values = {"email": F.when(due, F.concat(F.lit("deleted-"), F.col("id").cast("string"), F.lit("@invalid"))).otherwise(F.col("email")), "deleted_at": F.when(due, now).otherwise(F.col("deleted_at"))}
    return users.select(*((values[c].alias(c) if c in values else F.col(c)) for c in users.columns))


def blank_expired(resumes: DataFrame, as_of: str | Column) -> DataFrame:
    """Résumé bodies past ``retain_until`` are blanked; rows stay."""
    over = F.coalesce(F.col("retain_until") < as_of_column(as_of), F.lit(False))
    return resumes.select(*((F.when(over, F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("parsed_text", "file_name") else F.col(c)) for c in resumes.columns))


def prune_postings(applications: DataFrame, removed: DataFrame) -> DataFrame:
    """Applications outlive their posting: its id becomes null."""
    gone = removed.select(F.col("id").alias("_gone")).distinct()
    joined = applications.join(gone, applications["posting_id"] == gone["_gone"], "left")
    return joined.select(*((F.when(F.col("_gone").isNotNull(), F.lit(None)).otherwise(F.col(c)).alias(c) if c == "posting_id" else F.col(c)) for c in applications.columns))


def backfill_yoe_confidence(postings: DataFrame) -> DataFrame:
    """Confidence of the stated years where it is missing: 0.9 with a minimum, 0 without."""
    value = F.when(F.col("yoe_confidence").isNotNull(), F.col("yoe_confidence")).when(F.col("yoe_min").isNotNull(), 0.9).otherwise(0.0)
    return postings.withColumn("yoe_confidence", value)


def undo_in_source(postings: DataFrame) -> DataFrame:
    """Superseded postings whose keeper is of the same source are live again."""
    keeper = postings.select(F.col("id").alias("_keeper"), F.col("source_id").alias("_source"))
    joined = postings.join(keeper, postings["canonical_id"] == keeper["_keeper"], "left")
    undo = F.coalesce((F.col("status") == "superseded") & (F.col("_source") == F.col("source_id")), F.lit(False))
    values = {"status": F.when(undo, "live").otherwise(F.col("status")), "canonical_id": F.when(undo, F.lit(None)).otherwise(F.col("canonical_id"))}
    return joined.select(*((values[c].alias(c) if c in values else F.col(c)) for c in postings.columns))
