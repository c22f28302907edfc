"""Polls as data: how a truncated board is read in slices, how details are fetched within a budget, what a fetch means.

Responses and fetch logs are tables; the rules that decide what to ask next, and what an answer does to a
source, are relational or a fold over a source's fetches in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, vendors

# What a capped total shows at most, postings of a page, pages of a slice beyond those that the cap fills.
CAP, PAGE, SPARE_PAGES = 2000, 20, 10
# Pauses after a board is gone and after a rate limit without a usable time; failures in a row and the pause they bring.
GONE_HOURS, LIMITED_MINUTES, BREAKER, BREAKER_HOURS = 24, 15, 5, 6
#: The cursor of a finished sweep; 0 is one that has not begun.
DONE = -1

_HEAD = "total int, facets array<struct<facetParameter:string,values:array<struct<id:string,count:int>>>>"


def _heads(responses: DataFrame) -> DataFrame:
    return responses.where("page = 0").select("source_id", "path", F.from_json("body", _HEAD).alias("x"))


def _cut_by(head: DataFrame, cap: int) -> DataFrame:
    """(source_id, path, f): the facet by which a slice is to be cut, null where it is complete or cannot be cut."""
    counts = lambda f: F.aggregate(f["values"], F.lit(0), lambda a, v: a + F.coalesce(v["count"], F.lit(0)))
    hidden = (F.col("x.total") >= cap) | (F.coalesce(F.array_max(F.transform("x.facets", counts)), F.lit(0)) > F.col("x.total"))
    used = lambda f: F.contains(F.concat(F.lit("&"), "path"), F.concat(F.lit("&"), f["facetParameter"], F.lit("=")))
    several = lambda f: (F.size(f["values"]) > 1) & (F.coalesce(f["values"][0]["count"], F.lit(0)) != 0)
    fit = F.filter("x.facets", lambda f: (F.coalesce(f["facetParameter"], F.lit("")) != "") & several(f) & ~used(f))
    most = F.array_max(F.transform(fit, lambda f: F.size(f["values"])))
    return head.select("source_id", "path", F.when(hidden, F.get(F.filter(fit, lambda f: F.size(f["values"]) == most), F.lit(0))).alias("f"))


def _parts(cut: DataFrame) -> DataFrame:
    """(source_id, path, part, i): the slices into which those of ``cut`` (source_id, path, f) fall, ``i`` their order."""
    values = cut.select("source_id", "path", F.posexplode("f.values").alias("i", "v"), F.col("f.facetParameter").alias("name"))
    return values.select("source_id", "path", F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("&"))).otherwise(""), "name", F.lit("="), "v.id").alias("part"), "i")


def slices(responses: DataFrame, cap: int = CAP) -> DataFrame:
    """(source_id, path, place): the slices by which each board is read, ``place`` their order as a list of numbers.

    ``responses`` has (source_id, path, page, body): answers to list requests, ``path`` the facets asked for
    as ``facet=value`` joined by ``&``, empty for the whole board. A slice whose first page is truncated
    (its total is at the cap, or a facet counts more) is replaced by one slice for each
    value of a facet: the one with most values of those that have several and counts, the first of equals, none
    twice on a path. This is repeated until nothing truncated can be cut; a slice whose parts were never
    answered is read as it is.
    """
    plan = store.written(_cut_by(_heads(responses), cap), "slice-plan")
    answered = plan.select("source_id", F.col("path").alias("part"))
    open_, done = plan.where("path = ''").select("source_id", "path", F.array(F.lit(0)).alias("place")), None
    while True:
        cut = _parts(open_.join(plan, ["source_id", "path"])).join(open_, ["source_id", "path"]).join(answered, ["source_id", "part"], "left_semi")
        parts = store.written(cut.select("source_id", F.col("path").alias("parent"), "part", F.concat("place", F.array("i")).alias("place")), "slices")
        whole = open_.join(parts.select("source_id", F.col("parent").alias("path")).distinct(), ["source_id", "path"], "left_anti")
        done = whole if done is None else done.unionByName(whole)
        if parts.isEmpty():
            return done
        open_ = parts.select("source_id", F.col("part").alias("path"), "place")


def missing_slices(responses: DataFrame, cap: int = CAP) -> DataFrame:
    """(source_id, path): requests that the answers so far call for and that nobody has answered."""
    head = _heads(responses)
    asked = _parts(_cut_by(head, cap)).select("source_id", F.col("part").alias("path"))
    return asked.join(head.select("source_id", "path"), ["source_id", "path"], "left_anti")


def workday_board(responses: DataFrame, cap: int = CAP, page_size: int = PAGE) -> DataFrame:
    """Postings of boards read slice by slice, as ``vendors.workday`` gives them, with ``position``, their order on the board from 1.

    A slice is read page by page up to the first short one, and no farther than ``cap`` postings and SPARE_PAGES
    pages: 110 pages at the vendor's cap. Of a posting that comes again its first position counts and its last
    content. Postings are numbered inside their slice, which the cap bounds, and shifted by what the slices before hold.
    """
    schema = "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>"
    jobs = responses.select("source_id", "path", "page", F.from_json("body", schema)["jobPostings"].alias("jobs")).where(F.col("page") < -(-cap // page_size) + SPARE_PAGES)
    key = lambda j: F.coalesce(F.get(j["bulletFields"], F.lit(0)), j["externalPath"])
    good = F.filter("jobs", lambda j: (F.coalesce(key(j), F.lit("")) != "") & (F.btrim(F.coalesce(j["title"], F.lit(""))) != ""))
    w = Window.partitionBy("source_id", "path").orderBy("page")
    full = F.coalesce(F.min(F.size("good") >= page_size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    pages = jobs.withColumn("good", F.coalesce(good, F.array().cast(jobs.schema["jobs"].dataType))).withColumn("read", full & (F.row_number().over(w) == F.col("page") + 1)).where("read")
    each = pages.join(slices(responses, cap), ["source_id", "path"]).select("source_id", F.concat("place", F.array("page")).alias("at"), F.posexplode("good").alias("i", "j"))
    each = each.select("source_id", F.concat("at", F.array("i")).alias("at"), key(F.col("j")).alias("key"), "j")
    met = each.groupBy("source_id", "key").agg(F.max_by("j", "at").alias("j"), F.min("at").alias("first"))
    met = met.withColumn("slice", F.slice("first", F.lit(1), F.size("first") - 2))
    sizes = met.groupBy("source_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("source_id", "slice", (F.sum("n").over(Window.partitionBy("source_id").orderBy("slice")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source_id", "slice").orderBy("first"))
    placed = met.withColumn("inside", inside).join(before, ["source_id", "slice"]).withColumn("position", (F.col("before") + F.col("inside")).cast("int"))
    j = F.col("j")
    out = vendors._postings(placed, external_id=F.col("key"), requisition_id=F.get(j["bulletFields"], F.lit(0)), title=j["title"], location_raw=j["locationsText"], posting_url=j["externalPath"], apply_url=j["externalPath"], posted_at_is_estimate=F.lit(True), raw=F.to_json(j))
    return out.join(placed.select("source_id", F.col("key").alias("external_id"), "position"), ["source_id", "external_id"])


def sweep_plan(state: DataFrame, boards: DataFrame, budget: int) -> DataFrame:
    """(source_id, content_hash, total, first, last, unchanged): the places whose details this poll fetches, ``last`` exclusive.

    ``state`` has (source_id, detail_cursor, content_hash), ``boards`` (source_id, content_hash, total). A sweep goes on
    where it stopped, even on an unchanged board; a finished one starts anew only when the board changed; a cursor behind
    a board that shrank starts anew. A source without state begins.
    """
    known = state.select("source_id", F.col("detail_cursor").alias("_c"), F.col("content_hash").alias("_h"))
    c, total = F.coalesce("_c", F.lit(0)), F.col("total")
    unchanged = (c == DONE) & F.coalesce(F.col("_h") == F.col("content_hash"), F.lit(False))
    first = F.when((c == DONE) | (c >= total), 0).otherwise(F.greatest(c, F.lit(0)))
    out = boards.join(known, "source_id", "left").withColumn("unchanged", unchanged).withColumn("first", first)
    return out.select("source_id", "content_hash", "total", "first", F.when(F.col("unchanged"), F.col("first")).otherwise(F.least(F.col("first") + budget, total)).cast("int").alias("last"), "unchanged")


def sweep_requests(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """The rows of ``listing`` (source_id, place from 0, ...) whose details the plan fetches."""
    window = plan.select("source_id", "first", "last")
    return listing.join(window, "source_id").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("last"))).drop("first", "last")


def sweep_state(state: DataFrame, plan: DataFrame, results: DataFrame) -> DataFrame:
    """State (source_id, detail_cursor, content_hash) after a poll; ``results``: (source_id, filled, cut_off).

    A window of which nothing was read because the run was cut off is asked for again; a sweep that reached the
    board's end is finished; an unchanged board keeps its state, as does a source that was not polled.
    """
    got = plan.join(results.select("source_id", "filled", "cut_off"), "source_id", "left")
    stuck = (F.coalesce("filled", F.lit(0)) == 0) & F.coalesce("cut_off", F.lit(False))
    cursor = F.when(F.col("unchanged"), DONE).when(stuck, F.col("first")).when(F.col("last") >= F.col("total"), DONE).otherwise(F.col("last"))
    polled = got.select("source_id", cursor.cast("int").alias("detail_cursor"), "content_hash")
    return polled.unionByName(state.join(polled, "source_id", "left_anti").select("source_id", F.col("detail_cursor").cast("int").alias("detail_cursor"), "content_hash"))


def ring_requests(listing: DataFrame, cursors: DataFrame, budget: int) -> DataFrame:
    """Rows of ``listing`` (source_id, place, total) in a window of ``budget`` from the cursor that goes on at the board's start, with ``next_cursor``.

    No place comes twice; a cursor past the end starts anew.
    """
    at = cursors.select("source_id", F.col("detail_cursor").alias("_c"))
    start = F.when(F.coalesce("_c", F.lit(0)) >= F.col("total"), 0).otherwise(F.coalesce("_c", F.lit(0)))
    n = F.least(F.lit(budget), F.col("total"))
    rows = listing.join(at, "source_id", "left").withColumn("_s", start)
    end = F.col("_s") + n
    return rows.where(F.pmod(F.col("place") - F.col("_s"), F.col("total")) < n).withColumn("next_cursor", F.when(end > F.col("total"), end - F.col("total")).otherwise(end).cast("int")).drop("_c", "_s")


def retry_micros(header: Column, at: Column) -> Column:
    """Microseconds that a Retry-After header asks for: a number of seconds, or until a date later than ``at``; 0 where it says nothing usable."""
    text = F.btrim(header)
    day = F.regexp_replace(text, r"^[A-Za-z]+,?\s+", "")
    # Years of two digits are 1969 to 2068.
    day = F.regexp_replace(F.regexp_replace(day, r"^(\d\d-[A-Za-z]{3}-)(\d\d )", "$120$2"), r"^(\d\d-[A-Za-z]{3}-)20(69|[789]\d) ", "$119$2 ")
    layouts = ("dd MMM yyyy HH:mm:ss 'GMT'", "dd-MMM-yyyy HH:mm:ss 'GMT'", "MMM d HH:mm:ss yyyy")
    date = F.coalesce(*(F.try_to_timestamp(F.regexp_replace(day, r"\s+", " "), F.lit(x)).cast("timestamp_ntz") for x in layouts))
    ahead = F.timestamp_diff("MICROSECOND", at, date)
    # At most some thousand years, which still fit.
    return F.coalesce(F.when(text.rlike(r"^\+?\d{1,11}$"), text.try_cast("bigint") * 1_000_000), F.when(ahead > 0, ahead), F.lit(0)).cast("long")


#: What a fetch log holds and what the fold adds; ``micros`` is the instant of the fetch.
_LOG = ("source_id", "micros", "fetch_id", "status", "etag", "last_modified", "body_hash", "retry")
OUTCOMES = "source_id long, micros long, fetch_id long, outcome string, consecutive_errors int, disabled_until long, etag string, last_modified string, content_hash string"
_START = (0, None, None, None, None)


def _said(new: str | None, old: str | None) -> str | None:
    """What was said now, or else before; blanks say nothing."""
    return new.strip() if new and new.strip() else old


def fetch_step(state: tuple, micros: int, status: int | None, etag: str | None, last_modified: str | None, body_hash: str | None, retry: int) -> tuple[str, tuple]:
    """(outcome, state) after a fetch; the state: errors in a row, pause until, validators, hash of the last body."""
    errors, until, old_etag, old_modified, old_hash = state
    if until is not None and until >= micros:
        return "paused", state
    if status == 304 or (status is not None and status < 400 and body_hash is not None and body_hash == old_hash):
        return "unchanged", (0, until, _said(etag, old_etag), _said(last_modified, old_modified), old_hash)
    if status is not None and status < 400:
        return "changed", (0, None, etag or None, last_modified or None, body_hash)
    pause, outcome = 0, "failed"
    if status in (404, 410):
        pause, outcome = GONE_HOURS * 3_600_000_000, "gone"
    elif status == 429:
        pause, outcome = retry if retry > 0 else LIMITED_MINUTES * 60_000_000, "limited"
    errors += 1
    if pause:
        until = micros + pause
    elif errors >= BREAKER:
        until = micros + BREAKER_HOURS * 3_600_000_000
    return outcome, (errors, until, old_etag, old_modified, old_hash)


def prepared_log(fetches: DataFrame) -> DataFrame:
    """The columns of the fold from (source_id, fetched_at, fetch_id, status, etag, last_modified, body, retry_after); no status is a failed connection."""
    at = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    body = F.when(F.col("body").isNotNull(), F.sha2("body", 256))
    return fetches.select("source_id", at.alias("micros"), "fetch_id", "status", "etag", "last_modified", body.alias("body_hash"), retry_micros(F.col("retry_after"), F.col("fetched_at")).alias("retry"))


def _fold(rows: pd.DataFrame, state: tuple, out: list) -> tuple:
    for r in rows.itertuples(index=False):
        clean = [None if pd.isna(x) else x for x in r]
        outcome, state = fetch_step(state, int(clean[1]), None if clean[3] is None else int(clean[3]), *clean[4:7], int(clean[7] or 0))
        out.append((int(clean[0]), int(clean[1]), int(clean[2]), outcome, *state))
    return state


def _outcomes(rows: list) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTCOMES.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"disabled_until": "Int64"})


def readable(outcomes: DataFrame) -> DataFrame:
    """Outcomes with instants as timestamps."""
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    rest = ("etag", "last_modified", "content_hash")
    return outcomes.select("source_id", stamp("micros").alias("fetched_at"), "fetch_id", "outcome", "consecutive_errors", stamp("disabled_until").alias("disabled_until"), *rest)


def fetch_outcomes(fetches: DataFrame) -> DataFrame:
    """What every fetch meant and the state of its source after it.

    paused: it came before a pause was over and changes nothing. unchanged: 304 or the same body. changed, gone (404, 410),
    limited (429), failed (other errors). Fetches of a source are folded in the order of time and id. Rows stream through
    sorted partitions, so a source of any length needs the memory of one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, _START
        for batch in batches:
            out: list = []
            for source, rows in batch.groupby("source_id", sort=False):
                state = _fold(rows, state if source == last else _START, out)
                last = source
            yield _outcomes(out)

    log = prepared_log(fetches).where("source_id IS NOT NULL AND micros IS NOT NULL")
    return readable(log.repartition("source_id").sortWithinPartitions("source_id", "micros", "fetch_id").mapInPandas(run, OUTCOMES))
