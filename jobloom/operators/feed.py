"""The feed: filters that never hide unknown values, sort modes, pages, facets.

A ``FeedFilter`` becomes one Column predicate, so all of it reaches the scan or the join
below it. Time comes in as ``as_of``; nothing here asks for the current time.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.search import search
from ..functions.text import display_name
from ..functions.vocabulary import DISPLAY

# Units of a currency for one US dollar; others count as 1.
USD_RATES = {"GBP": 0.738359, "EUR": 0.861401, "CAD": 1.386295, "SGD": 1.271737, "AUD": 1.395860, "JPY": 159.787727, "SEK": 9.580693, "INR": 95.201365}
# Experience bands as (lowest, highest) least years.
YOE_BANDS = {"0-2": (None, 2), "3-5": (3, 5), "6-8": (6, 8), "9+": (9, None)}
WINDOWS_HOURS = {"24h": 24, "3d": 72, "7d": 168, "14d": 336}
COMP_FLOORS = (100000, 150000, 200000)
SORTS = ("newest", "comp", "relevance", "match")
DEFAULT_LIMIT, MAX_LIMIT, CANDIDATES = 25, 50, 2000


class FilterError(ValueError):
    """A query string that the feed does not understand."""


@dataclass(frozen=True)
class FeedFilter:
    countries: tuple[str, ...] = ()
    modes: tuple[str, ...] = ()
    yoe: tuple[str, ...] = ()
    comp_min: float | None = None
    disclosed_only: bool = False
    field: str = ""
    include_dismissed: bool = False
    posted_within_hours: int | None = None
    posted_after: str | None = None
    vendors: tuple[str, ...] = ()
    query: str = ""
    skills: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    sort: str = "newest"
    limit: int = DEFAULT_LIMIT
    cursor: str = ""


_PARAMS = {"country", "mode", "yoe", "comp_min", "disclosed", "field", "dismissed", "posted", "vendor", "q", "skills", "band", "sort", "limit", "cursor", "yoe_stretch"}


def _list(text: str) -> tuple[str, ...]:
    return tuple(x for x in (part.strip() for part in text.split(",")) if x)


def parse_query(text: str) -> FeedFilter:
    """A filter from a URL query string; unknown parameters and values out of range are errors."""
    given = {k: v[-1] for k, v in parse_qs(text.lstrip("?"), keep_blank_values=True).items()}
    if unknown := sorted(set(given) - _PARAMS):
        raise FilterError(f"unknown parameter {unknown[0]}")

    def number(name: str, kind=int):
        if not given.get(name):
            return None
        try:
            return kind(given[name])
        except ValueError:
            raise FilterError(f"{name} is not a number") from None

    def yoe(value: str) -> str:
        if not value.isdigit():
            return value
        n = int(value)
        return next(band for band, (lo, hi) in YOE_BANDS.items() if (lo or 0) <= n <= (n if hi is None else hi))

    limit, window, sort = number("limit"), given.get("posted", ""), given.get("sort") or "newest"
    if limit is not None and not 1 <= limit <= MAX_LIMIT:
        raise FilterError("limit is out of range")
    if window not in ("", "any", *WINDOWS_HOURS):
        raise FilterError("unknown window")
    if sort not in SORTS:
        raise FilterError("unknown sort")
    return FeedFilter(
        countries=_list(given.get("country", "")), modes=_list(given.get("mode", "")), yoe=tuple(map(yoe, _list(given.get("yoe", "")))), comp_min=number("comp_min", float),
        disclosed_only=given.get("disclosed") in ("1", "true"), field=given.get("field", ""), include_dismissed=given.get("dismissed") in ("1", "true"),
        posted_within_hours=WINDOWS_HOURS.get(window), vendors=_list(given.get("vendor", "")), query=given.get("q", ""), skills=_list(given.get("skills", "")), bands=_list(given.get("band", "")),
        sort=sort, limit=limit or DEFAULT_LIMIT, cursor=given.get("cursor", ""),
    )


def as_of_column(as_of: str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def freshness() -> Column:
    return F.coalesce("posted_at", "first_seen_at")


def comp_usd() -> Column:
    """Stated minimum pay in dollars, for ordering only; period and unknown currencies are ignored."""
    rate = F.lit(1.0)
    for currency, value in USD_RATES.items():
        rate = F.when(F.col("comp_currency") == currency, value).otherwise(rate)
    return F.coalesce(F.col("comp_min"), F.lit(0.0)).cast("double") / rate


def yoe_predicate(bands: tuple[str, ...]) -> Column | None:
    """Rows in any band; rows of low confidence or without a stated minimum stay. None without a known band."""
    low = F.col("yoe_min")
    known = [(low >= lo if hi is None else low <= hi if lo is None else low.between(lo, hi)) for lo, hi in (YOE_BANDS[b] for b in bands if b in YOE_BANDS)]
    if not known:
        return None
    keep = (F.col("yoe_confidence") < 0.5) | low.isNull()
    for band in known:
        keep = keep | band
    return keep


def conditions() -> Column:
    """The row-wise conditions of a filter that stands beside the row, in columns named ``q_`` and the field: empty lists, nulls and false ask for nothing.

    ``predicate`` says the same of one filter with literals; a test holds the two together.
    """
    listed = lambda c: F.coalesce(F.col(f"q_{c}"), F.array().cast("array<string>"))
    asks, has = lambda c: F.size(listed(c)) > 0, lambda c, value: F.array_contains(listed(c), value)
    low = F.col("yoe_min")
    in_band = F.lit(False)
    for name, (lo, hi) in YOE_BANDS.items():
        in_band |= has("yoe", F.lit(name)) & (low >= lo if hi is None else low <= hi if lo is None else low.between(lo, hi))
    some_band = F.arrays_overlap(listed("yoe"), F.array(*map(F.lit, YOE_BANDS)))
    floor, disclosed, kind = F.col("q_comp_min"), F.coalesce("q_disclosed_only", F.lit(False)), F.coalesce("q_field", F.lit(""))
    keep = (~asks("countries") | has("countries", F.col("country")) | F.col("country").isNull()) & (~asks("modes") | has("modes", F.col("mode")))
    keep &= ~some_band | (F.col("yoe_confidence") < 0.5) | low.isNull() | in_band
    keep &= (floor.isNull() | (comp_usd() >= floor) | F.col("comp_min").isNull()) & (~disclosed | F.col("comp_min").isNotNull())
    keep &= F.when(kind == "", F.col("field") != "other").otherwise((kind == "all") | (F.col("field") == kind))
    return (F.col("status") == "live") & keep & (~asks("vendors") | has("vendors", F.col("vendor")))


def predicate(f: FeedFilter, as_of: str | Column) -> Column:
    """All row-wise conditions of a filter; ``matching`` adds those that need other tables."""
    keep = F.col("status") == "live"
    if f.countries:
        keep &= F.col("country").isin(*f.countries) | F.col("country").isNull()
    if f.modes:
        keep &= F.col("mode").isin(*f.modes)
    if (bands := yoe_predicate(f.yoe)) is not None:
        keep &= bands
    if f.comp_min is not None:
        enough = comp_usd() >= f.comp_min
        keep &= enough & F.col("comp_min").isNotNull() if f.disclosed_only else enough | F.col("comp_min").isNull()
    elif f.disclosed_only:
        keep &= F.col("comp_min").isNotNull()
    if f.field == "":
        keep &= F.col("field") != "other"
    elif f.field != "all":
        keep &= F.col("field") == f.field
    if f.posted_within_hours:
        keep &= freshness() >= as_of_column(as_of) - F.make_dt_interval(hours=F.lit(f.posted_within_hours))
    if f.posted_after:
        keep &= freshness() > as_of_column(f.posted_after)
    if f.vendors:
        keep &= F.col("vendor").isin(*f.vendors)
    return keep


def with_sources(postings: DataFrame, sources: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with their company's name and their source's vendor and tier.

    Sources and companies grow with the boards; Spark broadcasts them only under its size limit.
    """
    return postings.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "slug"), "company_id").join(
        sources.select(F.col("id").alias("source_id"), "vendor", "tier"), "source_id"
    )


def skill_arrays(posting_skills: DataFrame, id_col: str = "posting_id") -> DataFrame:
    """Per posting the sorted skills by requirement; without must or nice rows the mentioned ones are the nice ones."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("requirement") == kind, F.col("skill"))))
    lists = posting_skills.groupBy(id_col).agg(of("must_have").alias("must"), of("nice_to_have").alias("nice"), of("mentioned").alias("mentioned"))
    return lists.select(id_col, "must", F.when((F.size("must") > 0) | (F.size("nice") > 0), F.col("nice")).otherwise(F.col("mentioned")).alias("nice"))


def with_all_skills(postings: DataFrame, posting_skills: DataFrame, skills: tuple[str, ...] | DataFrame) -> DataFrame:
    """Postings that have every skill of the list: as many distinct hits as list entries, so a repeated entry matches nothing.

    The list may be a frame with a column ``skill``.
    """
    if isinstance(skills, DataFrame):
        every = skills.agg(F.count(F.lit(1)).alias("n"))
        found = posting_skills.join(skills, "skill", "left_semi").groupBy("posting_id").agg(F.countDistinct("skill").alias("n")).join(every, "n")
        return postings.join(found, postings["id"] == found["posting_id"], "left_semi")
    hits = posting_skills.where(F.col("skill").isin(*skills)).groupBy("posting_id").agg(F.countDistinct("skill").alias("n")).where(F.col("n") == len(skills))
    return postings.join(hits, postings["id"] == hits["posting_id"], "left_semi")


def without_dismissed(postings: DataFrame, dismissed: DataFrame, viewer: int) -> DataFrame:
    own = dismissed.where(F.col("user_id") == viewer).select("posting_id")
    return postings.join(own, postings["id"] == own["posting_id"], "left_anti")


def with_saved(postings: DataFrame, applications: DataFrame, viewer: int) -> DataFrame:
    """Postings with ``saved``: whether the viewer has an application for it."""
    own = applications.where((F.col("user_id") == viewer) & F.col("posting_id").isNotNull()).select(F.col("posting_id").alias("saved_id")).distinct()
    return postings.join(own, postings["id"] == own["saved_id"], "left").withColumn("saved", F.col("saved_id").isNotNull()).drop("saved_id")


def matching(rows: DataFrame, f: FeedFilter, as_of: str | Column, *, posting_skills: DataFrame | None = None, dismissed: DataFrame | None = None, viewer: int | None = None, index=None) -> DataFrame:
    """Rows that pass all of a filter but its bands: row-wise conditions, text query (adds ``rank``; through ``index``, a ``TextIndex``, if given), skills, dismissals.

    A condition whose table is not given is an error, never left out. Without a viewer nothing is dismissed.
    """
    out = rows.where(predicate(f, as_of))
    if f.query:
        out = search(out, f.query, index=index)
    if f.skills:
        if posting_skills is None:
            raise FilterError("skills need the table of posting skills")
        out = with_all_skills(out, posting_skills, f.skills)
    if viewer is not None and not f.include_dismissed:
        if dismissed is None:
            raise FilterError("a viewer's feed needs the table of dismissed postings")
        out = without_dismissed(out, dismissed, viewer)
    return out


def needs_ranking(f: FeedFilter) -> bool:
    return f.sort == "match" or bool(f.bands)


def sort_key(name: str, query: str = "") -> Column:
    """Relevance to no query is no order, so it falls back to the newest."""
    return comp_usd() if name == "comp" else F.col("rank") if name == "relevance" and query else freshness()


def encode_cursor(values: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, separators=(",", ":"), default=str).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError:
        raise FilterError("bad cursor") from None


def after(key: Column, key_value: object, id_value: int, kind: str) -> Column:
    """Rows behind a cursor in the order (key desc, id desc)."""
    value = F.lit(key_value).cast(kind)
    return (key < value) | ((key == value) & (F.col("id") < id_value))


def page(rows: DataFrame, f: FeedFilter, as_of: str | Column, *, posting_skills: DataFrame | None = None, dismissed: DataFrame | None = None, viewer: int | None = None, profile=None, index=None) -> DataFrame:
    """One page plus one row, which says that there is more: filter, order, limit.

    Bands and the order by match need the viewer's ``profile`` (see ``scoring.Profile``) and
    the posting skills: they rank the CANDIDATES most recent rows, with an offset as cursor.
    All other pages are keyset pages.
    """
    out = matching(rows, f, as_of, posting_skills=posting_skills, dismissed=dismissed, viewer=viewer, index=index)
    if needs_ranking(f):
        from .scoring import ranked

        if profile is None or posting_skills is None:
            raise FilterError("ranking needs a viewer's profile and the posting skills")
        lists = skill_arrays(posting_skills)
        out = out.join(lists, out["id"] == lists["posting_id"], "left").drop("posting_id")
        return ranked(out, profile, as_of, CANDIDATES, _offset(f), f.limit + 1, f.bands)
    kind = "double" if f.sort == "comp" or (f.sort == "relevance" and f.query) else "timestamp_ntz"
    out = out.withColumn("sort_key", sort_key(f.sort, f.query))
    if f.cursor:
        at = decode_cursor(f.cursor)
        if not {"k", "i"} <= set(at):
            raise FilterError("bad cursor")
        out = out.where(after(F.col("sort_key"), at["k"], at["i"], kind))
    return out.orderBy(F.desc("sort_key"), F.desc("id")).limit(f.limit + 1)


def _offset(f: FeedFilter) -> int:
    offset = decode_cursor(f.cursor).get("o") if f.cursor else 0
    if not isinstance(offset, int) or offset < 0:
        raise FilterError("bad cursor")
    return offset


#: The columns of a feed item that come from the feed's rows, with their kinds; those that the rows lack are null.
ITEM = {
    "id": "long", "title": "string", "company": "string", "slug": "string", "location_raw": "string", "city": "string", "country": "string", "mode": "string", "apply_url": "string", "vendor": "string", "comp_min": "double", "comp_max": "double",
    "comp_currency": "string", "comp_period": "string", "comp_src": "string", "yoe_min": "int", "yoe_max": "int", "yoe_confidence": "double", "posted_at": "timestamp_ntz", "posted_at_is_estimate": "boolean", "first_seen_at": "timestamp_ntz",
    "ai_screening_disclosed": "boolean", "ai_opt_out_url": "string", "parse_confidence": "double", "sort_key": None,
}


def items(rows: DataFrame, posting_skills: DataFrame, applications: DataFrame, viewer: int | None = None) -> DataFrame:
    """The whole feed items of ``rows``, a page or any part of the feed: ITEM, skills for readers and for the score, and ``saved``.

    must_have and nice_to_have are display names in their own order; must_canon and nice_canon are canonical names, where
    the mentioned ones stand for the nice ones if there is neither. Only the skills of these rows are read into lists.
    An unknown place is an empty text, an unknown confidence of years 0.
    """
    shown = rows.select(*((F.col(c) if c in rows.columns else F.lit(None).cast(kind)).alias(c) for c, kind in ITEM.items() if kind or c in rows.columns))
    shown = shown.withColumns({"location_raw": F.coalesce("location_raw", F.lit("")), "yoe_confidence": F.coalesce("yoe_confidence", F.lit(0.0))})
    own = posting_skills.join(shown.select(F.col("id").alias("posting_id")), "posting_id", "left_semi").withColumn("_name", display_name(F.col("skill"), DISPLAY))
    of = lambda kind, c: F.array_sort(F.collect_list(F.when(F.col("requirement") == kind, F.col(c))))
    lists = own.groupBy(F.col("posting_id").alias("id")).agg(of("must_have", "_name").alias("must_have"), of("nice_to_have", "_name").alias("nice_to_have"), of("must_have", "skill").alias("must_canon"), of("nice_to_have", "skill").alias("_nice"), of("mentioned", "skill").alias("_mentioned"))
    lists = lists.withColumn("nice_canon", F.when((F.size("must_canon") > 0) | (F.size("_nice") > 0), F.col("_nice")).otherwise(F.col("_mentioned"))).drop("_nice", "_mentioned")
    none = F.array().cast("array<string>")
    out = shown.join(lists, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("must_have", "nice_to_have", "must_canon", "nice_canon")})
    return with_saved(out, applications, viewer) if viewer is not None else out.withColumn("saved", F.lit(False))


def rehydrate(places: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of a ranked page (id, place) in its order; ids that are gone are dropped."""
    return places.select("id", "place").join(postings, "id").orderBy("place")


@dataclass(frozen=True)
class Page:
    """A collected page: at most ``limit`` rows, and where the next one begins."""

    rows: list = field(default_factory=list)
    cursor: str = ""


def collect_page(rows: DataFrame, f: FeedFilter, as_of: str | Column, **more) -> Page:
    """``more``: the tables, viewer and profile of ``page``."""
    found = page(rows, f, as_of, **more).collect()
    if len(found) <= f.limit:
        return Page(found)
    last = found[f.limit - 1]
    return Page(found[: f.limit], encode_cursor({"o": _offset(f) + f.limit} if needs_ranking(f) else {"k": str(last["sort_key"]), "i": last["id"]}))


def yoe_bucket() -> Column:
    low = F.col("yoe_min")
    return F.when(low.isNull(), "unstated").when(low <= 2, "0-2").when(low <= 5, "3-5").when(low <= 8, "6-8").otherwise("9+")


def facets(rows: DataFrame) -> DataFrame:
    """(kind, value, n) over all live postings in one scan: each row yields its facet values, then one count.

    Pay floors are cumulative over the stated maximum, in its own currency.
    """
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    of_row = [
        pair("mode", F.col("mode")), pair("country", F.coalesce("country", F.lit("unknown"))), pair("vendor", F.col("vendor")), pair("yoe", yoe_bucket()), pair("field", F.col("field")),
        *(F.when(F.col("comp_max") >= floor, pair("comp", F.lit(str(floor)))) for floor in COMP_FLOORS), F.when(F.col("comp_max").isNull(), pair("comp_undisclosed", F.lit("n"))),
    ]
    values = rows.where(F.col("status") == "live").select(F.explode(F.array_compact(F.array(*of_row))).alias("x"))
    return values.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def market_summary(postings: DataFrame, as_of: str | Column) -> DataFrame:
    """One row over live postings: totals, new in seven days, and shares rounded to six digits."""
    live = postings.where(F.col("status") == "live")
    share = lambda cond, name: F.round(F.coalesce(F.avg(cond.cast("int")), F.lit(0.0)), 6).alias(name)
    return live.agg(
        F.count(F.lit(1)).alias("n_live"), F.countDistinct("company_id").alias("n_companies"), F.count_if(F.col("first_seen_at") > as_of_column(as_of) - F.expr("INTERVAL '7' DAY")).alias("n_new"),
        share(F.col("mode") == "remote", "remote_share"), share(F.col("field") == "software", "software_share"), share(F.col("field") == "unknown", "unknown_share"),
    )
