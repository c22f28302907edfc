"""One query for each vendor's feed: payloads laid out from the orders table, and what their postings must be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import raw
from ..sources import vendors

#: What both sides read: key, customer, day and a number of thousands.
BASE = "SELECT o_orderkey AS k, o_custkey AS c, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(o_orderkey % 90 + 10 AS BIGINT) AS n FROM orders"
COLUMNS = ("external_id", "title", "location_raw", "description_html", "posted_at", "posted_at_is_estimate", "comp_min", "comp_max", "comp_currency", "comp_period", "workplace", "employment")
KINDS = {"posted_at": "TIMESTAMP", "posted_at_is_estimate": "BOOLEAN", "comp_min": "DOUBLE", "comp_max": "DOUBLE"}

_TITLE = "CASE WHEN k % 11 = 0 THEN ' ' ELSE concat('Engineer ', CAST(k AS STRING)) END"
_REMOTE = "CASE WHEN k % 3 = 0 THEN 'true' WHEN k % 3 = 1 THEN 'false' ELSE 'null' END"


def _text(*parts: str) -> str:
    """SQL for a text of literals and, in braces, expressions."""
    return "concat(" + ", ".join(f"CAST({p[1:-1]} AS STRING)" if p.startswith("{") and p.endswith("}") and len(p) > 2 and not p.startswith('{"') else "'" + p.replace("'", "''") + "'" for p in parts) + ")"


#: Payload of each list.
LISTS: dict[str, str] = {
    "greenhouse": _text(
        '{"jobs":[{"id":', "{k}", ',"title":"', "{" + _TITLE + "}", '","location":{"name":"City ', "{c % 50}", '"},"content":"', "{CASE WHEN k % 4 = 0 THEN '&amp;lt;p&amp;gt;' ELSE '&lt;p&gt;' END}", "{k}", '","updated_at":"', "{d}",
        'T01:02:03+01:00","first_published":', "{CASE WHEN k % 5 = 0 THEN 'null' ELSE concat('\"', d, 'T12:00:00Z\"') END}", ',"pay_input_ranges":[{"min_cents":', "{n * 100000}", ',"max_cents":', "{n * 200000}",
        ',"currency_type":"EUR"},{"min_cents":', "{n * 90000}", ',"max_cents":1,"currency_type":"EUR"},{"min_cents":1,"max_cents":999999999,"currency_type":"USD"}]}]}',
    ),
    "ashby": _text(
        '{"jobs":[{"id":"a', "{k}", '","title":"', "{" + _TITLE + "}", '","location":"City ', "{c % 50}", '","secondaryLocations":[{"location":"Bergen"},{"location":""}],"isListed":', "{CASE WHEN k % 7 = 0 THEN 'false' ELSE 'true' END}",
        ',"isRemote":', "{" + _REMOTE + "}", ',"employmentType":"', "{CASE WHEN k % 2 = 0 THEN 'FullTime' ELSE 'Intern' END}", '","publishedAt":"', "{d}", 'T00:00:00.000+00:00","descriptionHtml":"<p>', "{c}",
        '</p>","compensation":{"summaryComponents":[{"compensationType":"Equity"}],"compensationTiers":[{"components":[{"compensationType":"Salary","interval":"1 YEAR","currencyCode":"USD","minValue":', "{n}", ',"maxValue":', "{n + 5}",
        '},{"compensationType":"Salary","interval":"1 YEAR","currencyCode":"USD","minValue":', "{n - 5}", '}]}]}}]}',
    ),
    "workday": _text(
        '{"total":3,"jobPostings":[{"title":"', "{" + _TITLE + "}", '","externalPath":"/job/', "{k}", '","locationsText":"City ', "{c % 50}", '","postedOn":"Posted Today","bulletFields":[', "{CASE WHEN k % 2 = 0 THEN concat('\"R', CAST(k AS STRING), '\"') ELSE '' END}", ']}]}',
    ),
    "smartrecruiters": _text(
        '{"content":[{"id":"', "{k}", '","name":"', "{" + _TITLE + "}", '","releasedDate":"', "{d}", 'T06:07:08.000Z","location":{"city":"City ', "{c % 50}", '","region":"","country":"it","remote":', "{" + _REMOTE + "}", ',"hybrid":', "{CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END}",
        '},"typeOfEmployment":{"label":"Full-time"}}]}',
    ),
    "personio": _text(
        "<workzag-jobs><position><id>", "{k}", "</id><name>", "{" + _TITLE + "}", "</name><office>City ", "{c % 50}", "</office><additionalOffices><office>Bonn</office><office>City ", "{c % 50}", "</office></additionalOffices><employmentType>",
        "{CASE WHEN k % 4 = 0 THEN 'intern' ELSE 'permanent' END}", "</employmentType><schedule>", "{CASE WHEN k % 3 = 0 THEN 'part-time' ELSE '' END}", "</schedule><createdAt>", "{d}", "T03:04:05+02:00</createdAt><jobDescriptions><jobDescription><name> Tasks </name><value>do ", "{c}",
        "</value></jobDescription></jobDescriptions></position></workzag-jobs>",
    ),
    "recruitee": _text(
        '{"offers":[{"id":', "{k}", ',"title":"', "{" + _TITLE + "}", '","status":"', "{CASE WHEN k % 7 = 0 THEN 'draft' ELSE 'published' END}", '","description":"d","requirements":"<p>', "{c}", '</p>","city":"City ', "{c % 50}", '","state_name":"","country":"BE","created_at":"', "{d}",
        ' 03:04:05 UTC","published_at":', "{CASE WHEN k % 5 = 0 THEN 'null' ELSE concat('\"', d, ' 09:00:00 UTC\"') END}", ',"hybrid":true,"remote":', "{" + _REMOTE + "}", ',"employment_type_code":"fulltime_permanent","salary":{"min":"', "{n}", '","max":"', "{CASE WHEN k % 2 = 0 THEN 'x' ELSE CAST(n + 1 AS STRING) END}",
        '","period":"', "{CASE WHEN k % 3 = 0 THEN '??' ELSE 'month' END}", '","currency":"EUR"}}]}',
    ),
    "workable": _text(
        '{"jobs":[{"shortcode":"', "{k}", '","title":"', "{" + _TITLE + "}", '","published_on":"', "{d}", '","telecommuting":', "{" + _REMOTE + "}", ',"employment_type":"Contract","city":"Lyon","state":"","country":"France","description":"<p>', "{c}", '</p>","locations":[',
        "{CASE WHEN k % 2 = 0 THEN concat('{\"city\":\"City ', CAST(c % 50 AS STRING), '\"},{\"city\":\"City ', CAST(c % 50 AS STRING), '\"},{\"country\":\"X\"}') ELSE '' END}", ']}]}',
    ),
    "keka": _text(
        '[{"id":', "{k}", ',"title":"', "{" + _TITLE + "}", '","description":"', "{c}", '","skillNames":[', "{CASE WHEN k % 2 = 0 THEN '\"go\",\"sql\"' ELSE '' END}", '],"publishedOn":"', "{d}", 'T08:00:00","jobLocations":[{"name":"HQ"},{"name":"n","city":"City ', "{c % 50}", '","state":"","countryName":"India"}]}]',
    ),
    "bamboohr": _text('{"result":[{"id":"', "{k}", '","jobOpeningName":"', "{" + _TITLE + "}", '","isRemote":', "{" + _REMOTE + "}", ',"employmentType":"Part-Time","location":{"city":"City ', "{c % 50}", '","state":"TX"}}]}'),
}
#: Payload of each detail, for every second posting.
DETAILS: dict[str, str] = {
    "smartrecruiters": _text('{"jobAd":{"sections":{"qualifications":{"title":"Q","text":"q"},"jobDescription":{"title":"J","text":"', "{c}", '"},"other":{"title":"O","text":"o"}}},"applyUrl":"u"}'),
    "bamboohr": _text('{"result":{"jobOpening":{"jobOpeningName":"","description":"<p>', "{c}", '</p>","employmentType":"Intern","datePosted":"', "{d}", '"}}}'),
}

_CITY, _NAMED = "concat('City ', CAST(c % 50 AS STRING))", "CAST(k AS STRING)"
_AT = "CAST(concat(d, ' {}') AS TIMESTAMP)".format
#: What the postings are, in SQL over BASE; columns that are not named are null.
WANTED: dict[str, tuple[dict[str, str], str]] = {
    "greenhouse": ({"location_raw": _CITY, "description_html": "concat('<p>', CAST(k AS STRING))", "posted_at": f"CASE WHEN k % 5 = 0 THEN {_AT('00:02:03')} ELSE {_AT('12:00:00')} END", "posted_at_is_estimate": "k % 5 = 0", "comp_min": "n * 900", "comp_max": "n * 2000", "comp_currency": "'EUR'", "comp_period": "'year'"}, "true"),
    "ashby": ({"external_id": "concat('a', CAST(k AS STRING))", "location_raw": f"concat({_CITY}, ' / Bergen')", "description_html": "concat('<p>', CAST(c AS STRING), '</p>')", "posted_at": _AT("00:00:00"), "posted_at_is_estimate": "false", "comp_min": "n - 5", "comp_max": "n + 5", "comp_currency": "'USD'",
               "comp_period": "'year'", "workplace": "CASE WHEN k % 3 = 0 THEN 'remote' END", "employment": "CASE WHEN k % 2 = 0 THEN 'full_time' ELSE 'intern' END"}, "k % 7 <> 0"),
    "workday": ({"external_id": "CASE WHEN k % 2 = 0 THEN concat('R', CAST(k AS STRING)) ELSE concat('/job/', CAST(k AS STRING)) END", "location_raw": _CITY, "posted_at_is_estimate": "true"}, "true"),
    "smartrecruiters": ({"location_raw": f"concat({_CITY}, ', it')", "description_html": "CASE WHEN k % 2 = 0 THEN concat('<h2>J</h2>', CAST(c AS STRING), '<h2>Q</h2>q') ELSE '' END", "posted_at": _AT("06:07:08"), "posted_at_is_estimate": "false",
                         "workplace": "CASE WHEN k % 3 = 0 THEN 'remote' WHEN k % 2 = 0 THEN 'hybrid' END", "employment": "'full_time'"}, "true"),
    "personio": ({"location_raw": f"concat({_CITY}, ' · Bonn')", "description_html": "concat('<h2>Tasks</h2>do ', CAST(c AS STRING))", "posted_at": _AT("01:04:05"), "posted_at_is_estimate": "false",
                  "employment": "CASE WHEN k % 4 = 0 THEN 'intern' WHEN k % 3 = 0 THEN 'part_time' ELSE 'full_time' END"}, "true"),
    "recruitee": ({"location_raw": f"concat({_CITY}, ', BE')", "description_html": "concat('d<p>', CAST(c AS STRING), '</p>')", "posted_at": f"CASE WHEN k % 5 = 0 THEN {_AT('03:04:05')} ELSE {_AT('09:00:00')} END", "posted_at_is_estimate": "k % 5 = 0", "comp_min": "CASE WHEN k % 3 <> 0 THEN n END",
                   "comp_max": "CASE WHEN k % 3 <> 0 AND k % 2 <> 0 THEN n + 1 END", "comp_currency": "CASE WHEN k % 3 <> 0 THEN 'EUR' END", "comp_period": "CASE WHEN k % 3 <> 0 THEN 'month' END", "workplace": "CASE WHEN k % 3 = 0 THEN 'remote' ELSE 'hybrid' END", "employment": "'full_time'"}, "k % 7 <> 0"),
    "workable": ({"location_raw": f"CASE WHEN k % 2 = 0 THEN concat({_CITY}, ' / X') ELSE 'Lyon, France' END", "description_html": "concat('<p>', CAST(c AS STRING), '</p>')", "posted_at": _AT("00:00:00"), "posted_at_is_estimate": "true", "workplace": "CASE WHEN k % 3 = 0 THEN 'remote' END", "employment": "'contract'"}, "true"),
    "keka": ({"location_raw": f"concat('HQ / ', {_CITY}, ', India')", "description_html": "concat(CAST(c AS STRING), CASE WHEN k % 2 = 0 THEN '<h2>Skills</h2><ul><li>go</li><li>sql</li></ul>' ELSE '' END)", "posted_at": _AT("08:00:00"), "posted_at_is_estimate": "false"}, "true"),
    "bamboohr": ({"location_raw": f"concat({_CITY}, ', TX')", "description_html": "CASE WHEN k % 2 = 0 THEN concat('<p>', CAST(c AS STRING), '</p>') END", "posted_at": f"CASE WHEN k % 2 = 0 THEN {_AT('00:00:00')} END", "posted_at_is_estimate": "true", "workplace": "CASE WHEN k % 3 = 0 THEN 'remote' END",
                  "employment": "CASE WHEN k % 2 = 0 THEN 'intern' ELSE 'part_time' END"}, "true"),
}


def _source(vendor: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = spark.sql(BASE.replace("FROM orders", "FROM {orders}"), orders=raw(spark, sf_dir, "orders"))
        lists = base.select(F.col("k").alias("source_id"), F.lit(0).alias("page"), F.expr(LISTS[vendor]).alias("body"))
        if vendor in DETAILS:
            details = base.where("k % 2 = 0").select(F.col("k").alias("source_id"), F.col("k").cast("string").alias("id"), F.expr(DETAILS[vendor]).alias("body"))
            return getattr(vendors, vendor)(lists, details).select("source_id", *COLUMNS)
        return getattr(vendors, vendor)(lists).select("source_id", *COLUMNS)

    return run


def _sql(vendor: str) -> str:
    values, where = WANTED[vendor]
    values = {"external_id": _NAMED, "title": _TITLE} | values
    listed = ", ".join(f"CAST({values.get(c, 'NULL')} AS {KINDS.get(c, 'STRING')}) AS {c}" for c in COLUMNS)
    return f"WITH base AS ({BASE}) SELECT k AS source_id, {listed} FROM base WHERE k % 11 <> 0 AND {where}"


SOURCES = {f"source_{vendor}": _source(vendor) for vendor in LISTS}
SOURCE_SQL = {f"source_{vendor}": _sql(vendor) for vendor in LISTS}
