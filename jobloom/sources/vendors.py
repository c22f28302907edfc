"""Vendor feeds to raw postings: fixed schemas, one ``select`` per vendor.

Input frames have (source_id, body), the payload of one poll; the output is one row per
posting that has an id and a title. What a vendor does not say is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import employment, first_filled, pay_period, strip_html

FIELDS = {
    "external_id": "string", "requisition_id": "string", "title": "string", "location_raw": "string", "description_html": "string", "apply_url": "string", "posting_url": "string", "department": "string",
    "posted_at": "timestamp_ntz", "posted_at_is_estimate": "boolean", "comp_min": "double", "comp_max": "double", "comp_currency": "string", "comp_period": "string", "workplace": "string",
    "employment": "string", "office": "string", "raw": "string",
}


def _postings(rows: DataFrame, **values: Column) -> DataFrame:
    """The common columns, missing ones as nulls; rows without id or title are dropped."""
    out = rows.select("source_id", *(values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()))
    return out.where((F.coalesce("external_id", F.lit("")) != "") & (F.btrim(F.coalesce("title", F.lit(""))) != ""))


def _each(feeds: DataFrame, schema: str, path: str) -> DataFrame:
    """(source_id, j): one row per element of the array at ``path``."""
    parsed = feeds.select("source_id", F.from_json("body", schema).alias("x"))
    return parsed.select("source_id", F.explode(path).alias("j"))


def _time(x: Column) -> Column:
    """The first of the layouts that fits, as UTC."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(layout)) for layout in layouts)).cast("timestamp_ntz")


def _unescape_once(x: Column) -> Column:
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(to))
    return x


def greenhouse(feeds: DataFrame) -> DataFrame:
    """Pay ranges are cents; only those in the first range's currency count. A body that is still escaped is unescaped again."""
    schema = """jobs array<struct<id:string,title:string,requisition_id:string,updated_at:string,first_published:string,absolute_url:string,content:string,location:struct<name:string>,
      departments:array<struct<name:string>>,offices:array<struct<name:string,location:string>>,pay_input_ranges:array<struct<min_cents:double,max_cents:double,currency_type:string>>>>"""
    j = F.col("j")
    once = _unescape_once(j["content"])
    body = F.when(once.rlike("&lt;/?[a-z]"), _unescape_once(once)).otherwise(once)
    currency = F.get(j["pay_input_ranges"], F.lit(0))["currency_type"]
    ranges = F.filter(j["pay_input_ranges"], lambda r: r["currency_type"] == currency)
    low, high = F.array_min(F.transform(ranges, lambda r: r["min_cents"])) / 100, F.array_max(F.transform(ranges, lambda r: r["max_cents"])) / 100
    paid = low.isNotNull() | high.isNotNull()
    return _postings(
        _each(feeds, schema, "x.jobs"), external_id=j["id"], requisition_id=j["requisition_id"], title=j["title"], location_raw=j["location"]["name"], description_html=body, apply_url=j["absolute_url"],
        posting_url=j["absolute_url"], department=F.get(j["departments"], F.lit(0))["name"], office=first_filled(F.get(j["offices"], F.lit(0))["location"], F.get(j["offices"], F.lit(0))["name"]), posted_at=F.coalesce(_time(j["first_published"]), _time(j["updated_at"])),
        posted_at_is_estimate=_time(j["first_published"]).isNull(), comp_min=low, comp_max=high, comp_currency=F.when(paid, currency), comp_period=F.when(paid, "year"), raw=F.to_json(j),
    )


def ashby(feeds: DataFrame) -> DataFrame:
    """Unlisted jobs are left out; salary components of the first currency are merged, from the summary or else the tiers."""
    part = "array<struct<compensationType:string,interval:string,currencyCode:string,minValue:double,maxValue:double>>"
    schema = f"""jobs array<struct<id:string,title:string,location:string,department:string,employmentType:string,isListed:boolean,isRemote:boolean,publishedAt:string,jobUrl:string,applyUrl:string,
      descriptionHtml:string,compensation:struct<summaryComponents:{part},compensationTiers:array<struct<components:{part}>>>,secondaryLocations:array<struct<location:string>>>>"""
    j = F.col("j")
    salary = lambda x: F.filter(x, lambda c: c["compensationType"] == "Salary")
    summary = salary(j["compensation"]["summaryComponents"])
    tiers = salary(F.flatten(F.transform(j["compensation"]["compensationTiers"], lambda t: t["components"])))
    parts = F.when(F.size(summary) > 0, summary).otherwise(tiers)
    first = F.get(parts, F.lit(0))
    same = F.filter(parts, lambda c: c["currencyCode"] == first["currencyCode"])
    places = F.concat(F.array(j["location"]), F.coalesce(F.transform(j["secondaryLocations"], lambda s: s["location"]), F.array()))
    return _postings(
        _each(feeds, schema, "x.jobs").where(F.coalesce(F.col("j.isListed"), F.lit(True))), external_id=j["id"], title=j["title"], location_raw=F.array_join(F.filter(places, lambda p: F.coalesce(p, F.lit("")) != ""), " / "),
        description_html=j["descriptionHtml"], apply_url=first_filled(j["applyUrl"], j["jobUrl"]), posting_url=j["jobUrl"], department=j["department"], posted_at=_time(j["publishedAt"]), posted_at_is_estimate=F.lit(False),
        comp_min=F.array_min(F.transform(same, lambda c: c["minValue"])), comp_max=F.array_max(F.transform(same, lambda c: c["maxValue"])), comp_currency=first["currencyCode"], comp_period=F.nullif(pay_period(first["interval"]), F.lit("")),
        workplace=F.when(j["isRemote"], "remote"), employment=F.nullif(employment(j["employmentType"]), F.lit("")), raw=F.to_json(j),
    )


def workday(pages: DataFrame) -> DataFrame:
    """List pages in the order of ``page``; of a posting that comes again the last page's row stays. Dates are words and not read."""
    schema = "total int, jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>"
    parsed = pages.select("source_id", "page", F.from_json("body", schema).alias("x")).select("source_id", "page", F.posexplode("x.jobPostings").alias("place", "j"))
    key = F.coalesce(F.get("j.bulletFields", F.lit(0)), F.col("j.externalPath"))
    last = parsed.groupBy("source_id", key.alias("key")).agg(F.max_by("j", F.struct("page", "place")).alias("j"))
    j = F.col("j")
    return _postings(last, external_id=F.col("key"), requisition_id=F.get(j["bulletFields"], F.lit(0)), title=j["title"], location_raw=j["locationsText"], posting_url=j["externalPath"], apply_url=j["externalPath"], posted_at_is_estimate=F.lit(True), raw=F.to_json(j))


def workday_is_truncated(pages: DataFrame, cap: int = 2000) -> DataFrame:
    """(source_id, truncated): a facet's values sum to more than the total, or the total reaches the cap."""
    schema = "total int, facets array<struct<facetParameter:string,values:array<struct<id:string,count:int>>>>"
    x = pages.where("page = 0").select("source_id", F.from_json("body", schema).alias("x"))
    sums = F.transform("x.facets", lambda f: F.aggregate(f["values"], F.lit(0), lambda a, v: a + F.coalesce(v["count"], F.lit(0))))
    return x.select("source_id", ((F.col("x.total") >= cap) | (F.coalesce(F.array_max(sums), F.lit(0)) > F.col("x.total"))).alias("truncated"))


def smartrecruiters(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Lists joined with the details (source_id, id, body) that were fetched; sections come in a fixed order."""
    schema = """content array<struct<id:string,name:string,refNumber:string,releasedDate:string,location:struct<city:string,region:string,country:string,remote:boolean,hybrid:boolean,fullLocation:string>,
      department:struct<label:string>,typeOfEmployment:struct<label:string>>>"""
    section = "struct<title:string,text:string>"
    detail = details.select(F.col("source_id").alias("d_source"), F.col("id").alias("d_id"), F.from_json("body", f"jobAd struct<sections:map<string,{section}>>, applyUrl string, postingUrl string").alias("d"))
    rows = _each(lists, schema, "x.content").join(detail, (F.col("source_id") == F.col("d_source")) & (F.col("j.id") == F.col("d_id")), "left")
    j, d, place = F.col("j"), F.col("d"), F.col("j.location")
    order = ("companyDescription", "jobDescription", "qualifications", "additionalInformation")
    html = lambda name: F.when(F.coalesce(d["jobAd"]["sections"][name]["text"], F.lit("")) != "", F.concat(F.lit("<h2>"), F.coalesce(d["jobAd"]["sections"][name]["title"], F.lit("")), F.lit("</h2>"), d["jobAd"]["sections"][name]["text"]))
    where = first_filled(place["fullLocation"], F.concat_ws(", ", *(F.nullif(place[x], F.lit("")) for x in ("city", "region", "country"))))
    return _postings(
        rows, external_id=j["id"], requisition_id=j["refNumber"], title=j["name"], location_raw=where, description_html=F.concat_ws("", *map(html, order)), apply_url=d["applyUrl"], posting_url=d["postingUrl"],
        department=j["department"]["label"], posted_at=_time(j["releasedDate"]), posted_at_is_estimate=F.lit(False), workplace=F.when(place["remote"], "remote").when(place["hybrid"], "hybrid"),
        employment=F.nullif(employment(j["typeOfEmployment"]["label"]), F.lit("")), raw=F.to_json(j),
    )


def personio(feeds: DataFrame) -> DataFrame:
    """XML; offices joined once each, sections under their headings; raw is JSON all the same."""
    schema = """position array<struct<id:string,name:string,office:string,additionalOffices:struct<office:array<string>>,department:string,employmentType:string,schedule:string,createdAt:string,
      jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>"""
    rows = feeds.select("source_id", F.from_xml("body", schema).alias("x")).select("source_id", F.explode("x.position").alias("j"))
    j = F.col("j")
    offices = F.array_distinct(F.concat(F.array(j["office"]), F.coalesce(j["additionalOffices"]["office"], F.array())))
    sections = F.transform(j["jobDescriptions"]["jobDescription"], lambda s: F.concat(F.lit("<h2>"), F.btrim(F.coalesce(s["name"], F.lit(""))), F.lit("</h2>"), F.coalesce(s["value"], F.lit(""))))
    kind = first_filled(F.when(F.lower(j["employmentType"]).contains("intern"), "intern"), employment(j["schedule"]), employment(j["employmentType"]))
    return _postings(rows, external_id=j["id"], title=j["name"], office=F.btrim(j["office"]), location_raw=F.array_join(F.filter(offices, lambda o: F.coalesce(o, F.lit("")) != ""), " · "), description_html=F.array_join(sections, ""), department=j["department"], posted_at=_time(j["createdAt"]), posted_at_is_estimate=F.lit(False), employment=kind, raw=F.to_json(j))


def recruitee(feeds: DataFrame) -> DataFrame:
    """Published offers; pay counts only with a known period."""
    schema = """offers array<struct<id:string,title:string,status:string,description:string,requirements:string,careers_url:string,careers_apply_url:string,created_at:string,published_at:string,city:string,state_name:string,
      country:string,department:string,employment_type_code:string,remote:boolean,hybrid:boolean,on_site:boolean,salary:struct<min:string,max:string,period:string,currency:string>>>"""
    rows = _each(feeds, schema, "x.offers").where(F.coalesce("j.status", F.lit("")).isin("", "published"))
    j = F.col("j")
    period = pay_period(j["salary"]["period"])
    pay = lambda x: F.when(period != "", x)
    return _postings(
        rows, external_id=j["id"], title=j["title"], office=F.btrim(j["city"]), location_raw=F.concat_ws(", ", *(F.nullif(j[c], F.lit("")) for c in ("city", "state_name", "country"))), description_html=F.concat_ws("", j["description"], j["requirements"]),
        apply_url=first_filled(j["careers_apply_url"], j["careers_url"]), posting_url=j["careers_url"], department=j["department"], posted_at=F.coalesce(_time(j["published_at"]), _time(j["created_at"])),
        posted_at_is_estimate=_time(j["published_at"]).isNull(), comp_min=pay(j["salary"]["min"].try_cast("double")), comp_max=pay(j["salary"]["max"].try_cast("double")), comp_currency=pay(j["salary"]["currency"]),
        comp_period=pay(period), workplace=F.when(j["remote"], "remote").when(j["hybrid"], "hybrid").when(j["on_site"], "onsite"), employment=F.nullif(employment(j["employment_type_code"]), F.lit("")), raw=F.to_json(j),
    )


def workable(feeds: DataFrame) -> DataFrame:
    """Dates without a time are estimates."""
    schema = """jobs array<struct<shortcode:string,code:string,title:string,department:string,employment_type:string,telecommuting:boolean,published_on:string,created_at:string,country:string,city:string,state:string,description:string,
      locations:array<struct<country:string,city:string,region:string>>,url:string,shortlink:string,application_url:string>>"""
    j = F.col("j")
    many = F.array_distinct(F.transform(j["locations"], lambda p: F.concat_ws(", ", *(F.nullif(p[c], F.lit("")) for c in ("city", "region", "country")))))
    own = F.concat_ws(", ", *(F.nullif(j[c], F.lit("")) for c in ("city", "state", "country")))
    return _postings(
        _each(feeds, schema, "x.jobs"), external_id=j["shortcode"], requisition_id=j["code"], title=j["title"], office=F.btrim(j["city"]), location_raw=F.when(F.size(many) > 0, F.array_join(many, " / ")).otherwise(own), description_html=j["description"],
        apply_url=first_filled(j["application_url"], j["url"]), posting_url=first_filled(j["url"], j["shortlink"]), department=j["department"], posted_at=F.coalesce(_time(j["published_on"]), _time(j["created_at"])),
        posted_at_is_estimate=F.lit(True), workplace=F.when(j["telecommuting"], "remote"), employment=F.nullif(employment(j["employment_type"]), F.lit("")), raw=F.to_json(j),
    )


def keka(feeds: DataFrame) -> DataFrame:
    """A list at the top; named skills become a section of the body. Kind and pay are not mapped."""
    schema = "array<struct<id:string,title:string,description:string,skillNames:array<string>,departmentName:string,jobNumber:string,publishedOn:string,jobLocations:array<struct<name:string,city:string,state:string,countryName:string>>>>"
    rows = feeds.select("source_id", F.explode(F.from_json("body", schema)).alias("j"))
    j = F.col("j")
    skills = F.when(F.size(j["skillNames"]) > 0, F.concat(F.lit("<h2>Skills</h2><ul><li>"), F.array_join(j["skillNames"], "</li><li>"), F.lit("</li></ul>"))).otherwise("")
    places = F.transform(j["jobLocations"], lambda p: F.coalesce(F.nullif(F.concat_ws(", ", *(F.nullif(p[c], F.lit("")) for c in ("city", "state", "countryName"))), F.lit("")), p["name"]))
    return _postings(rows, external_id=j["id"], requisition_id=j["jobNumber"], title=j["title"], office=F.get(F.filter(F.transform(j["jobLocations"], lambda p: F.btrim(p["city"])), lambda c: F.coalesce(c, F.lit("")) != ""), F.lit(0)), location_raw=F.array_join(F.array_distinct(places), " / "), description_html=F.concat(F.coalesce(j["description"], F.lit("")), skills), department=j["departmentName"], posted_at=_time(j["publishedOn"]), posted_at_is_estimate=F.lit(False), raw=F.to_json(j))


def bamboohr(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Lists joined with details (source_id, id, body); what a detail says counts more where it is filled."""
    fields = "jobOpeningName:string,departmentLabel:string,employmentType:string,location:struct<city:string,state:string,addressCountry:string>"
    rows = _each(lists, f"result array<struct<id:string,isRemote:boolean,{fields}>>", "x.result")
    detail = details.select(F.col("source_id").alias("d_source"), F.col("id").alias("d_id"), F.from_json("body", f"result struct<jobOpening:struct<jobOpeningShareUrl:string,description:string,datePosted:string,{fields}>>").alias("x"))
    both = rows.join(detail.select("d_source", "d_id", F.col("x.result.jobOpening").alias("d")), (F.col("source_id") == F.col("d_source")) & (F.col("j.id") == F.col("d_id")), "left")
    j, d = F.col("j"), F.col("d")
    where = lambda x: F.concat_ws(", ", *(F.nullif(x["location"][c], F.lit("")) for c in ("city", "state", "addressCountry")))
    best = lambda c: first_filled(d[c], j[c])
    return _postings(
        both, external_id=j["id"], title=best("jobOpeningName"), location_raw=first_filled(where(d), where(j)), description_html=d["description"], apply_url=d["jobOpeningShareUrl"], posting_url=d["jobOpeningShareUrl"],
        department=best("departmentLabel"), posted_at=_time(d["datePosted"]), posted_at_is_estimate=F.lit(True), workplace=F.when(j["isRemote"], "remote"), employment=F.nullif(employment(best("employmentType")), F.lit("")), raw=F.to_json(j),
    )


FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": greenhouse, "ashby": ashby, "personio": personio, "recruitee": recruitee, "workable": workable, "keka": keka}


def replay(spark, folder: str) -> DataFrame:
    """(path, body): payloads kept as files, one row each; nothing is fetched."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


# Hosts (a whole name, an ending or a part), and the payloads of lists and details; a mark in the path tells a detail.
ROUTES = (
    ("is", "boards-api.greenhouse.io", "greenhouse", "board-full.json", "after:/jobs/", "detail-pay-ranges.json"),
    ("is", "api.ashbyhq.com", "ashby", "board-full.json", "", ""),
    ("is", "api.smartrecruiters.com", "smartrecruiters", "list.json", "after:/postings/", "detail.json"),
    ("ends", ".recruitee.com", "recruitee", "board-full.json", "", ""),
    ("is", "apply.workable.com", "workable", "board-full.json", "", ""),
    ("has", ".myworkdayjobs.com", "workday", "board-full.json", "not ends:/jobs", "detail.json"),
    ("ends", ".jobs.personio.de", "personio", "board-full.xml", "", ""),
    ("ends", ".keka.com", "keka", "board-full.json", "", ""),
    ("ends", ".bamboohr.com", "bamboohr", "board-full.json", "ends:/detail", "detail-35.json"),
)


def routed(url: Column) -> Column:
    """Struct (vendor, payload): the kept payload that answers a request; null for a host that none answers."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    out = F.lit(None).cast("struct<vendor:string,payload:string>")
    for how, name, vendor, board, mark, detail in reversed(ROUTES):
        meets = host == name if how == "is" else host.endswith(name) if how == "ends" else F.contains(host, F.lit(name))
        kind, _, part = mark.partition(":")
        behind = F.contains(path, F.lit(part)) & (F.char_length(path) > F.locate(part, path) + len(part) - 1)
        is_detail = {"after": behind, "ends": path.endswith(part), "not ends": ~path.endswith(part), "": F.lit(False)}[kind]
        out = F.when(meets, F.struct(F.lit(vendor).alias("vendor"), F.when(is_detail, detail).otherwise(board).alias("payload"))).otherwise(out)
    return out


def replayed(requests: DataFrame, payloads: DataFrame) -> DataFrame:
    """``requests`` (url, etag, ...) with vendor, payload, status, new_etag and body, answered from ``payloads`` (vendor, payload, body).

    A payload's validator is a hash of it; a request that names it is answered 304 without a body. Nothing is fetched: a
    host without a route, or a route whose payload is not kept, is an error of the whole query.
    """
    kept = payloads.select(F.col("vendor").alias("_vendor"), F.col("payload").alias("_payload"), "body", F.sha2(F.coalesce("body", F.lit("")), 256).alias("new_etag"))
    asked = requests.withColumn("_to", routed(F.col("url")))
    joined = asked.join(kept, (F.col("_to.vendor") == F.col("_vendor")) & (F.col("_to.payload") == F.col("_payload")), "left")
    lost = F.raise_error(F.concat(F.lit("no kept payload answers "), F.coalesce("url", F.lit("a request without an address"))))
    # A filter, so that it is asked whatever columns are read.
    joined = joined.where(F.when(F.col("new_etag").isNull(), lost.cast("boolean")).otherwise(True))
    tag = F.col("new_etag")
    same = F.coalesce(F.col("etag") == tag, F.lit(False))
    return joined.select(*requests.columns, F.col("_to.vendor").alias("vendor"), F.col("_to.payload").alias("payload"), F.when(same, 304).otherwise(200).alias("status"), tag, F.when(~same, F.col("body")).alias("body"))


def assemble(raw: DataFrame) -> DataFrame:
    """Raw postings with text, title, place, mode, years, pay, skills, field and parse confidence."""
    from ..functions import extract, text

    rows = raw.withColumn("description_text", strip_html(F.coalesce("description_html", F.lit(""))))
    rows = extract.with_skills(extract.with_offices(extract.with_locations(extract.with_titles(rows))))
    rows = rows.withColumn("_y", text.years_of_experience(F.col("description_text"), F.col("seniority"))).withColumn("_c", text.compensation(F.col("description_text")))
    rows = rows.withColumn("mode", text.work_mode(F.col("workplace"), F.col("location_raw"), F.col("description_text")))
    stated = F.col("comp_min").isNotNull() | F.col("comp_max").isNotNull()
    pay = {f"comp_{k}": F.when(stated, F.col(f"comp_{k}")).otherwise(F.col(f"_c.{k}")) for k in ("min", "max", "currency", "period")}
    n = F.size("skills")
    rows = rows.withColumns({**pay, "comp_src": F.when(stated, "structured").when(F.col("_c").isNotNull(), "parsed_text"), "yoe_min": F.col("_y.min"), "yoe_max": F.col("_y.max"), "yoe_confidence": F.col("_y.confidence")})
    rows = rows.withColumn("_f", text.classify_field(F.col("title"), n))
    rows = rows.withColumn("parse_confidence", text.parse_confidence(F.col("title"), F.col("description_text"), F.col("country"), F.col("mode"), F.col("yoe_confidence"), n))
    return rows.withColumns({"field": F.col("_f.field"), "field_confidence": F.col("_f.confidence"), "field_because": F.col("_f.because")}).drop("_y", "_c", "_f")
