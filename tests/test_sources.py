from __future__ import annotations

import json

from jobloom.sources import vendors

JOB = {"id": 7, "title": "Backend Engineer", "location": {"name": "Berlin"}, "content": "&lt;p&gt;3-5 years&lt;/p&gt;", "updated_at": "2026-01-02T03:04:05+01:00", "first_published": None, "absolute_url": "https://x/7",
       "pay_input_ranges": [{"min_cents": 10000000, "max_cents": 12000000, "currency_type": "EUR"}, {"min_cents": 9000000, "max_cents": 15000000, "currency_type": "EUR"}, {"min_cents": 1, "max_cents": 2, "currency_type": "USD"}]}


def feeds(spark, *bodies):
    return spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "source_id long, body string")


def test_greenhouse(spark):
    twice = {**JOB, "id": 8, "content": "&amp;lt;p&amp;gt;x&amp;lt;/p&amp;gt;"}
    rows = {r.external_id: r for r in vendors.greenhouse(feeds(spark, {"jobs": [JOB, twice, {"id": 9, "title": " "}, {"title": "no id"}]}, {"jobs": []}, "not json")).collect()}
    assert set(rows) == {"7", "8"}
    r = rows["7"]
    assert (r.description_html, r.comp_min, r.comp_max, r.comp_currency, r.comp_period, r.posted_at_is_estimate, r.location_raw) == ("<p>3-5 years</p>", 90000, 150000, "EUR", "year", True, "Berlin")
    assert str(r.posted_at) == "2026-01-02 02:04:05" and rows["8"].description_html == "<p>x</p>"


def test_ashby(spark):
    salary = lambda lo, hi, c="USD": {"compensationType": "Salary", "interval": "1 YEAR", "currencyCode": c, "minValue": lo, "maxValue": hi}
    jobs = [
        {"id": "a", "title": "T", "location": "Oslo", "secondaryLocations": [{"location": "Bergen"}], "isListed": True, "isRemote": True, "employmentType": "FullTime", "publishedAt": "2026-01-02T00:00:00.000+00:00", "compensation": {"summaryComponents": [salary(10, 20), salary(5, 30), salary(1, 99, "EUR"), {"compensationType": "Equity"}]}},
        {"id": "b", "title": "Hidden", "isListed": False}, {"id": "c", "title": "Tiers", "compensation": {"summaryComponents": [], "compensationTiers": [{"components": [salary(3, 4)]}]}},
    ]
    rows = {r.external_id: r for r in vendors.ashby(feeds(spark, {"jobs": jobs})).collect()}
    assert set(rows) == {"a", "c"}
    a = rows["a"]
    assert (a.location_raw, a.comp_min, a.comp_max, a.comp_currency, a.comp_period, a.workplace, a.employment) == ("Oslo / Bergen", 5, 30, "USD", "year", "remote", "full_time") and rows["c"].comp_max == 4


def test_workday_pages(spark):
    page = lambda n, *titles: (1, n, json.dumps({"total": 3, "jobPostings": [{"title": t, "externalPath": f"/{k}", "locationsText": "X", "bulletFields": [k]} for k, t in titles], "facets": [{"facetParameter": "f", "values": [{"id": "1", "count": 5}]}]}))
    pages = spark.createDataFrame([page(0, ("R1", "old"), ("R2", "b")), page(1, ("R1", "new"))], "source_id long, page int, body string")
    assert {(r.external_id, r.title) for r in vendors.workday(pages).collect()} == {("R1", "new"), ("R2", "b")}
    assert [r.truncated for r in vendors.workday_is_truncated(pages).collect()] == [True]


def test_lists_with_details(spark):
    lists = feeds(spark, {"content": [{"id": "1", "name": "Cook", "location": {"city": "Rome", "country": "it", "remote": False, "hybrid": True}, "releasedDate": "2026-01-02T00:00:00.000Z"}, {"id": "2", "name": "Clerk"}]})
    details = spark.createDataFrame([(0, "1", json.dumps({"jobAd": {"sections": {"qualifications": {"title": "Q", "text": "q"}, "jobDescription": {"title": "J", "text": "j"}}}, "applyUrl": "u"}))], "source_id long, id string, body string")
    rows = {r.external_id: r for r in vendors.smartrecruiters(lists, details).collect()}
    assert rows["1"].description_html == "<h2>J</h2>j<h2>Q</h2>q" and rows["1"].workplace == "hybrid" and rows["1"].location_raw == "Rome, it" and rows["2"].description_html == ""
    hr = feeds(spark, {"result": [{"id": "35", "jobOpeningName": "Baker", "isRemote": None, "location": {"city": "Graz"}}]})
    more = spark.createDataFrame([(0, "35", json.dumps({"result": {"jobOpening": {"jobOpeningName": "", "description": "d", "datePosted": "2026-02-01"}}}))], "source_id long, id string, body string")
    r = vendors.bamboohr(hr, more).first()
    assert (r.title, r.description_html, r.location_raw, str(r.posted_at)) == ("Baker", "d", "Graz", "2026-02-01 00:00:00")


def test_personio_recruitee_workable_keka(spark):
    xml = "<workzag-jobs><position><id>5</id><name>Dev</name><office>Köln</office><additionalOffices><office>Bonn</office><office>Köln</office></additionalOffices><schedule>full-time</schedule><createdAt>2026-01-02T03:04:05+00:00</createdAt><jobDescriptions><jobDescription><name> Tasks </name><value>do</value></jobDescription></jobDescriptions></position></workzag-jobs>"
    r = vendors.personio(feeds(spark, xml)).first()
    assert (r.external_id, r.location_raw, r.description_html, r.employment) == ("5", "Köln · Bonn", "<h2>Tasks</h2>do", "full_time") and json.loads(r.raw)["name"] == "Dev"
    offers = [{"id": 1, "title": "A", "status": "published", "city": "Ghent", "published_at": "2026-01-02 03:04:05 UTC", "salary": {"min": "10", "max": "x", "period": "month", "currency": "EUR"}}, {"id": 2, "title": "B", "status": "draft"}, {"id": 3, "title": "C", "salary": {"min": "1", "period": "??"}}]
    rows = {r.external_id: r for r in vendors.recruitee(feeds(spark, {"offers": offers})).collect()}
    assert set(rows) == {"1", "3"} and (rows["1"].comp_min, rows["1"].comp_max, rows["1"].comp_period) == (10, None, "month") and rows["3"].comp_min is None
    r = vendors.workable(feeds(spark, {"jobs": [{"shortcode": "S", "title": "T", "published_on": "2026-01-02", "telecommuting": True, "locations": [{"city": "Lyon"}, {"city": "Lyon"}]}]})).first()
    assert (r.posted_at_is_estimate, r.workplace, r.location_raw) == (True, "remote", "Lyon")
    r = vendors.keka(feeds(spark, [{"id": 4, "title": "T", "description": "d", "skillNames": ["go", "sql"], "jobLocations": [{"name": "HQ"}]}])).first()
    assert r.description_html == "d<h2>Skills</h2><ul><li>go</li><li>sql</li></ul>" and r.location_raw == "HQ"


def test_assemble(spark):
    r = vendors.assemble(vendors.greenhouse(feeds(spark, {"jobs": [JOB]}))).first()
    assert (r.title_normalised, r.country, r.city, r.yoe_min, r.comp_src, r.field) == ("backend engineer", "DE", "Berlin", 3, "structured", "software")


def test_office_says_where_a_location_does_not(spark):
    offers = [{"id": i, "title": "T", "city": city, "state_name": state} for i, (city, state) in enumerate((("Berlin", ""), ("Austin", "TX"), ("Nowhere", ""), (" ", "")))]
    raw = vendors.recruitee(feeds(spark, {"offers": offers}))
    assert {(r.external_id, r.office) for r in raw.collect()} == {("0", "Berlin"), ("1", "Austin"), ("2", "Nowhere"), ("3", "")}
    from pyspark.sql import functions as F

    hybrid = raw.withColumn("location_raw", F.when(F.col("external_id") == "1", "Paris, TX").otherwise("Hybrid"))
    got = {r.external_id: (r.location_raw, r.country, r.city) for r in vendors.assemble(hybrid).collect()}
    assert got == {"0": ("Hybrid", "DE", "Berlin"), "1": ("Paris, TX", "US", "Paris"), "2": ("Hybrid", "", ""), "3": ("Hybrid", "", "")}
