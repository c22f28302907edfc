from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from jobloom.functions import extract, search, text
from jobloom.functions.similarity import similarity


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>5+ years</p><li>Go</li>", "5+ years\nGo"), ("a&amp;lt;b", "a&lt;b"), ("x<br/>y<br>z", "x\ny\nz"), ("<div>a</div>\n\n\n\n<div>b</div>", "a\n\nb"), ("&nbsp; a &mdash; b ", "a - b"), ("", ""), (None, None),
    ],
)
def test_strip_html(spark, html, want):
    assert one(spark, text.strip_html(F.col("h").cast("string")), h=html) == want


@pytest.mark.parametrize(
    "body,rank,want",
    [
        ("3-5 years of Go", "", (3, 5, 0.9)), ("5+ yrs", "", (5, None, 0.9)), ("at least 4 years", "", (4, None, 0.9)), ("20-3 years", "", (None, None, 0.0)), ("2 years of relevant experience", "", (2, None, 0.9)),
        ("35+ years", "senior", (5, 10, 0.5)), ("nothing", "", (None, None, 0.0)), (None, "lead", (7, 12, 0.5)), ("20-3 years, 6+ years", "", (6, None, 0.9)),
    ],
)
def test_years(spark, body, rank, want):
    got = one(spark, text.years_of_experience(F.col("t").cast("string"), F.col("s")), t=body, s=rank)
    assert (got["min"], got["max"], got["confidence"]) == want


@pytest.mark.parametrize(
    "flag,body,want",
    [
        ("remote", "3 days in the office", "hybrid"), ("remote", "on-site only", "hybrid"), ("", "no remote", "onsite"), ("", "fully remote", "remote"), ("onsite", "", "onsite"), (None, None, "unknown"), ("", "éremote", "remote"),
    ],
)
def test_mode(spark, flag, body, want):
    assert one(spark, text.work_mode(F.col("f").cast("string"), F.lit(None).cast("string"), F.col("t").cast("string")), f=flag, t=body) == want


@pytest.mark.parametrize(
    "body,want",
    [
        ("Salary: ₹28-42 LPA", (2.8e6, 4.2e6, "INR", "year")), ("Base $180k - $220k", (180000, 220000, "USD", "year")), ("pay £90,000 - £120,000", (90000, 120000, "GBP", "year")), ("Pay $65 - $85 per hour", (65, 85, "USD", "hour")),
        ("Java 17 and 3 - 5 people", None), ("salary $10k - $900k", None), (None, None), ("", None), ("package 1.2 - 1.8 Cr", (1.2e7, 1.8e7, "INR", "year")),
    ],
)
def test_compensation(spark, body, want):
    got = one(spark, text.compensation(F.col("t").cast("string")), t=body)
    assert (got and (round(got["min"], 3), round(got["max"], 3), got["currency"], got["period"])) == want


@pytest.mark.parametrize("title,n,want", [("Sales Engineer", 9, "other"), ("Backend Developer", 0, "software"), ("Mechanical Engineer", 9, "other"), ("Engineer", 6, "software"), ("Engineer", 1, "unknown"), ("", 9, "unknown"), (None, None, "unknown")])
def test_field(spark, title, n, want):
    assert one(spark, text.classify_field(F.col("t").cast("string"), F.col("n").cast("int")), t=title, n=n)["field"] == want


@pytest.mark.parametrize("title,want", [("Sr. Backend Engineer", ("backend engineer", "senior")), ("Data Engineer II", ("data engineer", "")), ("Senior Staff SDE", ("software engineer", "staff")), ("", ("", "")), (None, ("", "")), ("Leadership Coach", ("leadership coach", ""))])
def test_title(spark, title, want):
    assert tuple(one(spark, extract.normal_title(F.col("t").cast("string")), t=title)) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Bangalore / Hyderabad / Remote", ("IN", "KA", "Bengaluru")), ("Austin, TX, US", ("US", "TX", "Austin")), ("Paris, TX", ("US", "TX", "Paris")), ("Paris", ("FR", "", "Paris")), ("US-CA-Menlo Park", ("US", "CA", "Menlo Park")),
        ("Vancouver, BC", ("CA", "BC", "")), ("Remote", ("", "", "")), ("United States (Remote)", ("US", "", "")), ("Springfield, IN", ("", "", "")), (None, ("", "", "")), ("*HQ - San Francisco, CA", ("US", "CA", "San Francisco")),
    ],
)
def test_place(spark, raw, want):
    assert tuple(one(spark, extract.place(F.col("r").cast("string")), r=raw)) == want


def test_skills(spark):
    body = "We spark joy.\nRequirements\nStrong Go\nC++ and k8s\nNice to have\nDocker, go to market with sales teams around\nBenefits\nreact"
    skills = lambda t: {(x["skill"], x["requirement"]) for x in one(spark, extract.skills_of(F.col("t").cast("string")), t=t)}
    assert skills(body) == {("go", "must_have"), ("c++", "must_have"), ("kubernetes", "must_have"), ("docker", "nice_to_have"), ("react", "mentioned")}
    assert skills(None) == skills("") == set()
    assert skills("react\n" * 30_000 + "you\n  REQUIREMENTS: rust\nrust") == {("react", "mentioned"), ("rust", "must_have")}


def test_pay_windows_count_bytes(spark):
    """100 bytes before the word: 40 signs of three bytes leave 33 of them, so a sum before these is out of sight."""
    near, far = "Base $180k - $220k " + "₹" * 20 + " salary", "$180k - $220k " + "–" * 40 + " salary"
    pay = lambda t: one(spark, text.compensation(F.col("t")), t=t)
    assert pay(near)["min"] == 180000 and pay(far) is None and pay(far.replace("–", "-"))["min"] == 180000


def test_similarity(spark):
    assert round(one(spark, similarity(F.col("a"), F.col("b")), a="word", b="two words"), 4) == 0.3636
    assert one(spark, similarity(F.col("a"), F.col("b")), a="", b="") == 0.0


def test_search(spark):
    rows = spark.createDataFrame([(1, "Backend Engineer", "writing services"), (2, "Clerk", "an engineer sits near"), (3, "Engineers wanted", "sales of services"), (4, None, None)], "id int, t string, b string")
    ids = lambda q: [r.id for r in search.search(rows, q, "t", "b").orderBy(F.desc("rank"), "id").collect()]
    assert ids("engineer") == [1, 3, 2] and ids("engineer -sales") == [1, 2] and ids('"backend engineer" or clerk') == [1, 2] and ids("") == [] and ids("engineer services") == [1, 3]


def test_names_that_overlap(spark):
    """Every name that stands alone is found: inside another, at its start, across its end, one after another."""
    known = lambda t: {s["skill"] for s in one(spark, extract.skills_of(F.col("t")), t=t)}
    every = sorted(extract.NAMES)
    for line in (" ".join(every), ",".join(reversed(every)), "; ".join(f"{a} {b}" for a, b in zip(every, every[7:], strict=False))):
        text_ = f"requirements\n{line}"
        low = line.lower()
        plain = {skill for name, skill in extract.NAMES.items() if re.search(extract.name_pattern(name), low)}
        assert plain - known(text_) <= set(extract.IN_CONTEXT) and known(text_) <= plain
