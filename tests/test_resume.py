"""Résumés with fixed answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.functions import resume

FULL = """Jane Roe
jane.roe@mail.example | +44 20 7946 0958
github.com/jane/ https://linkedin.com/in/jane GITHUB.com/jane

Professional Summary
Engineer with 12+ years
SKILLS:
Python - 6 years, docker
Work Experience
Acme, Jan 2010 - Jul 2012
python and kafka
Beta, March 2012 to 2014; Gamma 2020 - present
Education
BSc, react
Interests
docker
"""
CASES = {
    "full": (FULL, ("jane.roe@mail.example", "7946 0958", ["github.com/jane/", "https://linkedin.com/in/jane"], {("docker", "skills", None), ("kafka", "experience", None), ("python", "experience", None), ("react", "education", None)}, 6.0, 1.0, [], 15)),
    "no headings": ("me\n" + "word " * 13 + "with 7 years\nreact", (None, None, [], {("react", "summary", None)}, 7.0, 0.45, ["no_experience_section", "no_contact"], 3)),
    "no dates": ("a@b.co\nWork\nsome things\n", ("a@b.co", None, [], set(), None, 0.4, ["no_skills", "no_dates"], 3)),
    "years of a skill": ("Skills\nkafka\nKafka (4 yrs)\nkafka, 9 years", (None, None, [], {("kafka", "skills", 4.0)}, None, 0.3, ["no_experience_section", "no_contact"], 4)),
    "blank": (" \n\t\n", (None, None, [], set(), None, 0.0, ["empty"], 0)),
    "null": (None, (None, None, [], set(), None, 0.0, ["empty"], 0)),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, text, "x") for i, (text, _) in enumerate(CASES.values())]
    return {r.id: r for r in resume.parse(spark.createDataFrame(rows, "id long, text string, skills string"), "2022-01-15 00:00:00").collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_cases(parsed, name):
    r = parsed[list(CASES).index(name)]
    skills = {tuple(s) for s in r.skills}
    assert (r.email, r.phone, r.links, skills, r.years_of_experience, r.confidence, r.diagnostics, r.n_lines) == CASES[name][1]


def test_empty_table(spark):
    assert resume.parse(spark.createDataFrame([], "id long, text string"), "2022-01-15 00:00:00").count() == 0


HEADINGS = {
    "skills": "Technical Skills|skill|skills & tools|Skills and competencies:|Technology|Tech  Stack|tooling|Core Competencies|AREAS OF EXPERTISE|Proficiency",
    "experience": "Experience|work history|Professional background|Employment  experience and others|relevant experience|Career|Position held|positions held|Work",
    "education": "Education|Education & Training|Academic qualification|academic background|Qualifications|Degree|Certifications:|training --",
    "projects": "Project|personal projects|Side Projects|selected projects|Open Source|Portfolio|Publications|research",
    "summary": "Summary|Profile|about|About me|Objective|Professional summary|Career objective",
    "contact": "Contact|contact details|Contact info|Details|Personal information",
    "other": "Award|achievements|Interests|Hobbies|language|References|volunteering|Activities =",
}


def test_every_heading_is_known(spark):
    named = [(s, x) for s, xs in HEADINGS.items() for x in xs.split("|")]
    rows = spark.createDataFrame([(i, x + "\nkafka", s) for i, (s, x) in enumerate(named)], "id long, text string, s string")
    wrong = rows.select("text", "s", resume.sections(F.col("text"))["parts"].alias("p")).where("element_at(p, -1).section <> s OR element_at(p, -1).lines <> array('kafka')")
    assert wrong.collect() == []


def test_a_text_is_shuffled_once_and_nothing_else_is(spark):
    plan = resume.parse(spark.createDataFrame([(1, FULL)], "id long, text string"), "2022-01-15 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert not any(x in plan for x in ("Window", "Generate", "Join", "Aggregate"))


@pytest.mark.parametrize(("text", "n_lines", "sections"), [
    ("Skills\u0085\nkafka", 2, ["contact"]),  # more than a heading
    ("\x0b\nkafka", 2, ["contact"]),  # no white space to the SQL
    ("\tSkills\r\n\r\nkafka\f", 2, ["contact", "skills"]),
])
def test_white_space_is_that_of_the_sql(spark, text, n_lines, sections):
    r = spark.createDataFrame([(text,)], "text string").select(resume.sections(F.col("text")).alias("x")).first().x
    assert (r.n_lines, [p.section for p in r.parts]) == (n_lines, sections)


def test_work_grows_with_the_number_of_lines(spark):
    """Headings and names in every other line of one long text."""
    text = "me@x.org\n" + "Skills\nkafka (3 yrs)\nRequirements\ngo\n" * 20_000
    r = resume.parse(spark.createDataFrame([(1, text)], "id long, text string"), "2022-01-15 00:00:00").first()
    assert ({tuple(s) for s in r.skills}, r.n_lines) == ({("kafka", "skills", 3.0), ("go", "skills", None)}, 80_001)
