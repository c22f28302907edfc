"""Résumés: sections, contacts, skills by section, years of experience, diagnostics, confidence; all as columns.

A text stays one row from its lines to its result: a heading's place and the next one's cut its section out of the lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import SPACE, lines_of, mark, once, skills_in, spaced, stretches

# Headings, first match first, and how many words a heading may have.
HEADINGS = (
    ("skills", r"(technical\s+)?skills?(\s*(&|and)\s*(tools?|technolog\w+|competenc\w+))?:?"),
    ("skills", r"(technolog\w+|tech\s+stack|tooling|core\s+competenc\w+|areas\s+of\s+expertise|proficienc\w+):?"),
    ("experience", r"(work\s+|professional\s+|employment\s+|relevant\s+)?(experience|history|background)(\s*(&|and)\s*\w+)?:?"),
    ("experience", r"(career|positions?\s+held|work)"),
    ("education", r"education(\s*(&|and)\s*\w+)?:?"),
    ("education", r"(academic\s+(background|qualifications?)|qualifications?|degrees?|certifications?|training):?"),
    ("projects", r"(personal\s+|side\s+|selected\s+)?projects?:?"),
    ("projects", r"(open\s+source|portfolio|publications?|research):?"),
    ("summary", r"(summary|profile|about(\s+me)?|objective|professional\s+summary|career\s+objective):?"),
    ("contact", r"(contact(\s+(details?|info\w*))?|details|personal\s+(details|information)):?"),
    ("other", r"(awards?|achievements?|interests?|hobbies|languages?|references?|volunteer\w*|activities):?"),
)
HEADING_WORDS, SUMMARY_WORDS, HEADING_TAIL = 6, 12, ":—–_= \t-"
#: What every heading begins with.
STEMS = "skill tech tool core area profic work prof empl relev exper hist back career posit educ acad qualif degree certif train pers side select proj open port publ research summ about obj contact detail award achiev inter hobb lang refer volunt activ".split()
# Contacts, dates and stated years.
EMAIL = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"
PHONE = r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)?\d{3,5}[ .\-]\d{3,5}(?:[ .\-]\d{2,5})?"
LINK = r"(?i)\b(?:https?://)?(?:www\.)?(?:github\.com|gitlab\.com|linkedin\.com|stackoverflow\.com)/[\w\-./]+"
MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
RANGE = rf"(?i)\b(?:({MONTH})[a-z]*\.?\s+)?(\d{{4}})\s*(?:-|to|until|through)\s*(?:({MONTH})[a-z]*\.?\s+)?(\d{{4}}|present|current|now|ongoing)\b"
STATED = r"(?i)\b(\d{1,2})\s*\+?\s*(?:-\s*\d{1,2}\s*)?(?:years?|yrs?)\b"
SKILL_YEARS = r"(?i)[(\-–—,]\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LINKS, OLDEST, MOST_YEARS, ENOUGH_LINES = 8, 1950, 60, 15
# Sections by what a skill in them is worth, least first, with the name of the evidence; weights of the confidence.
EVIDENCE = (("contact", "unlabelled"), ("other", "other"), ("education", "education"), ("summary", "summary"), ("skills", "skills"), ("projects", "projects"), ("experience", "experience"))
WEIGHTS = {"email": 0.15, "skills": 0.30, "experience": 0.25, "years": 0.15, "education": 0.05, "lines": 0.10}

#: Boundaries of ASCII words, as the engine's own one knows more letters: before a pattern that begins with a word's sign, behind one that ends with it, and any.
_START, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _ascii(pattern: str, start: str = _START) -> str:
    return spaced(pattern).replace(r"(?i)\b", f"(?i){start}").replace(r"\b", _END)


#: Any heading with what may follow it: most lines are told apart by this one pattern.
_ANY_HEADING = _ascii("(?i)^(?:" + "|".join(p for _, p in HEADINGS) + rf")[{HEADING_TAIL}]*\z")


def _more_words(line: Column, n: int) -> Column:
    """Whether a trimmed line has more than ``n`` words; what follows them is not read."""
    return line.rlike(_ascii(rf"^(?:[^{SPACE}]*+\s++){{{n}}}"))


def _heading(line: Column) -> Column:
    clean = F.regexp_replace(line, rf"[{HEADING_TAIL}]+\z", "")
    named = lambda x: reduce(lambda rest, h: F.when(x.rlike(_ascii(rf"(?i)^(?:{h[1]})\z")), h[0]).otherwise(rest), reversed(HEADINGS), F.lit(None).cast("string"))
    # The first signs rule most lines out before the rest of them is read.
    like = F.substring(line, 1, max(map(len, STEMS))).rlike(f"(?i)^(?:{'|'.join(STEMS)})")
    return F.when(like & line.rlike(_ANY_HEADING) & ~_more_words(line, HEADING_WORDS), once(clean, named))


def sections(text: Column) -> Column:
    """Struct (n_lines, parts): the number of filled lines, and the stretches (section, own, lines) in their order, without the headings.

    What stands before the first heading is contact, and from a line of over twelve words on summary.
    """
    filled = F.filter(lines_of(text), lambda x: x != "")

    def marked(lines: Column, headings: Column) -> Column:
        until = F.get(F.filter(F.transform(headings, lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull()), F.lit(0))
        # A heading's section begins behind it, a long line's with the line.
        long = lambda n: F.transform(F.slice(lines, F.lit(1), n), lambda x, i: F.when(_more_words(x, SUMMARY_WORDS), mark(i, i, F.lit("summary"), "section")))
        named = F.transform(headings, lambda h, i: F.when(h.isNotNull(), mark(i, i + 1, h, "section")))
        there = lambda xs: F.filter(xs, lambda m: m.isNotNull())
        begin = F.array(mark(F.lit(0), F.lit(0), F.lit("contact"), "section"))
        return stretches(lines, F.concat(begin, F.slice(there(once(F.coalesce(until, F.size(lines)), long)), 1, 1), there(named)), "section")

    return once(filled, lambda ls: F.struct(F.size(ls).alias("n_lines"), once(F.transform(ls, _heading), lambda hs: marked(ls, hs)).alias("parts")))


def _month(name: Column) -> Column:
    short = F.lower(F.substring(name, 1, 3))
    return F.coalesce(F.array_position(F.array(*map(F.lit, MONTHS)), short) - 1, F.lit(0)) / 12


def _worked(body: Column, year: Column, month: Column) -> Column:
    """Years covered by the date ranges of a text, overlaps once; null without any."""
    group = lambda m, g: F.regexp_extract(m, _ascii(RANGE), g)
    at = lambda y, m: y.cast("double") + F.when(m != "", _month(m)).otherwise(0.0)
    until = lambda m: F.when(group(m, 4).rlike("^[0-9]+$"), at(group(m, 4).try_cast("int"), group(m, 3))).otherwise(year + (month - 1) / 12)
    spans = F.transform(F.regexp_extract_all(body, F.lit(_ascii(RANGE)), F.lit(0)), lambda m: F.struct(at(group(m, 2).try_cast("int"), group(m, 1)).alias("a"), until(m).alias("b")))
    good = F.array_sort(F.filter(spans, lambda s: (s["b"] >= s["a"]) & (s["a"] >= OLDEST) & (s["b"] <= year + 1)))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1.0).alias("end"))
    total = F.aggregate(good, start, lambda s, x: F.struct((s["total"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0.0))).alias("total"), F.greatest(s["end"], x["b"]).alias("end")))["total"]
    return F.when(total > 0, F.floor(total * 10 + 0.5) / 10)


def _stated(body: Column) -> Column:
    n = F.regexp_extract(body, _ascii(STATED), 1).try_cast("double")
    return F.when(body.rlike("(?i)years?|yrs?"), once(n, lambda n: F.when((n > 0) & (n < MOST_YEARS), n)))


def _skill_years(said: Column, skill: Column) -> Column:
    """Years stated behind a skill's name, in the first of the lines that does so."""
    behind = lambda low: F.regexp_extract(F.substring(low, F.instr(low, skill), F.length(low)), _ascii(SKILL_YEARS), 1).try_cast("double")
    every = F.transform(F.filter(said, lambda x: F.contains(x, skill)), behind)
    return F.get(F.filter(every, lambda n: (n > 0) & (n < MOST_YEARS)), F.lit(0))


def _skills(bodies: Column) -> Column:
    """Array of (canonical, evidence, years), sorted: the skills of the sections' lines, each from its strongest section. ``bodies`` stand as in EVIDENCE."""
    said = lambda lines: F.transform(F.filter(lines, lambda x: x.rlike(_ascii(SKILL_YEARS))), F.lower)
    name = lambda i: F.get(F.array(*(F.lit(e) for _, e in EVIDENCE)), i)
    of_body = lambda i: lambda x: F.struct(x["skill"].alias("skill"), i.alias("rank"))
    found = F.flatten(F.reverse(F.transform(bodies, lambda lines, i: F.transform(skills_in(lines), of_body(i)))))
    strongest = lambda xs: once(F.transform(xs, lambda x: x["skill"]), lambda names: F.filter(xs, lambda x, i: F.array_position(names, x["skill"]) == i + 1))
    # Lines that state years are looked for where a section's skill counts, once for all of its skills.
    stated = lambda best: F.transform(bodies, lambda lines, i: F.when(F.exists(best, lambda x: x["rank"] == i), said(lines)))
    row = lambda x, lines: F.struct(x["skill"].alias("canonical"), name(x["rank"]).alias("evidence"), _skill_years(F.get(lines, x["rank"]), x["skill"]).alias("years"))
    return once(once(found, strongest), lambda best: once(stated(best), lambda lines: F.array_sort(F.transform(best, lambda x: row(x, lines)))))


def parse(rows: DataFrame, as_of: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, email, phone, links, skills, years_of_experience, confidence, diagnostics, n_lines) of each text.

    A skill counts once, from its strongest section, with the years stated there. Years are those
    of the experience section's date ranges, or, without such a section, those that the summary states. Of
    a text without lines nothing is known.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    # However few files or row groups hold the texts, the work on them is spread; each text is shuffled once, and nothing that is made of it.
    spread = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    cut = spread.select("id", sections(F.col("_text")).alias("_cut"))
    of = lambda cond: F.flatten(F.transform(F.filter("_cut.parts", lambda p: cond(p["section"])), lambda p: p["lines"]))
    bodies = F.array(*(of(lambda x, s=s: x == s) for s, _ in EVIDENCE))
    cut = cut.select("id", F.col("_cut.n_lines").alias("n_lines"), of(lambda x: F.lit(True)).alias("_all"), of(lambda x: x.isin("contact", "summary")).alias("_head"), bodies.alias("_bodies"))
    place = {s: i for i, (s, _) in enumerate(EVIDENCE)}
    body = lambda s: F.get("_bodies", F.lit(place[s]))
    joined = lambda s: F.array_join(body(s), "\n")
    # Contacts and links are within a line, and not in headings.
    first = lambda lines, like, pattern: F.get(F.filter(F.transform(F.filter(lines, like), lambda x: F.btrim(F.regexp_extract(x, pattern, 0))), lambda x: x != ""), F.lit(0))
    email = lambda lines: first(lines, lambda x: F.contains(x, F.lit("@")), _ascii(EMAIL, _EDGE))
    phone = first(F.col("_head"), lambda x: x.rlike(r"\d{3}[ .\-]\d{3}"), PHONE)
    linked = F.transform(F.filter("_all", lambda x: x.rlike(r"(?i)\.com/")), lambda x: F.regexp_extract_all(x, F.lit(_ascii(LINK, f"(?=[hwgls]){_START}")), F.lit(0)))
    bare = lambda x: F.lower(F.regexp_replace(x, "/+$", ""))
    unlike = lambda xs: once(F.transform(xs, bare), lambda names: F.filter(xs, lambda x, i: F.array_position(names, F.get(names, i)) == i + 1))
    links = F.array_sort(once(F.slice(F.flatten(linked), 1, LINKS), unlike))
    there, worked = F.col("n_lines") > 0, F.size(body("experience")) > 0
    found = cut.select(
        "id", "n_lines", F.coalesce(email(F.col("_head")), email(F.col("_all"))).alias("email"), phone.alias("phone"), links.alias("links"), _skills(F.col("_bodies")).alias("skills"),
        F.when(worked, _worked(joined("experience"), F.year(now), F.month(now))).otherwise(once(joined("summary"), _stated)).alias("years_of_experience"),
        worked.alias("_work"), (F.size(body("education")) > 0).alias("_school"),
    )
    some = F.size("skills") > 0
    checks = {"email": F.col("email").isNotNull(), "skills": some, "experience": F.col("_work"), "years": F.col("years_of_experience").isNotNull(), "education": F.col("_school"), "lines": F.col("n_lines") >= ENOUGH_LINES}
    weight = sum((F.when(ok, WEIGHTS[k]).otherwise(0.0) for k, ok in checks.items()), F.lit(0.0))
    codes = F.array(F.when(~F.col("_work"), "no_experience_section"), F.when(~some, "no_skills"), F.when(F.col("email").isNull(), "no_contact"), F.when(F.col("_work") & F.col("years_of_experience").isNull(), "no_dates"))
    return found.select(
        "id", "email", "phone", "links", "skills", "years_of_experience", F.when(there, F.floor(weight * 100 + 0.5) / 100).otherwise(0.0).alias("confidence"),
        F.when(there, F.array_compact(codes)).otherwise(F.array(F.lit("empty"))).alias("diagnostics"), "n_lines",
    )
