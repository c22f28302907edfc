"""Extraction from free text as Column expressions.

Word boundaries are written as look-arounds over ASCII word characters, so a pattern means
the same for every engine and JDK. Values that can't be read are null: unknown, not zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_]"
B, E = f"(?<!{WORD})", f"(?!{WORD})"
# Confidence levels.
STRONG, WEAK, NONE = 0.9, 0.5, 0.0


def _last(x: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


def collapse_space(x: Column) -> Column:
    """Runs of blanks become one, none stand around a line end, at most one empty line is left, ends are trimmed."""
    return _last(x, (r"[ \t]+", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", ""))


def strip_html(x: Column) -> Column:
    """Text of a markup fragment: block ends and breaks are line ends, other tags blanks; nine entities are read once."""
    x = _last(x, (r"(?i)</(?:p|div|li|ul|ol|h[1-6]|br|tr)>|<br\s*/?>", "\n"), ("<[^>]*>", " "))
    # An ampersand that an entity makes starts no entity: it is replaced last.
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "'"), ("&ndash;", "-"), ("&mdash;", "-"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(to))
    return collapse_space(x)


# Years patterns in their order, and bands that a seniority implies.
_TO, _YEARS = "[-–—to]+", "(?:years?|yrs?)"
YOE_RANGE = rf"(?i){B}(\d{{1,2}})\s*{_TO}\s*(\d{{1,2}}){E}\s*\+?\s*{_YEARS}"
YOE_LEAST = (
    rf"(?i){B}(\d{{1,2}})\s*\+\s*{_YEARS}",
    rf"(?i)(?:at least|minimum(?: of)?|min\.?)\s*{B}(\d{{1,2}}){E}\s*{_YEARS}",
    rf"(?i){B}(\d{{1,2}}){E}\s*{_YEARS}\s+(?:of\s+)?(?:relevant\s+|professional\s+|industry\s+)?experience",
)
SENIORITY_YEARS = {
    "intern": (0, 1), "trainee": (0, 1), "apprentice": (0, 1), "graduate": (0, 2), "entry level": (0, 2), "entry-level": (0, 2), "junior": (0, 2), "jr": (0, 2),
    "associate": (1, 3), "senior": (5, 10), "sr": (5, 10), "staff": (8, 15), "principal": (10, 20), "lead": (7, 12),
}


def _number(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit("")).cast("int")


def years_of_experience(text: Column, seniority: Column | None = None) -> Column:
    """Struct (min, max, confidence). The first match of each pattern counts; one that makes no sense passes to the next."""
    band = lambda lo, hi, sure: F.struct(lo.cast("int").alias("min"), hi.cast("int").alias("max"), F.lit(sure).alias("confidence"))
    lo, hi = _number(text, YOE_RANGE, 1), _number(text, YOE_RANGE, 2)
    none = F.lit(None)
    out = F.when((lo <= hi) & (hi <= 40), band(lo, hi, STRONG))
    for pattern in YOE_LEAST:
        n = _number(text, pattern, 1)
        out = out.when(n.between(1, 30), band(n, none, STRONG))
    if seniority is not None:
        for word, (a, b) in SENIORITY_YEARS.items():
            out = out.when(seniority == word, band(F.lit(a), F.lit(b), WEAK))
    return out.otherwise(band(none, none, NONE))


HYBRID = rf"{B}hybrid{E}|{B}\d\s*days?\s+(?:a\s+week\s+)?(?:in|at)\s+(?:the\s+)?office{E}|{B}in[- ]office\s+\d\s*days?"
REMOTE = rf"{B}(?:fully\s+)?remote{E}|{B}work\s+from\s+home{E}|{B}distributed\s+team{E}|{B}wfh{E}"
ONSITE = rf"{B}on[- ]?site{E}|{B}in[- ]person{E}|{B}no\s+remote{E}"


def work_mode(flag: Column, location: Column, text: Column) -> Column:
    """remote, hybrid, onsite or unknown; what the prose says counts more than the vendor's flag."""
    hay = F.lower(F.concat(F.coalesce(location, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    said = F.lower(F.btrim(F.coalesce(flag, F.lit(""))))
    vendor = F.when(said.isin("remote", "fully_remote", "telecommute"), "remote").when(said == "hybrid", "hybrid").when(said.isin("onsite", "on_site", "on-site", "in_office"), "onsite").otherwise("unknown")
    onsite = hay.rlike(ONSITE)
    return (
        F.when(hay.rlike(HYBRID), "hybrid").when(onsite & (vendor == "remote"), "hybrid").when(onsite, "onsite").when(vendor == "remote", "remote").when(hay.rlike(REMOTE), "remote").otherwise(vendor)
    )


# Pay patterns in their order, with multiplier, period and, if it is settled, currency.
_INR = r"(?:₹|rs\.?|inr)"
PAY = (
    (rf"(?i){_INR}?\s*(\d{{1,3}}(?:\.\d+)?)\s*(?:l|lpa|lakhs?)?\s*{_TO}\s*(\d{{1,3}}(?:\.\d+)?)\s*(?:l|lpa|lakhs?)", 1e5, "year", "INR", 2),
    (rf"(?i){_INR}\s*(\d{{1,3}}(?:\.\d+)?)\s*(?:l|lpa|lakhs?){E}", 1e5, "year", "INR", 1),
    (rf"(?i){_INR}?\s*(\d{{1,2}}(?:\.\d+)?)\s*(?:cr|crores?)?\s*{_TO}\s*(\d{{1,2}}(?:\.\d+)?)\s*(?:cr|crores?)", 1e7, "year", "INR", 2),
    (rf"(?i)([$€£])\s*(\d{{2,4}})\s*k\s*{_TO}\s*[$€£]?\s*(\d{{2,4}})\s*k", 1e3, "year", "", 2),
    (rf"(?i)([$€£])\s*(\d{{1,3}}(?:,\d{{3}})+)\s*{_TO}\s*[$€£]?\s*(\d{{1,3}}(?:,\d{{3}})+)", 1.0, "year", "", 2),
    (rf"(?i)([$€£])\s*(\d{{2,3}})\s*{_TO}\s*[$€£]?\s*(\d{{2,3}})\s*(?:/|per\s+)?(?:hr|hour)", 1.0, "hour", "", 2),
)
PAY_WORD = "(?i)salary|compensation|pay|ctc|package|remuneration|base|lpa"


def _window(text: Column) -> Column:
    """Bytes around the first pay word (100 before, 300 from it) or else the first currency sign (66 and 200)."""
    raw = F.encode(text, "UTF-8")

    def around(at: Column, radius: int) -> Column:
        before = F.octet_length(F.substring(text, F.lit(1), at - 1))
        start = F.greatest(before - radius // 3, F.lit(0))
        return F.make_valid_utf8(F.substring(raw, start + 1, before - start + radius).cast("string"))

    word, sign = F.regexp_instr(text, F.lit(PAY_WORD)), F.regexp_instr(text, F.lit("[₹$€£]"))
    return F.when(word > 0, around(word, 300)).when(sign > 0, around(sign, 200))


def compensation(text: Column) -> Column:
    """Struct (min, max, currency, period) of the first plausible pay near the first pay word.

    Windows count bytes, as the original does. Each pattern is looked for once; its numbers
    are read from what it matched.
    """
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def read(window: Column, pattern: str, times: float, period: str, currency: str, numbers: int) -> Column:
        number = lambda m, g: F.regexp_replace(F.regexp_extract(m, pattern, g), ",", "").try_cast("double") * times
        first = 1 if currency else 2

        def found(m: Column) -> Column:
            sign = F.substring(F.btrim(m), 1, 1)
            money = F.lit(currency) if currency else F.when(sign == "$", "USD").when(sign == "€", "EUR").otherwise("GBP")
            high = number(m, first + 1) if numbers == 2 else F.lit(None).cast("double")
            return F.struct(number(m, first).alias("min"), high.alias("max"), money.alias("currency"), F.lit(period).alias("period"))

        def sane(x: Column) -> Column:
            lo, hi = x["min"], F.coalesce(x["max"], x["min"])
            fits = lo.between(5, 2000) if period == "hour" else lo.between(1e5, 2e8) if currency == "INR" else lo.between(1e4, 5e6)
            return F.when((lo > 0) & (hi >= lo) & (hi / lo <= 10) & fits, x)

        return once(F.regexp_extract(window, pattern, 0), lambda m: F.when(m != "", once(found(m), sane)))

    return once(_window(text), lambda window: F.coalesce(*(read(window, *pay) for pay in PAY)))


# Title words that settle the field, in their order.
NOT_SOFTWARE = (
    "sales", "account executive", "account manager", "business development", "customer success", "customer service", "support specialist", "finance", "accounting", "accountant", "controller",
    "treasury", "payroll", "investor relations", "travel & expense", "procurement", "sourcing analyst", "legal", "counsel", "compliance officer", "recruiter", "recruiting",
    "talent acquisition", "people partner", "human resources", "hr business partner", "werkstudent people", "marketing", "brand", "communications", "content writer", "copywriter", "logistics",
    "warehouse", "driver", "facilities", "janitor", "nurse", "physician", "clinical", "food safety", "fsqa", "hvac", "electrician", "welder", "machinist", "product manager", "program manager",
    "project manager", "product owner", "deal desk", "deal lead", "ventures", "value engineer", "solutions consultant", "account management", "supply chain", "technician", "coordinator",
    "video editor", "creative", "buyer", "planner", "auditor", "trainer", "instructor", "techniker", "konstruktion", "vertrieb", "einkauf", "buchhaltung", "mechaniker", "elektro",
    "asesor comercial", "ventas",
)
SOFTWARE = (
    "software", "backend", "back-end", "back end", "frontend", "front-end", "front end", "fullstack", "full-stack", "full stack", "developer", "programmer", "programming", "sre",
    "site reliability", "devops", "platform engineer", "infrastructure engineer", "data engineer", "machine learning", "ml engineer", "ai engineer", "applications engineer", "security engineer",
    "systems engineer", "mobile engineer", "android", "ios engineer", "web engineer", "qa engineer", "test engineer", "solutions architect", "software architect", "engineering manager",
    "engineering lead", "technical lead", "tech lead",
)
OTHER_ENGINEERING = (
    "mechanical", "electrical", "electronic", "civil", "chemical", "process", "manufacturing", "production", "industrial", "structural", "automotive", "hardware", "thermal", "acoustic",
    "materials", "packaging",
)
SKILLS_DECIDE = 6


def first_of(hay: Column, needles: tuple[str, ...]) -> Column:
    """The first needle of the list that the text holds, or null."""
    return F.get(F.filter(F.array(*map(F.lit, needles)), lambda n: hay.contains(n)), F.lit(0))


def classify_field(title: Column, n_skills: Column) -> Column:
    """Struct (field, confidence, because)."""
    t = F.lower(F.btrim(F.coalesce(title, F.lit(""))))
    other, soft, domain = first_of(t, NOT_SOFTWARE), first_of(t, SOFTWARE), first_of(t, OTHER_ENGINEERING)
    guess = lambda name, sure, why: F.struct(F.lit(name).alias("field"), F.lit(sure).alias("confidence"), why.alias("because"))
    says = lambda x: F.concat(F.lit("the title says "), x)
    engineer, many = t.contains("engineer"), F.coalesce(n_skills, F.lit(0)) >= SKILLS_DECIDE
    counted = F.concat(n_skills.cast("string"), F.lit(" known skills in the description"))
    return (
        F.when(t == "", guess("unknown", 0.0, F.lit("no title to read")))
        .when(other.isNotNull(), guess("other", 0.9, says(other)))
        .when(soft.isNotNull(), guess("software", 0.9, says(soft)))
        .when(engineer & domain.isNotNull(), guess("other", 0.85, F.concat(F.lit("a "), domain, F.lit(" engineer"))))
        .when(engineer & many, guess("software", 0.55, counted))
        .when(engineer, guess("unknown", 0.2, F.lit("an engineer, but of what we cannot tell")))
        .when(many, guess("software", 0.45, counted))
        .otherwise(guess("unknown", 0.0, F.lit("nothing in the title or body we recognise")))
    )


# What vendors write, folded to the enumerations.
EMPLOYMENT = {
    "full_time": ("fulltime", "fulltimepermanent", "permanent", "regular"), "part_time": ("parttime", "parttimepermanent"), "contract": ("contract", "contractor", "freelance", "fixedterm", "temporarycontract"),
    "intern": ("intern", "internship", "trainee", "workingstudent", "apprenticeship"), "temporary": ("temporary", "temp", "seasonal"),
}
PERIODS = {
    "hour": ("1 HOUR", "HOUR", "HOURLY", "PER_HOUR"), "day": ("1 DAY", "DAY", "DAILY", "PER_DAY"), "week": ("1 WEEK", "WEEK", "WEEKLY", "PER_WEEK"), "month": ("1 MONTH", "MONTH", "MONTHLY", "PER_MONTH"),
    "year": ("1 YEAR", "YEAR", "YEARLY", "ANNUAL", "ANNUALLY", "PER_YEAR"),
}


def _folded(key: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit("")
    for value, words in vocabulary.items():
        out = F.when(key.isin(*words), value).otherwise(out)
    return out


def employment(x: Column) -> Column:
    """The kind of employment, or an empty string."""
    return _folded(F.regexp_replace(F.lower(F.btrim(F.coalesce(x, F.lit("")))), "[ _-]", ""), EMPLOYMENT)


def pay_period(x: Column) -> Column:
    """The pay period, or an empty string."""
    return _folded(F.upper(F.btrim(F.coalesce(x, F.lit("")))), PERIODS)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.btrim(c), F.lit("")) for c in columns))


def parse_confidence(title: Column, body: Column, country: Column, mode: Column, yoe_confidence: Column, n_skills: Column) -> Column:
    """Fifths of what could be read; the body counts from over 200 bytes."""
    there = lambda x: F.coalesce(x, F.lit("")) != ""
    signs = (there(title), F.octet_length(F.coalesce(body, F.lit(""))) > 200, there(country) | (F.coalesce(mode, F.lit("")) == "remote"), F.coalesce(yoe_confidence, F.lit(0.0)) >= 0.5, F.coalesce(n_skills, F.lit(0)) >= 1)
    return sum(s.cast("int") for s in signs) / F.lit(5.0)


def display_name(skill: Column, overrides: dict[str, str]) -> Column:
    """The override, or every word with its first letter raised and the rest as it is."""
    words = F.filter(F.split(skill, r"\s+"), lambda w: w != "")
    raised = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))), " ")
    known = F.create_map(*(F.lit(v) for kv in overrides.items() for v in kv))
    return F.coalesce(known[skill], raised)
