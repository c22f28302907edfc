"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans. Four labelers vote on each candidate: the strict
pattern of its kind, gazetteers (issuers, country codes, domains, networks, bank countries,
given names, key formats), words in the context before it, and its edges.
Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is for each kind; its posteriors train a logistic span classifier, which also sees
the span's length and digits and the characters around it. It decides on the candidates
that the base patterns alone don't settle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table, text_or_empty

#: Kinds of the base patterns, in their order; then kinds that only the classifier can add.
BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "account", "local_phone", "ssn", "iban", "masked_email", "person", "address")
KINDS = (*BASE, *MORE)
LABELERS = ("pattern", "gazetteer", "context", "edges")
#: Characters before a span that the context labeler reads.
CONTEXT = 40
ROUNDS, STEPS, RATE, RIDGE, ACCEPT = 40, 400, 0.5, 1e-3, 0.5
#: Spans' worth of what all kinds together say about a labeler, in its reliability for one kind.
SHARED = 10.0
#: What the classifier sees beside kind and votes: classes of length, digits, and the characters around a span.
TRAITS = ("size", "digits", "before", "after")

_LOCAL = "[A-Za-z0-9._%+-]"
_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])"
# Names under which secrets are written, and the public formats of issued keys.
_KEY_NAMES = r"(?:[a-z]{2,12}[_-])?(?:api|access|auth|private|secret|session|account|encryption)[_-]?(?:key|token|secret)|secret|token|bearer|passw(?:or)?d|passphrase|pwd|credentials?"
_KEY_FORMS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+|-----BEGIN\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----"
# Forms of address, street words, and common given names in four languages.
_HONORIFICS = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Don|Doña|Señor|Señora"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Court|Ct|Square|Terrace|Place|Way|Highway"
_GIVEN = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Paul|Steven|Andrew|Kevin|Brian|George|Edward|Peter|Henry|Jack|Samuel|Benjamin|Alexander|"
    "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Sandra|Emily|Emma|Olivia|Sophia|Anna|Laura|Julia|Alice|Grace|Rachel|Hannah|Victoria|"
    "Hans|Jürgen|Wolfgang|Klaus|Stefan|Andreas|Matthias|Lukas|Jonas|Felix|Karl|Ursula|Monika|Petra|Sabine|Katharina|Johanna|Lena|Greta|Heike|"
    "Jean|Pierre|Michel|Jacques|Philippe|Nicolas|Antoine|François|Louis|Luc|Marie|Nathalie|Isabelle|Sylvie|Camille|Chloé|Léa|Claire|Sophie|Hélène|"
    "José|Juan|Carlos|Luis|Miguel|Javier|Antonio|Manuel|Francisco|Pablo|Diego|Alejandro|María|Carmen|Ana|Lucía|Elena|Pilar|Marta|Sofía|Isabel|Rosa"
)
_NAME = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}+(?:[-'][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}+)?+"
# The patterns begin a match only where a leftmost search would: at the end of the match
# before (\G) or where a run of their first class begins. Tries inside a run can't succeed,
# and would make long runs quadratic.
PATTERNS: dict[str, str] = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A search for [0-9]([\x20-]?[0-9])+ takes whole runs; only those of 14 to 19 digits count.
    "card": _RUN + r"{13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?i)(?<![A-Za-z0-9])(?:{_KEY_NAMES})[\"']?\x20{{0,3}}[=:]\x20{{0,3}}[\"']?[A-Za-z0-9+/_.-]{{8,}}+[\"']?|(?-i:(?<![A-Za-z0-9])(?:{_KEY_FORMS}))",
    "account": _RUN + r"{12,18}+(?![\x20-]?[0-9])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "masked_email": rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{{1,63}}+)+",
    "person": rf"(?<![A-Za-zÀ-ÿ])(?=[A-Z])(?:(?:{_HONORIFICS})\.?\x20{_NAME}(?:\x20{_NAME}){{0,2}}+|(?:{_GIVEN})(?:\x20{_NAME}){{1,2}}+)(?![A-Za-zÀ-ÿ])",
    "address": (
        rf"(?<![A-Za-zÀ-ÿ0-9])(?:[0-9]{{1,5}}+[a-z]?\x20(?:{_NAME}\x20){{1,3}}?(?:{_STREETS})(?![A-Za-z])|{_NAME}(?<=straße|strasse|weg|platz|allee|gasse)\x20[0-9]{{1,4}}+[a-z]?(?![A-Za-z0-9])"
        rf"|(?i:[0-9]{{1,4}}+,?\x20(?:rue|boulevard|avenue|place|quai)|calle|avenida|plaza|paseo)\x20(?:(?:de|du|des|del|la|las|los|el)\x20){{0,2}}+{_NAME}(?:\x20{_NAME}){{0,2}}+(?:,?\x20[0-9]{{1,4}}+)?)"
    ),
}
#: What a text must hold before a pattern is tried at all: a short pattern, or words, in lower case or as they stand.
#: Persons are looked for at once; the other kinds need two digits close together.
TRIGGERS = {"email": "@", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "masked_email": r"(?i)[\[(]at[\])]"}
LOWER_WORDS = {
    "secret": ("key", "secret", "token", "bearer", "passw", "passphrase", "pwd", "credential"),
    "address": ("rue ", "boulevard ", "avenue ", "place ", "quai ", "calle ", "avenida ", "plaza ", "paseo "),
}
WORDS = {
    "secret": ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "AIza", "sk_live_", "eyJ", "-----BEGIN "),
    "address": (*_STREETS.split("|"), "straße ", "strasse ", "weg ", "platz ", "allee ", "gasse "),
}
DIGITS = r"[0-9](?:[\x20.-]?[0-9])"

# Gazetteers: public code lists. Of domains all two-letter ones, which stand for countries.
DOMAINS = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|asia|cat|coop|jobs|mobi|museum|tel|travel|app|dev|cloud|online|site|shop|store|tech|blog|email|example"
COUNTRY_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|4[2][0-9]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9]"
ISSUERS = r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|30[0-5]|3[689]|6011|65|35"
# Bank countries with the length of their account numbers.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
CUES: dict[str, str] = {
    "email": r"e-?mail|mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server|login|from",
    "card": r"card|visa|credit|debit|payment",
    "phone": r"phone|call|tel|mobile|fax|contact",
    "secret": r"config|auth|login|header|env",
    "account": r"card|account|acct|iban|bank|payment",
    "local_phone": r"phone|call|tel|mobile|fax|contact",
    "ssn": r"ssn|social|security",
    "iban": r"iban|bank|account|transfer",
    "masked_email": r"e-?mail|mail|contact|write|reach",
    "person": r"name|dear|signed|regards|contact|written by|author|attn|lieber?|cher|chère|querid[oa]|nombre|nom",
    "address": r"address|live|street|ship|deliver|office|home|wohn|adresse|habite|vive|dirección|located",
}
AGAINST = r"version|release|isbn|order|invoice|serial|section|chapter|figure|build"

_SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _may_hold(text: Column, kind: str) -> Column:
    """Whether a text can hold a span of a kind, at little cost."""
    if kind in WORDS:
        any_of = lambda x, words: reduce(lambda a, b: a | b, [x.contains(w) for w in words])
        return any_of(text, WORDS[kind]) | F.exists(F.array(F.lower(text)), lambda low: any_of(low, LOWER_WORDS[kind]))
    return F.lit(True) if kind == "person" else text.rlike(TRIGGERS.get(kind, DIGITS))


def _matches(text: Column, kind: str) -> Column:
    """Spans of one kind's pattern, in code points: what ``split`` leaves between the matches places them."""
    pattern = PATTERNS[kind]
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def merge(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("out"))

    def placed(found: Column) -> Column:
        steps = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.char_length(gap).alias("gap")))
        return F.when(F.size(found) > 0, F.aggregate(steps, start, merge, lambda acc: acc["out"]))

    # Bound to a name, what was found is not looked for again; only texts with a match are split.
    spans = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed), F.lit(0))
    return F.coalesce(F.when(_may_hold(text, kind), spans), F.array().cast(_SPANS))


def _base_spans(text: Column) -> Column:
    """Spans of the base patterns that pass their checks."""
    n_digits = lambda x: F.char_length(_digits(x["text"]))
    return F.concat(
        _matches(text, "email"),
        F.filter(_matches(text, "ip"), lambda x: x["text"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")),
        F.filter(_matches(text, "card"), lambda x: _luhn(_digits(x["text"]))),
        F.filter(_matches(text, "phone"), lambda x: n_digits(x).between(10, 15)),
    )


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 if yes; else -1 if ``no`` (if not given: always); else 0."""
    vote = F.when(F.coalesce(yes, F.lit(False)), 1)
    return vote.otherwise(-1) if no is None else vote.when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def _by_kind(kind: Column, cases: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, value in cases.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _mod_97(iban: Column) -> Column:
    """The remainder that a bank account number's check digits make 1; letters count from 10."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.transform(F.split(turned, ""), value), F.lit(0), lambda acc, v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _around(c: Column) -> Column:
    """Class of a character beside a span."""
    return F.when(c == "", 0).when(c.rlike(r"[\x20\x09-\x0D]"), 1).when(c.rlike("[\"'`\\[({<>})\\]]"), 2).when(c.rlike("[:=]"), 3).when(c.rlike("[.,;!?]"), 4).when(c.rlike("[A-Za-z0-9]"), 5).otherwise(6)


def _votes(text: Column, x: Column) -> Column:
    """The candidate with its four votes and its traits."""
    m, kind, start, end = x["text"], x["kind"], x["start"], x["end"]
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
    digits, solid = _digits(m), F.regexp_replace(m, " ", "")
    honour = m.rlike(rf"^(?:{_HONORIFICS})(?![A-Za-z])")
    pattern = _by_kind(
        kind,
        {
            "email": _vote(m.rlike(r"\.[A-Za-z]{2,24}$")),
            "ip": _vote(~m.rlike(r"^0")),
            "card": _vote(_luhn(digits)),
            "phone": _vote(F.char_length(digits).between(10, 15)),
            "secret": _vote(m.rlike(rf"^(?:{_KEY_FORMS})|[=:][\"'\x20]*(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_.-]{{8}}")),
            "account": _vote(_luhn(digits)),
            "local_phone": _vote(m.rlike(r"^(?:\([0-9]{3}\)|[0-9]{3})([\x20.-])[0-9]{3}[\x20.-][0-9]{4}$")),
            "ssn": _vote(m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")),
            "iban": _vote(_mod_97(solid) == 1),
            "masked_email": _vote(m.rlike(r"[A-Za-z]{2,24}$")),
            "person": _vote(honour | m.rlike(r"^[^\x20]+\x20[^\x20]+$"), F.lit(False)),
            "address": _vote(m.rlike("[0-9]")),
        },
    )
    gazetteer = _by_kind(
        kind,
        {
            "email": _vote(m.rlike(rf"(?i)\.(?:{DOMAINS})$"), F.lit(False)),
            "ip": _vote(~m.rlike(r"^(?:0|10|127|169\.254|192\.168|2[4-5][0-9])\.")),
            "card": _vote(digits.rlike(f"^(?:{ISSUERS})")),
            "phone": _vote(digits.rlike(f"^(?:{COUNTRY_CODES})")),
            "secret": _vote(m.rlike(rf"(?i)^(?:[a-z]{{2,12}}[_-])?(?:api|access|auth|private|secret|session|account|encryption)[_-]?(?:key|token|secret)|^(?-i:{_KEY_FORMS})"), m.rlike(r"[=:][\"'\x20]*[A-Za-z]+[\"']?$")),
            "account": _vote(digits.rlike(f"^(?:{ISSUERS})") & F.char_length(digits).isin(14, 15, 16), F.lit(False)),
            "local_phone": _vote(digits.rlike("^[2-9][0-9]{2}[2-9]")),
            "iban": _vote(F.concat(F.substring(m, 1, 2), F.char_length(solid).cast("string")).isin(*IBAN_LENGTHS.split())),
            "masked_email": _vote(m.rlike(rf"(?i)[^a-z](?:{DOMAINS})$"), F.lit(False)),
            "person": _vote(m.rlike(rf"(?<![A-Za-z])(?:{_GIVEN})(?![a-z])"), F.lit(False)),
            "address": _vote(m.rlike(r"\x20[^\x20]+\x20|(?:straße|strasse|weg|platz|allee|gasse)\x20"), F.lit(False)),
        },
    )
    context = _vote(_by_kind(kind, {k: F.when(before.rlike(cue), 1).otherwise(0) for k, cue in CUES.items()}) == 1, before.rlike(AGAINST))
    edge = lambda c: c.rlike("[A-Za-z0-9]")
    ahead = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(F.lit(""))
    behind = F.substring(text, end + 1, F.lit(1))
    # Most spans stand alone, so that says nothing; one that goes on in its surroundings is no whole.
    edges = _vote(F.lit(False), edge(ahead) | edge(behind))
    length = F.char_length(m)
    size = F.when(length < 12, 0).when(length < 20, 1).when(length < 40, 2).otherwise(3)
    share = F.char_length(digits) / length
    numeric = F.when(share == 0, 0).when(share < 0.3, 1).when(share < 0.75, 2).otherwise(3)
    values = zip((*LABELERS, *TRAITS), (pattern, gazetteer, context, edges, size, numeric, _around(ahead), _around(behind)), strict=True)
    return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), F.struct(*(v.cast("int").alias(name) for name, v in values)).alias("votes"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, more): per row the base spans, and further candidates that overlap none of them; each with its votes."""
    text = F.col("_text")
    extra = F.concat(*(_matches(text, kind) for kind in MORE))
    apart = F.filter("_extra", lambda x: ~F.exists("_base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    with_votes = lambda name: F.transform(name, lambda x: _votes(text, x)).alias(name[1:])
    return (
        docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("_text"))
        .withColumn("_base", _base_spans(text))
        .withColumn("_extra", extra)
        .withColumn("_more", apart)
        .select("id", with_votes("_base"), with_votes("_more"))
    )


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities by labeler, kind and vote for (false, true) spans, kinds' shares of true spans, and classifier weights."""

    reliability: dict[str, dict[str, dict[int, tuple[float, float]]]]
    share: dict[str, float]
    weights: dict[tuple[str, object], float]

    def probability(self, x: Column) -> Column:
        """The span classifier as a column expression."""
        z = F.lit(self.weights.get(("bias", 0), 0.0))
        for (name, value), w in self.weights.items():
            if name != "bias":
                z = z + F.when((x["kind"] if name == "kind" else x["votes"][name]) == F.lit(value), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def estimate(counts: list[tuple[str, dict[str, int], dict[str, int], float]], rounds: int = ROUNDS) -> SpanModel:
    """Expectation-maximisation and the classifier over (kind, votes, traits, count).

    There are at most kinds x 3^labelers x classes of traits of such rows, however many spans.
    Votes are independent given whether a span is true, and abstentions tell nothing; the
    start is the balance of the votes given. A labeler has a reliability for each kind, drawn
    towards what all kinds say by SHARED spans' worth; a kind without spans has just that.
    """
    of = np.array([KINDS.index(k) for k, _, _, _ in counts], int)
    n = np.array([x[3] for x in counts], float)
    votes = np.array([[v[name] for name in LABELERS] for _, v, _, _ in counts], int).reshape(-1, len(LABELERS))
    belief = 0.5 + 0.4 * votes.sum(axis=1) / np.maximum(1, np.abs(votes).sum(axis=1))
    # (labeler, kind, vote -1 or 1, false or true)
    rate = np.full((len(LABELERS), len(KINDS), 2, 2), 0.5)
    share = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        for i in range(len(LABELERS)):
            seen = np.zeros((len(KINDS), 2, 2))
            for v in (0, 1):
                said = votes[:, i] == 2 * v - 1
                for true, mass in enumerate((n * (1 - belief), n * belief)):
                    np.add.at(seen[:, v, true], of[said], mass[said])
            # A weak prior: labelers are more often right than not.
            every = seen.sum(axis=0) + [[2.0, 1.0], [1.0, 2.0]]
            own = seen + SHARED * every / every.sum(axis=0)
            rate[i] = own / own.sum(axis=1, keepdims=True)
        share = (1 + np.bincount(of, n * belief, len(KINDS))) / (2 + np.bincount(of, n, len(KINDS)))
        z = np.log(share / (1 - share))[of]
        for i in range(len(LABELERS)):
            odds = np.log(rate[i, of, :, 1] / rate[i, of, :, 0])
            z = z + np.where(votes[:, i] > 0, odds[:, 1], np.where(votes[:, i] < 0, odds[:, 0], 0.0))
        belief = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    features = [[("bias", 0), ("kind", k), *((name, v) for name, v in vs.items() if v), *traits.items()] for k, vs, traits, _ in counts]
    names = sorted({f for row in features for f in row}, key=repr)
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(features), len(names)))
    for r, row in enumerate(features):
        x[r, [at[f] for f in row]] = 1
    w = np.zeros(len(names))
    for _ in range(STEPS):
        off = (belief - 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))) * n / max(1.0, n.sum())
        w += RATE * (x.T @ off - RIDGE * w)
    reliability = {name: {k: {2 * v - 1: tuple(rate[i, j, v].tolist()) for v in (0, 1)} for j, k in enumerate(KINDS)} for i, name in enumerate(LABELERS)}
    return SpanModel(reliability, dict(zip(KINDS, share.tolist(), strict=True)), dict(zip(names, w.tolist(), strict=True)))


def learn(found: DataFrame) -> SpanModel:
    """A model from the candidates of a corpus; only counts of vote patterns reach the driver."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("x"))
    rows = spans.groupBy(F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes")).count().orderBy("kind", "votes").collect()
    return estimate([(r["kind"], {name: r["votes"][name] for name in LABELERS}, {name: r["votes"][name] for name in TRAITS}, float(r["count"])) for r in rows])


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in its order, joined by commas."""
    order = F.create_map(*(F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(id, base, spans): per row the base spans, and these with the spans that the classifier accepts.

    Null and empty texts have none. Every row is kept, repeated rows with equal spans; an
    empty table gives no rows. Accepted spans may overlap each other, never a base span.
    Offsets are code points, ends exclusive. Other columns are not read. Candidates and
    votes are written once; the model is learnt from them and then applied to them.
    """
    found = materialise(candidates(docs, id_col, text_col), "pii-candidates")
    model = learn(found)
    bare = lambda name: F.transform(name, lambda x: x.dropFields("votes"))
    added = F.transform(F.filter("more", lambda x: model.probability(x) >= accept), lambda x: x.dropFields("votes"))
    return found.select(F.col("id").alias(id_col), bare("base").alias("base"), F.concat(bare("base"), added).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; of overlapping spans the first counts.

    Spans belong to a row by a hash of id and text, so rows that repeat both are redacted alike.
    """
    key, other, spans = fresh(docs, "row_key", "other_key", "row_spans")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    placed = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    found = pii_spans(keyed, key, text_col, accept).where(F.size("spans") > 0).select(F.col(key).alias(other), placed.alias(spans)).dropDuplicates([other])
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def merge(acc: Column, x: Column) -> Column:
        ahead = x["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.when(ahead, x["end"]).otherwise(acc["at"]).alias("at"), F.when(ahead, more).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(spans, start, merge, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return keyed.join(found, keyed[key] == found[other], "left").select(*((F.when(F.col(spans).isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns))


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
