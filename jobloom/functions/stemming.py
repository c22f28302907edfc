"""English stems (the published Snowball algorithm for English, also known as Porter 2) as Column expressions.

Words are lower-case runs of letters and digits. A table of distinct words is stemmed, not a
text: each step is a column over the one before, so no word's expression is evaluated twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the algorithm and its stop list.
STOP = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those
am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
should now""".split()
)
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **dict.fromkeys(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"), ""),
}
#: Words that stay as they are once plural endings are gone.
FINAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings after which the first region starts.
BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Endings and what they become: in the first region, then there again, then in the second. None of them: deleted.
SECOND = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
#: What must stand before an ending for it to count.
BEFORE = {"ogi": "l", "li": "cdeghkmnrt", "ion": "st"}

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
REGION = f"^.*?{VOWEL}{OTHER}"
#: A short syllable at a word's end.
SHORT = f"(?:^{VOWEL}{OTHER}|{OTHER}{VOWEL}[^aeiouywxY])$"


def split_words(text: Column) -> Column:
    """Lower-case words in order: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _cut(x: Column, n: int) -> Column:
    return F.substring(x, F.lit(1), F.char_length(x) - n)


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), otherwise)


def _endings(x: Column, changes: dict[str, str], region: Column, special: dict[str, Column] | None = None) -> Column:
    """``x`` with its longest ending changed, if that lies in ``region`` and what must stand before it does."""
    cases = []
    for ending in sorted(changes, key=len, reverse=True):
        changed = F.concat(_cut(x, len(ending)), F.lit(changes[ending]))
        fits = F.char_length(x) - len(ending) >= region
        if ending in BEFORE:
            fits &= x.rlike(f"[{BEFORE[ending]}]{ending}$")
        if special and ending in special:
            fits &= special[ending]
        cases.append((x.endswith(ending), F.when(fits, changed).otherwise(x)))
    return _first(cases, x)


def with_stems(words: DataFrame, word: str = "word", stem: str = "term") -> DataFrame:
    """``words`` with the stem of each word; null has none. Words that differ in case differ.

    Filter on stems only once they are written: Spark pushes a filter through all steps, and it grows with each.
    """
    x, r1, r2, length = F.col("_x"), F.col("_r1"), F.col("_r2"), F.char_length("_x")
    out = words.withColumn("_x", F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), f"({VOWEL})y", "$1Y"))
    region = F.char_length(F.regexp_extract("_x", REGION, 0))
    begins = F.char_length(F.regexp_extract("_x", f"^(?:{'|'.join(BEGINNINGS)})", 0))
    out = out.withColumn("_r1", F.when(begins > 0, begins).when(region > 0, region).otherwise(length))
    inner = F.char_length(F.regexp_extract(F.substring(x, r1 + 1, length), REGION, 0))
    out = out.withColumn("_r2", F.when(inner > 0, r1 + inner).otherwise(length))
    # Plurals.
    plural = [
        (x.endswith("sses"), _cut(x, 2)), (x.endswith("ied") | x.endswith("ies"), F.when(length > 4, _cut(x, 2)).otherwise(_cut(x, 1))), (x.endswith("us") | x.endswith("ss"), x),
        (x.endswith("s") & x.rlike(f"{VOWEL}.+s$"), _cut(x, 1)),
    ]
    out = out.withColumn("_x", _first(plural, x)).withColumn("_done", x.isin(*FINAL))
    # Past tense and participles.
    eed = lambda e: (x.endswith(e), F.when(length - len(e) >= r1, F.concat(_cut(x, len(e)), F.lit("ee"))).otherwise(x))
    out = out.withColumn("_base", _first([(x.endswith(e), _cut(x, len(e))) for e in ("ingly", "edly", "ing", "ed")], F.lit(None).cast("string")))
    base = F.col("_base")
    mended = _first(
        [(base.rlike("(?:at|bl|iz)$"), F.concat(base, F.lit("e"))), (base.rlike(f"(?:{'|'.join(DOUBLES)})$"), _cut(base, 1)), ((r1 >= F.char_length(base)) & base.rlike(SHORT), F.concat(base, F.lit("e")))], base
    )
    out = out.withColumn("_x", _first([eed("eedly"), eed("eed"), (base.rlike(VOWEL), mended)], x))
    out = out.withColumn("_x", F.when(x.rlike(f"^.+{OTHER}[yY]$"), F.concat(_cut(x, 1), F.lit("i"))).otherwise(x))
    out = out.withColumn("_x", _endings(x, SECOND, r1))
    out = out.withColumn("_x", _endings(x, THIRD, r1, {"ative": length - 5 >= r2}))
    out = out.withColumn("_x", _endings(x, dict.fromkeys(FOURTH, ""), r2))
    last = F.when((length - 1 >= r2) | ((length - 1 >= r1) & ~_cut(x, 1).rlike(SHORT)), _cut(x, 1)).otherwise(x)
    out = out.withColumn("_x", F.when(x.endswith("e"), last).when(x.endswith("ll") & (length - 1 >= r2), _cut(x, 1)).otherwise(x))
    regular = F.when(F.char_length(word) <= 2, F.col(word)).when(F.col("_done"), F.regexp_replace(word, "s$", "")).otherwise(F.translate(x, "Y", "y"))
    known = _first([(F.col(word) == w, F.lit(s or w)) for w, s in IRREGULAR.items()], regular)
    return out.withColumn(stem, known).drop("_x", "_r1", "_r2", "_done", "_base")
