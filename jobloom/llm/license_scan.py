"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised and mapped to the identifier of a known
licence sentence, and the sequence of identifiers is matched against rules: ordered
lists of identifiers, one or more per licence. Other text may stand between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .licences import ALONE, ANCHOR, FIRST_NOTICE, KNOWN, LICENCES, NAMES, NOTICE, PART_OF, RULES, TAG

#: Where a sentence ends: white space after closing punctuation.
STOP = r"(?<=[.!?])[\x20\x09-\x0D]+"


def _marked(text: Column) -> Column:
    """Lower-case words with a space between them, or with what may end a sentence there.

    ``P``: closing punctuation, always an end. Line ends and ``L`` (after a semicolon or
    colon) may be ends or stand inside a sentence. Indentation, comment marks and frames
    hold no words, so they go; a line without words leaves two line ends.
    """
    marked = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, by in ((STOP, "P"), (r"(?<=[;:])(?=[\x20\x09-\x0D])", "L"), (r"[^a-z0-9PL\n]+", " "), (r"(?<=[PL\n])\x20|\x20(?=[PL\n])", "")):
        marked = F.regexp_replace(marked, pattern, by)
    return F.btrim(marked)


#: One inner line end of a wrapped sentence, or a space; a blank line is neither.
_BETWEEN = r"(?:\x20|L?\nL?|L)"


def _any(texts) -> str:
    """The longest come first: one may begin with another."""
    return "|".join(sorted(texts, key=len, reverse=True)).replace(" ", _BETWEEN)


#: A known sentence, tag or notice between two ends. A tag's names stand behind it in one line.
_FIND = (
    f"(?<![a-z0-9 ])(?:{_any(KNOWN)}|{TAG.replace(' ', _BETWEEN)}[a-z0-9]++(?:\\x20[a-z0-9]++)*+|{NOTICE.replace(' ', _BETWEEN)}(?:{_any(NAMES)}))(?![a-z0-9 ])"
)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences, notices and tags of a text, in the order of their places.

    A sentence may lie in one line or be wrapped anywhere, indented or commented; every
    place is looked at on its own, so one sentence's layout does not hide another. A notice
    has the identifier of the licence that it names, a tag those of all that it names.
    """
    lookup = lambda values: F.create_map(*(F.lit(v) for kv in values.items() for v in kv))
    to_id, of_name = lookup(KNOWN), lookup(NAMES)
    found = F.transform(F.regexp_extract_all(_marked(text), F.lit(_FIND), F.lit(0)), lambda s: F.regexp_replace(s, r"[L\n]+", " "))
    # "or later" is a part of a name.
    parts = lambda s: F.split(F.replace(F.substring(s, F.lit(len(TAG) + 1), F.char_length(s)), F.lit(" or later"), F.lit(" +")), " (?:or|and|with) ")
    tagged = lambda s: F.transform(parts(s), lambda x: of_name[F.replace(x, F.lit(" +"), F.lit(" or later"))])
    one = lambda s: F.array(F.coalesce(to_id[s], of_name[F.regexp_replace(s, f"^{NOTICE}", "")]))
    return F.array_compact(F.flatten(F.transform(found, lambda s: F.when(s.startswith(TAG), tagged(s)).otherwise(one(s)))))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``license_sentence_ids`` (array<int>) and ``licenses`` (sorted array<string>).

    Rules hold when their identifiers occur in order; a notice or tag names its licence. Null and empty texts have no
    sentences and no licences. Row by row, without a shuffle. New columns get a leading
    underscore where the name is taken.
    """
    ids, found = fresh(docs, "license_sentence_ids", "licenses")
    text = F.col("row")[text_col]
    anchored = F.lower(text).rlike(ANCHOR)
    line = F.concat(F.lit(","), F.array_join(F.col("ids").cast("array<string>"), ",,"), F.lit(","))
    hits = F.array(*(F.when(F.col("line").like("%" + "%".join(f",{i}," for i in seq) + "%"), F.lit(name)) for name, seq in RULES))
    noticed = F.transform(F.filter("ids", lambda i: i >= FIRST_NOTICE), lambda i: F.get(F.array(*map(F.lit, LICENCES)), i - FIRST_NOTICE))
    covered = F.array_compact(F.array(*(F.when(F.array_contains("all", whole), F.lit(part)) for part, whole in PART_OF), F.when(F.size("all") > 1, F.lit(ALONE))))
    return (
        docs.select(F.struct("*").alias("row"))
        .withColumn("ids", F.when(F.coalesce(anchored, F.lit(False)), sentence_ids(text)).otherwise(F.array().cast("array<int>")))
        .withColumn("line", line)
        .withColumn("all", F.array_sort(F.array_distinct(F.concat(F.array_compact(hits), noticed))))
        .withColumn("found", F.array_except("all", covered))
        .select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("ids").alias(ids), F.col("found").alias(found))
    )


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("license_sentence_ids").cast("long").alias("n_license_sentences"),
        F.array_join(F.col("license_sentence_ids").cast("array<string>"), ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )
