"""Line deduplication over overlapping windows of three lines.

Every run of three consecutive lines is hashed. A window that the corpus holds more
than once stays where it comes first; the lines of every later occurrence are covered,
overlapping cover is merged, and the covered lines go.

A line of over LONG words counts as several: it is cut behind the ends of its sentences,
and after PIECE words at the latest. So a repeated long line or paragraph holds windows
of its own, whatever stands around it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, fresh, hot_keys, hot_rows, materialise, split_join, table

WINDOW = 3
#: Words up to which a line is one unit, and words of a unit of a longer line at most.
LONG, PIECE = 50, 16

_IN, _OUT = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: A line of over LONG words; it begins at the line's start only, so a search is linear.
LONG_LINE = rf"\A{_OUT}*(?:{_IN}+{_OUT}+){{{LONG}}}{_IN}"
#: A unit of a long line: words that end no sentence, and one more word.
UNIT = rf"{_OUT}*(?:{_IN}*[^\x20\x09-\x0D.!?]{_OUT}+){{0,{PIECE - 1}}}{_IN}+{_OUT}*"


def _units_of(line: Column) -> Column:
    long = (F.char_length(line) > 2 * LONG) & line.rlike(LONG_LINE)
    return F.when(long, F.regexp_extract_all(line, F.lit(UNIT), F.lit(0))).otherwise(F.array(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and however deep inside lambdas it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bare(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def _text_hash(text: Column) -> Column:
    """60 bits of the text, by which rows that share an id are told apart and ordered."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def window_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text hash, position, two hashes) of every window of non-blank, trimmed units.

    Positions count non-blank units. Two 64-bit hashes stand for a window.
    """
    units = F.filter(F.transform(F.flatten(F.transform(_lines(F.col(text_col)), _units_of)), _bare), lambda x: x != "")
    parts = lambda i: [F.get("_units", i + k) for k in range(window)]
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_units") - window), lambda i: F.struct(i.alias("pos"), F.xxhash64(*parts(i)).alias("h1"), F.xxhash64(F.lit("second"), *parts(i)).alias("h2"))
    )
    return (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("th"), units.alias("_units"))
        .where(F.size("_units") >= window)
        .select("id", "th", F.inline(windows))
    )


def later_occurrences(occurrences: DataFrame) -> DataFrame:
    """(id, th, pos) of each occurrence of a repeated window but its first, by id, text hash and position.

    A window that a large share of documents hold has one row in the table of repeated
    windows but a large share of the rows to be looked up: these are not shuffled.
    """
    at = F.struct("id", "th", "pos")
    repeated = materialise(occurrences.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-windows")
    hot = hot_keys(repeated, ["h1", "h2"], "n", hot_rows(occurrences.sparkSession, occurrences.count()))
    return split_join(occurrences, repeated, ["h1", "h2"], hot).where(~at.eqNullSafe(F.col("first"))).select("id", "th", "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, removed_col: str = "n_units_removed") -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut from the text, and ``n_units_removed``.

    Units (lines, or pieces of long lines) compare without outer white space. Blank lines are
    in no window and stay; what is left of a line stays in one line. A text of fewer than
    three non-blank units, a null text and a row with a null id stay as they are. Rows that
    repeat both id and text count as one document; of other rows with one id the order is
    that of a hash of their texts. Every row stays, even with an emptied text. The new column
    gets a leading underscore if the name is taken.
    """
    (removed,) = fresh(docs, removed_col)
    occurrences = materialise(window_occurrences(docs, id_col, text_col, window), "line-windows")
    cover = later_occurrences(occurrences).groupBy(F.col("id").alias("cid"), F.col("th").alias("cth")).agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    # Covered positions, merged: a window adds only units that the window before it left.
    covered = F.flatten(
        F.transform(
            "starts", lambda p, i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: p + k), lambda q: (i == 0) | (q >= F.get("starts", i - 1) + window))
        )
    )
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("rid"), _text_hash(F.col(text_col)).alias("rth"))
    text = F.col("row").getField(text_col)
    units = F.flatten(F.transform(_lines(text), lambda x, i: F.transform(_units_of(x), lambda u: F.struct(i.alias("line"), u.alias("raw")))))
    solid = lambda u: F.filter(F.transform(u, lambda x, i: F.when(_bare(x["raw"]) != "", i)), lambda i: i.isNotNull())
    left = lambda u, cut: F.transform(F.array_except(F.sequence(F.lit(0), F.size(u) - 1), cut), lambda i: F.get(u, i))
    joined = lambda x: F.array_join(F.transform(x, lambda u, i: F.concat(F.when((i == 0) | (u["line"] == F.get(x, i - 1)["line"]), "").otherwise("\n"), u["raw"])), "")
    cut_out = lambda u, cut: F.struct(_once(left(u, cut), joined).alias("text"), F.size(cut).alias("n"))
    result = _once(
        units,
        lambda u: _once(
            F.struct(u.alias("units"), solid(u).alias("solid"), covered.alias("covered")),
            lambda s: _once(F.struct(s["units"].alias("units"), F.transform(s["covered"], lambda p: F.get(s["solid"], p)).alias("cut")), lambda t: cut_out(t["units"], t["cut"])),
        ),
    )
    hit = F.col("starts").isNotNull()
    out = rows.join(cover, (F.col("rid") == F.col("cid")) & (F.col("rth") == F.col("cth")), "left").withColumn("result", F.when(hit, result))
    return out.select(
        *(F.when(hit, F.col("result.text")).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns),
        F.coalesce("result.n", F.lit(0)).cast("long").alias(removed),
    )


def op9_window_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_units_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
