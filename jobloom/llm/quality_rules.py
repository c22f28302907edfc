"""Quality rules: a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
integer whose bit r says that rule r failed; policies are masks over those bits, so a
new policy, or the question what a rule costs, never reads a text again. The names of the
rules, in the order of their bits, travel with the ledger as metadata of ``fail_bits``,
through Parquet too: what a bit means is read from the ledger and nowhere else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, materialise, table, text_or_empty, words_of

#: Characters that prose hardly uses.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; it must not be null."""

    name: str
    fails: str


#: The usual rules; a rule's position is its bit in the ledgers made with them.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 25 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines AND n_lines >= 4"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("shouting", "100 * n_capitals > 40 * word_chars"),
    Rule("exclamations", "100 * n_exclamations > 40 * n_words"),
)

#: Policies by version: the rules that reject a document. Old versions stay.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "strict-1": tuple(rule.name for rule in RULES),
}
POLICY = "strict-1"


def rule_names(ledger: DataFrame) -> list[str]:
    """The rules that a ledger holds, in the order of their bits."""
    return list(ledger.schema["fail_bits"].metadata["rules"])


def mask_of(ledger: DataFrame, policy: str | Sequence[str]) -> int:
    """The bits, in this ledger, of a policy version or of a list of rule names; a rule that it doesn't hold is an error."""
    names = rule_names(ledger)
    wanted = set(POLICIES[policy] if isinstance(policy, str) else policy)
    if missing := wanted - set(names):
        raise ValueError(f"the ledger has no rule {sorted(missing)[0]}")
    return sum(1 << i for i, name in enumerate(names) if name in wanted)


def _repeat_words(ids: Column, order: Column) -> Column:
    """Words inside a three-word window that the document holds twice or more.

    ``ids``: the windows' hashes in order; ``order``: (hash, position) structs, sorted.
    Equal windows are neighbours in ``order``; the covered words follow from the gaps
    between the repeated windows' sorted positions, so the work is n log n in the words.
    """
    n = F.size(order)
    twice = F.filter(
        order, lambda x, i: (x["h"] == F.get(order, i - 1)["h"]).eqNullSafe(True) | ((i + 1 < n) & (x["h"] == F.get(order, i + 1)["h"]).eqNullSafe(True))
    )
    return F.array_sort(F.transform(twice, lambda x: x["p"]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and measurements of every whole text; a null text counts as empty."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    hashes = F.when(
        F.size("_words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    # Only a text that repeats a window at all pays for the sort.
    ordered = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    length = lambda drop: F.char_length(F.translate(text, drop, ""))
    return (
        docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
        .select(
            id_col,
            words_of(text).alias("_words"),
            lines.alias("_lines"),
            length(WHITE).cast("long").alias("word_chars"),
            (F.char_length(text) - length(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.char_length(text) - length("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
            (F.char_length(text) - length("!")).cast("long").alias("n_exclamations"),
        )
        .withColumn("_hashes", hashes)
        .withColumn("_order", ordered)
        .withColumn("_at", _repeat_words(F.col("_hashes"), F.col("_order")))
        .select(
            id_col,
            F.size("_words").cast("long").alias("n_words"),
            "word_chars",
            "n_symbols",
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            "n_capitals",
            "n_exclamations",
        )
    )


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements and ``fail_bits`` (long), one row per input row, in one pass without a shuffle.

    At most 63 rules, each with a name of its own. Null and empty texts have no words and fail ``few_words``; repeated rows are each
    measured; an empty table gives no rows. Only the id and text columns are read.
    """
    names = [rule.name for rule in rules]
    if len(names) > 63 or len(set(names)) < len(names):
        raise ValueError("a ledger takes up to 63 rules with different names")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    measured = measure(docs, id_col, text_col)
    return measured.select("*", bits.alias("fail_bits", metadata={"rules": names}))


def store_ledger(ledger: DataFrame, path: str) -> DataFrame:
    """Writes a ledger as Parquet and reads it back."""
    ledger.write.parquet(path)
    return read_ledger(ledger.sparkSession, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def passes(ledger: DataFrame, policy: str | Sequence[str]) -> Column:
    """Whether a row of this ledger passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(ledger, policy)).cast("long")) == 0


def apply_policies(ledger: DataFrame, policies: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """One boolean column per policy."""
    return ledger.select("*", *(passes(ledger, p).alias(name) for name, p in policies.items()))


def ablations(ledger: DataFrame, policy: str | Sequence[str] = POLICY) -> DataFrame:
    """For each rule of a policy: documents it fails, those it alone rejects, and what is kept without it.

    The texts are gone by now: rows collapse to at most 2^rules distinct bit patterns.
    """
    mask = mask_of(ledger, policy)
    rules = [(name, 1 << i) for i, name in enumerate(rule_names(ledger)) if mask >> i & 1]
    patterns = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    hit, bit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")), F.col("x.bit")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    every = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(b).cast("long").alias("bit")) for name, b in rules))
    # A row of no documents for each rule, so that an empty ledger has all rules too.
    none = ledger.sparkSession.range(1).select(F.lit(0).cast("long").alias("fail_bits"), F.lit(0).cast("long").alias("n"))
    spread = patterns.unionByName(none).select(F.explode(every).alias("x"), hit.alias("hit"), "n")
    return spread.groupBy(F.col("x.rule").alias("rule")).agg(
        some(F.col("hit").bitwiseAND(bit) != 0).alias("n_fail"),
        some(F.col("hit") == bit).alias("n_only"),
        some(F.col("hit").bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str | Sequence[str] = POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with all their columns.

    The ledger keeps the row itself as its id, so no join is needed.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    ledger = rule_ledger(docs.select(row, F.col(text_col).alias("_body")), "_row", "_body")
    # A filter would be pushed below the ledger and repeat its expressions; a generator's output is not.
    kept = ledger.select(F.explode_outer(F.when(passes(ledger, policy), F.array("_row"))).alias("_kept"))
    return kept.where(F.col("_kept").isNotNull()).select("_kept.*")


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = materialise(rule_ledger(table(spark, sf_dir, "documents")), "rule-ledger")
    base_failed = ~passes(ledger, "base-1")
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & passes(ledger, POLICY)).alias("kept"), "fail_bits"
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy costs, over all documents."""
    return ablations(materialise(rule_ledger(table(spark, sf_dir, "documents")), "rule-ledger"))
