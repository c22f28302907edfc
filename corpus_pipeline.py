"""The corpus pipeline: from raw documents to token ids.

Each stage takes all rows that the stage before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.bpe import digests
from jobloom.llm.common import clear_scratch, fresh, materialise, scratch_paths, table
from jobloom.llm.decontamination import drop_contaminated
from jobloom.llm.line_dedup import dedup_lines
from jobloom.llm.ngram_join import keep_one
from jobloom.llm.quality_rules import keep_good
from jobloom.llm.vocabularies import path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule of the current policy passes."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; n_chars, where it is there, follows the text."""
    (removed,) = fresh(docs, "n_units_removed")
    out = dedup_lines(docs, removed_col=removed)
    length = F.char_length("text").cast("long")
    return out.select(*(F.when(F.col(removed) > 0, length).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return digests(docs, path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others kept. A stage's scratch tables go once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), len(scratch_paths(spark))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        *used, _output = scratch_paths(spark)[before:]
        clear_scratch(spark, used)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Byte-pair encoding has no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
