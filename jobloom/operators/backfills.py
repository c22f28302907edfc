"""Backfills: a stored table rewritten range by range, so that a run that was stopped goes on where it ended.

    folder/ranges/             (range, low, high): cuts of the ids, made once
    folder/work/range=K/       what a batch is writing
    folder/table/range=K/      finished batches
    folder/progress/range=K/   (range, rows, changed)

A batch is finished by renaming its folder, which happens or does not; whatever a stopped batch left is written again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text
from ..sources import store
from .feed import as_of_column

#: Where postings of the vendor whose lists have no links are found.
PUBLIC_BASE = "https://jobs.smartrecruiters.com"
ABSENCES = 2

Rewrite = Callable[[DataFrame], DataFrame]


def posting_urls(postings: DataFrame, sources: DataFrame, base: str = PUBLIC_BASE, vendor: str = "smartrecruiters") -> DataFrame:
    """101. Missing links of a vendor's postings, from board and id; ``sources`` has (id, vendor, board_token)."""
    boards = sources.where(F.col("vendor") == vendor).select(F.col("id").alias("source_id"), F.col("board_token").alias("_board"))
    # A side that grows with the boards is shuffled: the driver never holds it.
    joined = postings.join(boards.hint("merge"), "source_id", "left")
    known = (F.coalesce("_board", F.lit("")) != "") & (F.coalesce("external_id", F.lit("")) != "")
    link = F.when(known, F.concat_ws("/", F.lit(base), "_board", "external_id"))
    filled = lambda c: F.when(known, F.coalesce(F.nullif(c, F.lit("")), link)).otherwise(F.col(c)).alias(c)
    return joined.select(*(filled(c) if c in ("apply_url", "posting_url") else F.col(c) for c in postings.columns))


def close_absent(postings: DataFrame, as_of: str | Column, limit: int = ABSENCES) -> DataFrame:
    """102. Live postings that were missed ``limit`` times are closed."""
    gone = F.coalesce((F.col("status") == "live") & (F.col("missing_count") >= limit), F.lit(False))
    values = {"status": F.when(gone, "closed").otherwise(F.col("status")), "closed_at": F.when(gone, as_of_column(as_of)).otherwise(F.col("closed_at"))}
    return postings.select(*(values[c].alias(c) if c in values else F.col(c) for c in postings.columns))


def skill_counts(posting_skills: DataFrame) -> DataFrame:
    """(id, n): the number of skills of each posting that has any."""
    return posting_skills.groupBy(F.col("posting_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def classify_fields(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """103. Field, its confidence and its reason, from the title and the number of skills (``skill_counts``, stored where ranges share it)."""
    guessed = postings.join(counts.select("id", F.col("n").alias("_n")).hint("merge"), "id", "left").withColumn("_x", text.classify_field(F.col("title"), F.coalesce("_n", F.lit(0))))
    values = {"field": F.col("_x.field"), "field_confidence": F.col("_x.confidence"), "field_because": F.col("_x.because")}
    return guessed.select(*(values[c].alias(c) if c in values else F.col(c) for c in postings.columns))


def reparse_locations(postings: DataFrame) -> DataFrame:
    """104 and, with wider tables of places, 106. Places of postings without a country whose text names one; what cannot be read stays null."""
    asked = F.col("country").isNull() & (F.coalesce("location_raw", F.lit("")) != "")
    read = postings.withColumn("_p", F.when(asked, extract.place(F.col("location_raw"))))
    found = F.coalesce(F.col("_p.country"), F.lit("")) != ""
    return read.select(*(F.when(found, F.nullif(F.col(f"_p.{c}"), F.lit(""))).otherwise(F.col(c)).alias(c) if c in ("country", "region", "city") else F.col(c) for c in postings.columns))


@dataclass
class Backfill:
    """A rewrite of a table by ranges of its long ``key``, which is unique; rows keep their columns, also one that the rewrite does not know."""

    spark: SparkSession
    folder: str
    batch_rows: int = 5_000_000
    key: str = "id"

    def _ranges(self, table: DataFrame) -> list[tuple[int, int | None, int | None]]:
        """(range, low exclusive, high inclusive), from the first run's cuts. One row for each batch reaches the driver."""
        path = f"{self.folder}/ranges"
        if not store.exists(self.spark, f"{path}/_SUCCESS"):
            n = -(-table.count() // self.batch_rows)
            cuts = sorted(set(table.select(F.col(self.key).cast("double")).approxQuantile(self.key, [i / n for i in range(1, n)], 0.001))) if n > 1 else []
            edges = [None, *(int(c) for c in cuts), None]
            rows = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            self.spark.createDataFrame(rows, "range int, low long, high long").coalesce(1).write.mode("overwrite").parquet(path)
        return sorted(tuple(r) for r in self.spark.read.parquet(path).collect())

    def done(self) -> list[int]:
        return sorted(int(x.split("=")[1]) for x in store.children(self.spark, f"{self.folder}/table") if x.startswith("range="))

    def run(self, table: DataFrame, rewrite: Rewrite, before_commit: Callable[[int], None] | None = None) -> DataFrame:
        """The table after ``rewrite`` of all its ranges; finished ones are not touched again. ``before_commit`` may stop a run, in tests."""
        finished = set(self.done())
        store.make(self.spark, f"{self.folder}/table")
        for k, low, high in self._ranges(table):
            if k in finished:
                continue
            at = F.col(self.key)
            inside = F.lit(True) if low is None else at > low
            inside &= F.lit(True) if high is None else at <= high
            # Rows without a key go with the first range.
            batch = table.where(inside | at.isNull() if low is None else inside)
            work = f"{self.folder}/work/range={k}"
            # A row carries the hash of what it was, so what changed is counted as it is written and no side of a join goes through the driver.
            values = F.xxhash64(*(c for c in table.columns if c != self.key))
            after = rewrite(batch.withColumn("_was", values))
            seen = Observation()
            counted = after.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_was") != values).alias("changed"))
            counted.select(*table.columns).write.mode("overwrite").parquet(work)
            row = (k, seen.get.get("rows", 0), seen.get.get("changed", 0))
            self.spark.createDataFrame([row], "range int, rows long, changed long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/progress/part={k}")
            if before_commit:
                before_commit(k)
            if not store.rename(self.spark, work, f"{self.folder}/table/range={k}"):
                raise RuntimeError(f"range {k} was finished by another run")
        return self.table(table)

    def table(self, like: DataFrame) -> DataFrame:
        """What is finished so far, with the schema of ``like``."""
        paths = [f"{self.folder}/table/range={k}" for k in self.done()]
        return self.spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)

    def progress(self) -> DataFrame:
        """(range, rows, changed) of the finished ranges."""
        paths = [f"{self.folder}/progress/part={k}" for k in self.done()]
        return self.spark.read.schema("range int, rows long, changed long").parquet(*paths)
