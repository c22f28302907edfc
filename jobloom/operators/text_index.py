"""An inverted text index with places, kept as written segments.

    folder/hits/segment=K/bucket=B/    (term, id, title, body), buckets by a hash of the term
    folder/documents/segment=K/        (id, there): the documents that a segment speaks of

A segment has the new hits of its documents; in a document that a later segment names,
older hits count no more. So a change costs a segment of the changed documents, readers merge segments
with a list of later changes, and ``compact`` writes one segment from all. A segment is
complete when its documents are written, which comes last; an incomplete one is overwritten.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.search import HITS, TASK_HITS, dealt_hits
from ..sources import store

BUCKETS = 64
#: Hits of a file, about: a bucket with a frequent term is written as several.
FILE_ROWS = 4_000_000


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    @classmethod
    def build(cls, rows: DataFrame, folder: str, title: str = "title", body: str = "description_text", id_col: str = "id", buckets: int = BUCKETS) -> TextIndex:
        """An index of all ``rows``; ids are unique. The folder is new."""
        index = cls(rows.sparkSession, folder, buckets)
        index.apply(rows, title, body, id_col)
        return index

    def segments(self) -> list[int]:
        """Complete segments, oldest first."""
        names = [x for x in store.children(self.spark, f"{self.folder}/documents") if x.startswith("segment=")]
        return sorted(int(x.split("=")[1]) for x in names if store.exists(self.spark, f"{self.folder}/documents/{x}/_SUCCESS"))

    def _deal(self, n: int) -> dict[str, Column]:
        """Where a hit is written: files of a bucket are split by document, so that no task writes all hits of a term."""
        files = max(1, -(-n // FILE_ROWS))
        return {"bucket": F.pmod(F.crc32("term"), F.lit(self.buckets)).cast("int"), "slot": F.pmod(F.xxhash64("id"), F.lit(files))}

    def _write(self, dealt: DataFrame, documents: DataFrame, segment: int) -> None:
        rows = dealt.select("term", "id", "title", "body", "bucket").sortWithinPartitions("bucket", "term", "id")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/hits/segment={segment}")
        documents.write.mode("overwrite").parquet(f"{self.folder}/documents/segment={segment}")

    def apply(self, changed: DataFrame | None, title: str = "title", body: str = "description_text", id_col: str = "id", removed: DataFrame | None = None) -> int:
        """Adds a segment with the texts of new and changed rows and the ids (``id``) of removed ones; gives its number."""
        segment = max(self.segments(), default=-1) + 1
        gone = [removed.select(F.col("id").cast("long").alias("id"), F.lit(False).alias("there"))] if removed is not None else []
        if changed is None:
            hits, documents = self.spark.createDataFrame([], HITS).withColumns(self._deal(0)), []
        else:
            hits = dealt_hits(changed, id_col, title, body, self._deal)
            documents = [changed.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("there"))]
        every = [*documents, *gone]
        self._write(hits, every[0] if len(every) == 1 else every[0].unionByName(every[1]), segment)
        return segment

    def _documents(self, segments: list[int]) -> DataFrame:
        rows = self.spark.read.schema("id long, there boolean, segment int").option("basePath", f"{self.folder}/documents")
        return rows.parquet(*(f"{self.folder}/documents/segment={k}" for k in segments))

    def ids(self) -> DataFrame:
        """(id): all documents of the index."""
        segments = self.segments()
        if len(segments) == 1:
            return self._documents(segments).where("there").select("id")
        last = self._documents(segments).groupBy("id").agg(F.max_by("there", F.struct("segment", "there")).alias("there"))
        return last.where("there").select("id")

    def hits(self, terms: list[str] | None = None) -> DataFrame:
        """The current hit list of some terms, read from their buckets only, or of all."""
        segments = self.segments()
        if not segments:
            return self.spark.createDataFrame([], HITS)
        with_data = [k for k in segments if any(x.startswith("bucket=") for x in store.children(self.spark, f"{self.folder}/hits/segment={k}"))]
        if not with_data:
            return self.spark.createDataFrame([], HITS)
        rows = self.spark.read.schema(f"{HITS}, segment int, bucket int").option("basePath", f"{self.folder}/hits").parquet(*(f"{self.folder}/hits/segment={k}" for k in with_data))
        if terms is not None:
            rows = rows.where(F.col("bucket").isin(*{zlib.crc32(t.encode()) % self.buckets for t in terms}) & F.col("term").isin(*terms))
        if len(segments) > 1:
            # The first segment makes no other out of date.
            later = self._documents(segments[1:]).groupBy("id").agg(F.max("segment").alias("newest"))
            rows = rows.join(later, "id", "left").where(F.col("newest").isNull() | (F.col("segment") >= F.col("newest")))
        rows = rows.select("term", "id", "title", "body")
        # The hits of a query meet by document, in tasks of a bounded number.
        return rows if terms is None else rows.repartition(max(1, -(-rows.count() // TASK_HITS)), "id")

    def compact(self) -> int:
        """Writes all current hits and documents as one segment; earlier ones stay until ``vacuum``, for readers that are under way."""
        segment = max(self.segments(), default=-1) + 1
        hits, documents = store.written(self.hits(), "index-hits"), store.written(self.ids().withColumn("there", F.lit(True)), "index-documents")
        n = hits.count()
        dealt = hits.withColumns(self._deal(n)).repartition(max(1, -(-n // TASK_HITS)), "bucket", "slot")
        self._write(dealt, documents, segment)
        return segment

    def vacuum(self, before: int) -> None:
        """Deletes the segments before one that ``compact`` wrote."""
        for k in self.segments():
            if k < before:
                store.delete(self.spark, f"{self.folder}/documents/segment={k}")
                store.delete(self.spark, f"{self.folder}/hits/segment={k}")
