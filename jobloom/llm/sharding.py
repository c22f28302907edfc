"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a pseudo-random score that depends on nothing else;
a record goes to the shard with the highest score. A shard that is added can only
win records for itself, and one that is taken away only gives up its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty

#: Rows numbered together in one group; the number of groups grows with the table.
SLOT_GROUP = 65_536


def _key(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("<null>"))


def _bits(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """Score -w / ln(u), u uniform in (0, 1): wins in proportion to the weight."""
    u = (_bits(F.concat(key, F.lit(f"#{shard}")), 13) + F.lit(0.5)) / F.lit(float(2**52))
    return -F.lit(float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, minus): the winning score and minus the shard; ties go to the lower shard."""
    scored = [F.struct(shard_score(key, s, w).alias("score"), F.lit(-s).alias("minus")) for s, w in enumerate(weights)]
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def assign_shards(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0, slot_group: int = SLOT_GROUP
) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to the key column.

    ``slot`` numbers the rows of a shard gaplessly from 0. Rows are numbered inside
    hashed groups of about ``slot_group`` rows and shifted by the rows of the groups
    before, so no shard is ever sorted in one task. Rows that are equal in key and text are
    counted and travel as one row for each ``slot_group`` of them, each in a group of its own.

    A null key hashes as its own key; a null text has size 1 and the crc of no bytes.
    Repeated rows share a shard and get slots of their own; an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    if not weights or min(*weights, grown_weight) <= 0:
        raise ValueError("weights must be positive")
    key, text = _key(F.col(key_col)), F.encode(text_or_empty(text_col), "UTF-8")
    best, more = F.col("_best"), F.col("_more")
    columns = [key_col, "size", "text_crc32", "shard", "grown_shard", "_key"]
    rows = (
        docs.select(F.col(key_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("_key"))
        .withColumn("_best", rendezvous(F.col("_key"), weights))
        .withColumn("_more", shard_score(F.col("_key"), len(weights), grown_weight))
        .withColumn("shard", (-best["minus"]).cast("int"))
        .withColumn("grown_shard", F.when(more > best["score"], F.lit(len(weights))).otherwise(F.col("shard")).cast("int"))
    )
    # One row per key and text, read again for the counts and for the numbering.
    rows = materialise(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "shard-rows")
    groups = max(1, -(-(rows.agg(F.sum("_n")).first()[0] or 0) // slot_group))
    part = F.explode(F.sequence(F.lit(0), F.expr(f"int((_n - 1) div {slot_group})")))
    parts = rows.select(*columns, "_n", part.alias("_part")).withColumn("_m", F.least(F.lit(slot_group), F.col("_n") - F.col("_part") * slot_group))
    place = F.concat(F.col("_key"), F.lit("@"), F.col("text_crc32"), F.when(F.col("_part") > 0, F.concat(F.lit("#"), F.col("_part"))).otherwise(""))
    parts = parts.withColumn("_group", _bits(place, 8) % groups)
    counts = parts.groupBy("shard", "_group").agg(F.sum("_m").alias("_all"))
    before = counts.select("shard", "_group", (F.sum("_all").over(Window.partitionBy("shard").orderBy("_group")) - F.col("_all")).alias("_before"))
    within = Window.partitionBy("shard", "_group").orderBy(key_col, "size", "text_crc32", "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        parts.withColumn("_end", F.sum("_m").over(within))
        .join(before, ["shard", "_group"])
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
        .select(key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_end") - F.col("_m") + F.col("_i")).cast("long").alias("slot"), "grown_shard")
    )


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
