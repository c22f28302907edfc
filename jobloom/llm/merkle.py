"""Merkle dataset manifest: one root digest for a table, and a proof for each of its rows.

Every row is a leaf. The leaves of a group stand in a total order; each run of eight
consecutive nodes becomes its parent until one node is left, the group's subroot, and the
subroots stand in a tree of their own. Levels are written tables. A proof goes the other
way: children meet their parents, and each child puts its own siblings before the proof
that its parent has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise, table

#: Children of a node.
FAN = 8
#: What a leaf digests, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, a colon and the value: no two lists of values read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(**instead: Column) -> Column:
    """Digest of a row's FIELDS; ``instead`` replaces some of them."""
    return digest(*(encoded(instead.get(c, F.col(c))) for c in FIELDS))


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (g, h, ...) with ``i``, their place from 0 in the order of their group ``g``, and ``n``, the group's size.

    Ranges of (g, order) are sorted apart and written with a running number; a table of one row per
    range and group says how many come before. No task sorts a whole group.
    """
    at = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_at", F.monotonically_increasing_id())
    at = materialise(at, name).withColumn("_part", F.shiftright("_at", 33))
    parts = at.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy("g")
    before = F.sum("_m").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_m")
    parts = parts.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_m").over(w).alias("n"))
    return at.join(parts, ["g", "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def levels_above(first: DataFrame, name: str) -> list[DataFrame]:
    """The levels of the trees of all groups, from the written ``first`` (g, i, n, h) upwards; a group ends where it has one node."""
    levels = [first]
    widest = first.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        grouped = levels[-1].where("n > 1").groupBy("g", F.expr(f"i div {FAN}").alias("i"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n")).agg(kids.alias("kids"))
        levels.append(materialise(grouped.withColumn("h", F.sha2(F.array_join("kids", ""), 256)), f"{name}-{len(levels)}"))
        widest = math.ceil(widest / FAN)
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """(g, h): the one node that each group ends in."""
    out = levels[0].where("n = 1").select("g", "h")
    for level in levels[1:]:
        out = out.unionByName(level.where("n = 1").select("g", "h"))
    return out


def proofs_below(levels: list[DataFrame], inherited: DataFrame) -> DataFrame:
    """The lowest level with ``proof``, steps (left, right) from a node up to where ``inherited`` (g, proof) ends.

    ``left`` and ``right`` are the joined digests of the siblings on that side.
    """
    above = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        down = level.where("n = 1").join(inherited, "g")
        if above is not None:
            parent = above.select("g", F.col("i").alias("_up"), F.col("kids").alias("_kids"), F.col("proof").alias("_rest"))
            place = F.pmod("i", F.lit(FAN)).cast("int")
            step = F.struct(F.array_join(F.slice("_kids", F.lit(1), place), "").alias("left"), F.array_join(F.slice("_kids", place + 2, F.lit(FAN)), "").alias("right"))
            met = level.where("n > 1").withColumn("_up", F.expr(f"i div {FAN}")).join(parent, ["g", "_up"])
            down = down.unionByName(met.withColumn("proof", F.concat(F.array(step), "_rest")).drop("_up", "_kids", "_rest"))
        above = down
    return above


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


@dataclass
class Manifest:
    """Written levels of the groups' trees and of the tree of their subroots, and the root (None: no rows)."""

    levels: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """The leaves (kept columns, g, i, n, h) with ``proof``: steps from the leaf to the root."""
        none = F.array().cast("array<struct<left:string,right:string>>")
        ends = self.top[-1].where("n = 1").select("g", none.alias("proof")).limit(1)
        of_group = proofs_below(self.top, ends).select(F.col("group").alias("g"), "proof")
        return proofs_below(self.levels, of_group)


def build_manifest(leaves: DataFrame, group: str, order: list[str]) -> Manifest:
    """The manifest of ``leaves``: a digest ``h`` for each row, the column ``group``, and what else is to be kept.

    A group's leaves ascend by ``order``, then by digest; groups ascend by their value, null first,
    text by UTF-8 bytes. Equal rows are leaves of their own and stand side by side. A table
    without rows has no root. Only digests, keys and kept columns are shuffled, never texts.
    """
    # Digests are computed once: range partitioning reads its input twice.
    leaves = materialise(leaves.withColumn("g", encoded(F.col(group))), "merkle-leaves")
    levels = levels_above(materialise(numbered(leaves, [*order, "h"], "merkle-order"), "merkle-0"), "merkle")
    subroots = materialise(roots_of(levels), "merkle-subroots")
    value = F.when(F.col("g") != "-", F.substring_index("g", ":", 1))
    named = subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "h", F.when(value.isNotNull(), F.substr("g", F.char_length(value) + 2)).cast(leaves.schema[group].dataType).alias("_value"))
    top = levels_above(materialise(numbered(named, ["_value"], "merkle-groups").drop("_value"), "merkle-top-0"), "merkle-top")
    last = roots_of(top).first()
    return Manifest(levels, top, subroots, last["h"] if last else None)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded from rows of which a third are tampered with.

    Null values have a digest of their own; a null id is never tampered with. Other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = F.when(tampered, leaf_digest(text=F.translate(F.col("text"), CAPITALS, CAPITALS.lower())))
    manifest = build_manifest(docs.select("doc_id", "lang", leaf_digest().alias("h"), lower.alias("changed")), "lang", ["doc_id"])
    found = manifest.proofs().join(manifest.subroots.select("g", F.col("h").alias("subroot")), "g")
    root = F.lit(manifest.root).cast("string")
    out = found.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), F.sha2(F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), ""), 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "h"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
