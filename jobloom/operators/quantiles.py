"""Exact quantiles without a state for each group: range partitions and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def exact_quantiles(rows: DataFrame, group: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """(group, n, one column for each name): linearly interpolated quantiles of the values that are not null.

    Rows are dealt to ranges of (group, value) and numbered inside each; a row for every range and group
    says how many stand before it. So the values of a group, however many, are sorted by many tasks, and only
    the two around each quantile are kept. Groups of null keys count as groups.
    """
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"_k{i}") for i, g in enumerate(group)] + [F.isnull(g).alias(f"_n{i}") for i, g in enumerate(group)]
    own = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"), *keys)
    names = [c for c in own.columns if c.startswith(("_k", "_n"))]
    at = own.repartitionByRange(*names, "_v").sortWithinPartitions(*names, "_v").withColumn("_at", F.monotonically_increasing_id())
    at = store.written(at, "quantiles").withColumn("_part", F.shiftright("_at", 33))
    parts = at.groupBy(*names, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m"), *(F.first(g).alias(g) for g in group))
    w = Window.partitionBy(*names)
    before = F.sum("_m").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_m")
    parts = parts.select(*names, "_part", *group, (before - F.col("_first")).alias("_shift"), F.sum("_m").over(w).alias("n"))
    # Which ranks are wanted from each range; a range that holds none is not read on.
    rank = {q: (F.col("n") - 1) * F.lit(p) for q, p in probabilities.items()}
    placed = at.drop(*group).join(parts, [*names, "_part"]).withColumn("_i", F.col("_at") + F.col("_shift"))
    near = placed.where(F.greatest(*(F.abs(F.col("_i") - r) < 1 for r in rank.values()), F.lit(False)))
    share = lambda r: F.sum(F.when(F.abs(F.col("_i") - r) < 1, F.col("_v") * (1 - F.abs(F.col("_i") - r))))
    out = near.groupBy(*names).agg(*(F.first(g).alias(g) for g in group), F.max("n").alias("n"), *(share(r).alias(q) for q, r in rank.items()))
    return out.select(*group, "n", *probabilities)
