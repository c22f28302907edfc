"""Trigram similarity of short strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each padded by two spaces before and one behind."""
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where there are none."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(0.0)
