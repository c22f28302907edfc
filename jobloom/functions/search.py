"""Text search: web-style queries over postings of stemmed terms, with their places, and the rank of the hits.

A hit list has (term, id, title, body): the places of a term in a document's title and body,
counted over both; stop words have a place but no term. It comes from a ``TextIndex``, or from the rows
themselves where there is none.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import written
from .stemming import STOP, split_words, with_stems

# Weights of the title and of the body, the sum of 1/k^2, the reach of two terms and how closeness counts.
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
SQUARES = 1.64493406685
REACH, FAR = 100, 1e-20
NEAR_BASE, NEAR_SLOPE, NEAR_SCALE, NEAR_SHIFT = 1.005, 0.05, 1.5, 2.0
#: Hits of a task, about: arrays of places compress well, so the size of shuffled data says little about memory.
TASK_HITS = 500_000
#: Distinct words of which a broadcast may hold the stems: under 100 MB.
BROADCAST_WORDS = 1_000_000

HITS = "term string, id long, title array<int>, body array<int>"


@dataclass(frozen=True)
class Part:
    """Terms that must stand (or not stand) in a document, one or a phrase; ``gaps`` are the places from each to the next."""

    negated: bool
    terms: tuple[str, ...]
    gaps: tuple[int, ...] = ()


@dataclass(frozen=True)
class Query:
    """Alternatives of conjunctions."""

    alternatives: tuple[tuple[Part, ...], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({t for a in self.alternatives for p in a for t in p.terms})

    @property
    def by_nearness(self) -> bool:
        """Whether all terms are asked for together; then their nearness makes the rank, not their number."""
        joint = len(self.alternatives) == 1 and (len(self.alternatives[0]) > 1 or (not self.alternatives[0][0].negated and len(self.alternatives[0][0].terms) > 1))
        return joint and len(self.terms) > 1


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


#: Stems of words that queries asked for before.
_asked: dict[str, str] = {}


def stems(spark: SparkSession, words: set[str]) -> dict[str, str]:
    """Stems of a query's words, by the expressions that stem the documents."""
    if new := sorted(words - _asked.keys()):
        _asked.update({r["word"]: r["term"] for r in with_stems(spark.createDataFrame([(w,) for w in new], "word string")).collect()})
    return {w: _asked[w] for w in words}


def parse(spark: SparkSession, query: str) -> Query:
    """Words are asked for together, ``or`` separates alternatives, ``-`` excludes, quotes make a phrase.

    A word that splits into several is a phrase of them. Stop words count as places of a phrase
    only. A query without any other word has no alternatives and matches nothing.
    """
    raw: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            raw.append([])
        elif found := _words(phrase or word):
            raw[-1].append((bool(minus), found))
    known = stems(spark, {w for a in raw for _, p in a for w in p if w not in STOP})
    alternatives = []
    for a in raw:
        parts = []
        for negated, words in a:
            at = [(i, known[w]) for i, w in enumerate(words) if w in known]
            if at:
                parts.append(Part(negated, tuple(t for _, t in at), tuple(b - a for (a, _), (b, _) in zip(at, at[1:], strict=False))))
        if parts:
            alternatives.append(tuple(parts))
    return Query(tuple(alternatives))


def word_places(rows: DataFrame, id_col: str, title: str, body: str) -> DataFrame:
    """(id, word, place, in_title): every word but stop words; the body's places go on from the title's last one."""
    listed = lambda col, words: F.filter(F.transform(F.col(words), lambda w, i: F.struct(w.alias("word"), (i + 1).cast("int").alias("at"), F.lit(col == "title").alias("in_title"))), lambda x: ~x["word"].isin(*STOP))
    cut = rows.select(F.col(id_col).cast("long").alias("id"), split_words(F.col(title)).alias("_t"), split_words(F.col(body)).alias("_b"))
    both = cut.select("id", listed("title", "_t").alias("_t"), listed("body", "_b").alias("_b")).withColumn("_end", F.coalesce(F.array_max("_t.at"), F.lit(0)))
    each = both.select("id", "_end", F.explode(F.concat("_t", "_b")).alias("x"))
    return each.select("id", "x.word", F.when(F.col("x.in_title"), F.col("x.at")).otherwise(F.col("x.at") + F.col("_end")).alias("place"), "x.in_title")


def _stemmed(rows: DataFrame, id_col: str, title: str, body: str, terms: list[str] | None = None) -> tuple[DataFrame, int]:
    """(id, word, place, in_title, term) of each word that has a term, or one of some terms, and how many words there are."""
    words = word_places(rows, id_col, title, body)
    known = with_stems(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # Written first: a filter on stems would be pushed through all their steps and grow with each.
    known = written(known, "stems")
    known = known.where(F.col("term").isin(*terms)) if terms is not None else known
    size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = known.select("word", "term")
    return words.join(F.broadcast(known) if size[0] <= BROADCAST_WORDS else known, "word"), size[1]


def _merged(words: DataFrame, *keys: str) -> DataFrame:
    """``keys``, title and body: the ordered places. Those of the title come before all of the body, so one list is cut in two."""
    lists = words.groupBy(*keys).agg(F.sort_array(F.collect_list("place")).alias("_p"), F.count_if("in_title").cast("int").alias("_n"))
    return lists.select(*keys, F.slice("_p", F.lit(1), F.col("_n")).alias("title"), F.slice("_p", F.col("_n") + 1, F.size("_p") - F.col("_n")).alias("body"))


def hits_of(rows: DataFrame, id_col: str, title: str, body: str, terms: list[str] | None = None) -> DataFrame:
    """The hit list of ``rows``, of all terms or of some."""
    return _stemmed(rows, id_col, title, body, terms)[0].transform(_merged, "term", "id")


def dealt_hits(rows: DataFrame, id_col: str, title: str, body: str, deal) -> DataFrame:
    """The hit list of ``rows`` in the groups of ``deal`` (a number of words -> columns over term and id, by name): words are shuffled once, and hits are made where they are written."""
    stemmed, n = _stemmed(rows, id_col, title, body)
    keys = deal(n)
    dealt = stemmed.withColumns(keys).select(*keys, "term", "id", "place", "in_title").repartition(max(1, -(-n // TASK_HITS)), *keys)
    return _merged(dealt, *keys, "term", "id")


def _holds(part: Part, column: dict[str, str]) -> Column:
    """Whether a document has all of a part's terms, and a phrase's in their places."""
    there = reduce(lambda a, b: a & b, (F.col(column[t]).isNotNull() for t in part.terms))
    if len(part.terms) > 1:
        places = lambda t: F.concat(F.col(column[t])["title"], F.col(column[t])["body"])
        run = places(part.terms[0])
        for gap, term in zip(part.gaps, part.terms[1:], strict=True):
            run = F.array_intersect(F.transform(run, lambda p: p + gap), places(term))  # noqa: B023
        there &= F.size(run) > 0
    there = F.coalesce(there, F.lit(False))
    return ~there if part.negated else there


def _count_rank(column: dict[str, str]) -> Column:
    """The more hits of a term, the better, each one less than the one before; averaged over the terms."""

    def of(name: str) -> Column:
        n, m = F.size(F.col(name)["title"]), F.size(F.col(name)["body"])
        part = lambda low, high, weight: F.when(high > low, F.aggregate(F.sequence(low + 1, high), F.lit(0.0), lambda a, k: a + F.lit(weight) / (k.cast("double") * k))).otherwise(0.0)
        return F.coalesce((part(F.lit(0), n, TITLE_WEIGHT) + part(n, n + m, BODY_WEIGHT)) / SQUARES, F.lit(0.0))

    total = sum((of(c) for c in column.values()), F.lit(0.0)) / len(column)
    return F.when(total > 0, total).otherwise(FAR)


def _near_rank(matched: DataFrame, column: dict[str, str]) -> DataFrame:
    """(id, rank): every pair of places of two terms counts, the nearer the more. Pairs farther than REACH apart count nothing.

    Places meet inside their document by stretch of REACH places, so a long document is many short rows and nothing is shuffled.
    """
    weighed = lambda c, k, part, weight: F.coalesce(F.transform(F.col(c)[part], lambda p: F.struct(p.alias("p"), F.lit(weight).alias("w"), F.lit(k).alias("k"))), F.array().cast("array<struct<p:int,w:double,k:int>>"))
    every = F.concat(*(weighed(c, k, part, weight) for k, c in enumerate(column.values()) for part, weight in (("title", TITLE_WEIGHT), ("body", BODY_WEIGHT))))
    block = lambda x: F.floor(x["p"] / REACH)
    cut = matched.select("id", every.alias("_e")).select("id", "_e", F.explode_outer(F.array_distinct(F.transform("_e", block))).alias("_b"))
    met = cut.select("id", F.filter("_e", lambda x: block(x) == F.col("_b")).alias("_a"), F.filter("_e", lambda x: F.abs(block(x) - F.col("_b")) <= 1).alias("_o"))
    far = lambda a, o: F.abs(a["p"] - o["p"])
    near = lambda a, o: F.sqrt(a["w"] * o["w"] / (NEAR_BASE + NEAR_SLOPE * F.exp(far(a, o) / NEAR_SCALE - NEAR_SHIFT)))
    others = lambda a: F.filter("_o", lambda o: (o["k"] > a["k"]) & (far(a, o) > 0) & (far(a, o) <= REACH))
    of_block = F.aggregate("_a", F.lit(0.0), lambda total, a: total + F.aggregate(others(a), F.lit(0.0), lambda s, o: s + F.log(1 - near(a, o))))
    # Every pair's logarithm is below 0, so 0 means none.
    total = met.select("id", of_block.alias("x")).groupBy("id").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))
    return total.select("id", F.when(F.col("x") < 0, 1 - F.exp("x")).otherwise(FAR).alias("rank"))


def find(hits: DataFrame, query: Query, ids: DataFrame | None = None) -> DataFrame:
    """(id, rank) of the documents that match. ``hits`` holds at least the query's terms.

    ``ids`` (id), all documents, is asked for only where an alternative does nothing but exclude.
    """
    spark = hits.sparkSession
    if not query.alternatives:
        return spark.createDataFrame([], "id long, rank double")
    column = {t: f"t{i}" for i, t in enumerate(query.terms)}
    own = hits.where(F.col("term").isin(*query.terms))
    wide = own.groupBy("id").agg(*(F.first(F.when(F.col("term") == t, F.struct("title", "body")), ignorenulls=True).alias(c) for t, c in column.items()))
    if any(all(p.negated for p in a) for a in query.alternatives):
        if ids is None:
            raise ValueError("a query that only excludes needs all ids")
        wide = ids.select("id").join(wide, "id", "left")
    match = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (_holds(p, column) for p in a)) for a in query.alternatives))
    matched = wide.where(match)
    if not query.by_nearness:
        return matched.select("id", _count_rank(column).alias("rank"))
    return _near_rank(matched, column)


def search(rows: DataFrame, query: str, title: str = "title", body: str = "description_text", index=None) -> DataFrame:
    """Rows (with ``id``) that match, with ``rank``. With an ``index`` of their texts no text is read."""
    plan = parse(rows.sparkSession, query)
    if index is not None:
        found = find(index.hits(plan.terms), plan, index.ids())
    else:
        found = find(hits_of(rows, "id", title, body, plan.terms), plan, rows.select("id"))
    return rows.join(found, "id")


def nearness(distance: float) -> float:
    """What two title places at a distance add, for tests and notes."""
    return math.sqrt(1 / (NEAR_BASE + NEAR_SLOPE * math.exp(distance / NEAR_SCALE - NEAR_SHIFT)))
