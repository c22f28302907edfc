"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The test items are indexed, cut into segments of at most SEGMENT words. Impacts are
divided by the segment's score against itself, so a score says which share of the
segment's BM25 weight a passage holds, and one threshold fits all segments. Every
document is cut into overlapping passages; every passage queries the index and gets all
segments above the threshold. A hit counts only if the passages around it hold enough of
the word n-grams of both the item's question and its answer. An item of a few words is
looked for as a phrase. In scripts without spaces every character is a word.

Weights come from all items: document frequencies, the number of segments and their mean
length are counted by Spark before anything is indexed. The items are then dealt to shards
of bounded bytes, tasks make one index file of each, and the tasks that read documents load
those files. The driver sees only the files' names, and documents are read once.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, materialise, scratch_path, table
from .shingles import ALNUM_ONLY, hash_words, text_steps, windows, Words

#: Words of a segment; a passage has twice as many and starts every SEGMENT words, so that
#: every run of SEGMENT words lies inside a passage.
SEGMENT = 64
K1, B = 1.2, 0.75
#: Share of a segment's own BM25 weight that makes a passage a hit.
THRESHOLD = 0.5
#: Share of the n-grams of question and of answer that the passages of a hit must hold.
QUESTION, ANSWER, NGRAM = 0.6, 0.6, 3
#: Items with fewer words cannot be told from ordinary phrases by weights: only a copy of all their words in order is a leak.
LEAST_WORDS = 5
#: Bytes of items in one index; blocks of an index, and segments of a block at least.
SHARD_BYTES, BLOCKS, BLOCK = 32 << 20, 256, 2
#: Indexes that a worker holds at a time. With more of them, texts are taken in groups of STEPS steps, each through all indexes.
HELD, STEPS = 4, 64
#: Room for rounding between the two ways of summing a bound.
SLACK = 1e-9

FOUND = "doc_id long, item_id long, n_passages long, score double, question_overlap double, answer_overlap double"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])\s*(?=\S)")


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; of a single sentence its last third of words."""
    head, *rest = _SENTENCE.split(text.strip())
    if rest:
        answer = rest[-1]
        return text.strip()[: -len(answer)], answer
    words = head.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _words(text: str) -> np.ndarray:
    return hash_words(pa.array([text]), ALNUM_ONLY, unspaced=True).hash


def _grams(hashes: np.ndarray, size: int = NGRAM) -> np.ndarray:
    """Distinct n-grams; a shorter run is one n-gram of all its words."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    size = min(size, len(hashes))
    return np.unique(windows(Words(1, np.zeros(len(hashes), np.int64), hashes), size)[1])


def _whole(hashes: np.ndarray) -> np.uint64:
    return windows(Words(1, np.zeros(len(hashes), np.int64), hashes), len(hashes))[1][0]


@dataclass
class Postings:
    """A term's postings in one block: segments in order, their impacts, and the largest impact."""

    segments: list[int] = field(default_factory=list)
    impacts: list[float] = field(default_factory=list)
    most: float = 0.0

    def add(self, segment: int, impact: float) -> None:
        self.segments.append(segment)
        self.impacts.append(impact)
        self.most = max(self.most, impact)


def _bags(words: np.ndarray) -> list[np.ndarray]:
    """The segments of an item's words; an item of fewer than LEAST_WORDS has none."""
    return np.array_split(words, math.ceil(len(words) / SEGMENT)) if len(words) >= LEAST_WORDS else []


@dataclass(frozen=True)
class Statistics:
    """Of all items: the number of segments, their mean length, and terms (sorted) with the number of segments that hold them."""

    segments: int
    average: float
    terms: np.ndarray
    frequency: np.ndarray


def statistics(items: Iterable[np.ndarray]) -> Statistics:
    """Statistics of items that are at hand, each the hashes of its words."""
    bags = [bag for words in items for bag in _bags(words)]
    terms, frequency = np.unique(np.concatenate([np.unique(x) for x in bags]) if bags else np.empty(0, np.uint64), return_counts=True)
    return Statistics(len(bags), max(1.0, sum(map(len, bags)) / max(1, len(bags))), terms, frequency)


class Bm25Index:
    """Inverted index of the segments of some items, with block maxima; weighted by the statistics of all items."""

    def __init__(self, items: list[tuple[int | None, str, str]], known: Statistics | None = None, block: int | None = None):
        self.items = [i for i, _, _ in items]
        self.parts = [(_grams(_words(q)), _grams(_words(a))) for _, q, a in items]
        every = [np.concatenate((_words(q), _words(a))) for _, q, a in items]
        known = known or statistics(every)
        #: Items of fewer than LEAST_WORDS words, by their number of words and the hash of them all.
        self.phrases: dict[int, dict[int, list[int]]] = {}
        for k, words in enumerate(every):
            if 0 < len(words) < LEAST_WORDS:
                self.phrases.setdefault(len(words), {}).setdefault(int(_whole(words)), []).append(k)
        bags = [(k, bag) for k, words in enumerate(every) for bag in _bags(words)]
        self.item_of = [k for k, _ in bags]
        counted = [np.unique(part, return_counts=True) for _, part in bags]
        self.vocabulary = np.unique(np.concatenate([t for t, _ in counted])) if bags else np.empty(0, np.uint64)
        frequency = known.frequency[np.searchsorted(known.terms, self.vocabulary)]
        n, average = len(bags), known.average
        idf = np.log1p((known.segments - frequency + 0.5) / (frequency + 0.5))
        self.block = block or max(BLOCK, math.ceil(n / BLOCKS))
        self.n_blocks = math.ceil(n / self.block)
        #: For each block its terms' postings.
        self.blocks: list[dict[int, Postings]] = [{} for _ in range(self.n_blocks)]
        for s, ((t, tf), (_, part)) in enumerate(zip(counted, bags, strict=True)):
            ids = np.searchsorted(self.vocabulary, t)
            impact = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / average))
            block = self.blocks[s // self.block]
            for i, x in zip(ids.tolist(), (impact / impact.sum()).tolist(), strict=True):
                block.setdefault(i, Postings()).add(s, x)
        # For the bounds of many passages at once; a term in most blocks counts alike in all.
        most: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for b, block in enumerate(self.blocks):
            for i, p in block.items():
                most[i].append((b, p.most))
        common = [2 * len(x) > self.n_blocks for x in most]
        self.everywhere = np.array([max(y for _, y in x) if c else 0.0 for x, c in zip(most, common, strict=True)])
        rows = [[] if c else x for x, c in zip(most, common, strict=True)]
        self.first = np.cumsum([0, *map(len, rows)])
        self.block_of = np.array([b for r in rows for b, _ in r], np.int64)
        self.block_most = np.array([x for r in rows for _, x in r], float)

    def term_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Term of each word; -1 for words that no item has."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def bounds(self, chunk: np.ndarray, term: np.ndarray, n_chunks: int) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk and block the sum of block maxima, and per chunk what common terms add to each block; (chunk, term) are distinct."""
        size = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        sums = np.bincount(np.repeat(chunk, size) * self.n_blocks + self.block_of[at], self.block_most[at], minlength=n_chunks * self.n_blocks)
        flat = np.bincount(chunk, self.everywhere[term], minlength=n_chunks)
        return sums.astype(float).reshape(n_chunks, self.n_blocks), flat.astype(float)

    def search(self, terms: list[int], threshold: float, blocks: Iterable[int] | None = None) -> list[tuple[int, float]]:
        """All segments whose score for the distinct ``terms`` reaches the threshold: block-max WAND.

        ``blocks``: those that may hold such a segment, by ``bounds``; without, all are looked at.
        """
        found: list[tuple[int, float]] = []
        for b in range(self.n_blocks) if blocks is None else blocks:
            lists = [[p, 0] for t in terms if (p := self.blocks[b].get(t))]
            if sum(x[0].most for x in lists) >= threshold - SLACK:
                found += self._wand(lists, threshold)
        return found

    @staticmethod
    def _wand(lists: list[list], threshold: float) -> list[tuple[int, float]]:
        """Within a block: lists in the order of their next segment; the pivot is the first segment that their maxima can lift to the threshold."""
        found = []
        here = lambda x: x[0].segments[x[1]]
        while lists:
            lists.sort(key=here)
            total = 0.0
            for pivot, x in enumerate(lists):
                total += x[0].most
                if total >= threshold - SLACK:
                    break
            else:
                break
            segment = here(lists[pivot])
            if here(lists[0]) == segment:
                score = 0.0
                for x in lists:
                    if here(x) != segment:
                        break
                    score += x[0].impacts[x[1]]
                    x[1] += 1
                if score >= threshold - SLACK:
                    found.append((segment, score))
            else:
                # Nothing before the pivot's segment can reach the threshold: all lists skip to it.
                for x in lists[:pivot]:
                    x[1] = bisect_left(x[0].segments, segment, x[1])
            lists = [x for x in lists if x[1] < len(x[0].segments)]
        return found


def _hits(index: Bm25Index, hashes: np.ndarray, text: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, list[tuple[int, float]]]]:
    """(text, first word, end, hits) of each passage with hits. Passages are two chunks of SEGMENT words."""
    if not len(hashes) or not index.n_blocks:
        return
    begin = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    lengths = np.diff(np.append(begin, len(text)))
    place = np.arange(len(text)) - np.repeat(begin, lengths)
    chunk = np.cumsum((place % SEGMENT == 0)) - 1
    n_chunks = int(chunk[-1]) + 1
    term = index.term_ids(hashes)
    known = term >= 0
    pairs = np.unique(chunk[known] * len(index.vocabulary) + term[known])
    of, term = np.divmod(pairs, len(index.vocabulary))
    sums, flat = index.bounds(of, term, n_chunks)
    chunk_begin = np.flatnonzero(place % SEGMENT == 0)
    chunk_text = text[chunk_begin]
    follows = np.zeros(n_chunks, bool)
    follows[:-1] = chunk_text[1:] == chunk_text[:-1]
    sums[:-1][follows[:-1]] += sums[1:][follows[:-1]]
    flat[:-1][follows[:-1]] += flat[1:][follows[:-1]]
    ends = np.append(chunk_begin[1:], len(text))
    term_cut = np.searchsorted(of, np.arange(n_chunks + 1))
    sums += flat[:, None]
    for c in np.flatnonzero(sums.max(axis=1) >= threshold - 2 * SLACK).tolist():
        last = c + 1 if follows[c] else c
        terms = np.unique(term[term_cut[c] : term_cut[last + 1]]).tolist()
        blocks = np.flatnonzero(sums[c] >= threshold - 2 * SLACK).tolist()
        if hits := index.search(terms, threshold, blocks):
            yield int(chunk_text[c]), int(chunk_begin[c]), int(ends[last]), hits


def _phrases(index: Bm25Index, words: Words) -> dict[tuple[int, int], set[int]]:
    """For each text and short item whose words it holds in order, the passages (by number) with all of them."""
    found: dict[tuple[int, int], set[int]] = {}
    for size, items in index.phrases.items():
        at, hashes = windows(words, size)
        for i in np.flatnonzero(np.isin(hashes, np.array(list(items), np.uint64))).tolist():
            text = int(words.text[at[i]])
            place = int(at[i] - np.searchsorted(words.text, text))
            chunk, rest = divmod(place, SEGMENT)
            passages = {chunk, chunk - 1} if chunk and rest + size <= SEGMENT else {chunk}
            for item in items[int(hashes[i])]:
                found.setdefault((text, item), set()).update(passages)
    return found


@dataclass
class Leak:
    """A text of a batch, an item that it leaks, and the evidence."""

    text: int
    item: int
    n_passages: int
    score: float
    overlaps: list[float]


def _leaks(index: Bm25Index, words: Words, threshold: float, least: tuple[float, float]) -> Iterator[Leak]:
    """Verified hits of some texts, by text and item; then the short items."""
    found: dict[tuple[int, int], tuple[dict, list]] = {}
    for text, start, end, hits in _hits(index, words.hash, words.text, threshold):
        for segment, score in hits:
            scores, spans = found.setdefault((text, index.item_of[segment]), ({}, []))
            scores[start] = max(score, scores.get(start, 0.0))
            if (start, end) not in spans[-1:]:
                spans.append((start, end))
    for (text, item), (scores, spans) in sorted(found.items()):
        lo, hi = np.searchsorted(words.text, [text, text + 1])
        # A passage and its surroundings: an n-gram may cross a passage's edge.
        near = np.unique(np.concatenate([_grams_any(words.hash[max(lo, a - SEGMENT) : min(hi, b + SEGMENT)]) for a, b in spans]))
        overlaps = [float(np.isin(grams, near).mean()) if len(grams) else 1.0 for grams in index.parts[item]]
        if all(x >= y for x, y in zip(overlaps, least, strict=True)):
            yield Leak(text, item, len(scores), max(scores.values()), overlaps)
    for (text, item), passages in sorted(_phrases(index, words).items()):
        yield Leak(text, item, len(passages), 1.0, [1.0, 1.0])


def _grams_any(hashes: np.ndarray) -> np.ndarray:
    """N-grams of a run of words in all the sizes that an item's parts may have."""
    whole = Words(1, np.zeros(len(hashes), np.int64), hashes)
    return np.concatenate([windows(whole, size)[1] for size in range(1, NGRAM + 1)])


_held: OrderedDict[str, Bm25Index] = OrderedDict()


def _load(path: str) -> Bm25Index:
    """An index of this job, kept by the worker while there is room."""
    from pyarrow import fs

    if path not in _held:
        files, name = fs.FileSystem.from_uri(path)
        with files.open_input_file(name) as file:
            index = pickle.loads(file.read())
        while len(_held) >= HELD:
            _held.popitem(last=False)
        _held[path] = index
    _held.move_to_end(path)
    return _held[path]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, n, words): segments of an item that hold a term; and without a term its segments and their words."""
    for batch in batches:
        for shard, q, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            bags = _bags(np.concatenate((_words(q), _words(a))))
            if bags:
                terms, n = np.unique(np.concatenate([np.unique(x) for x in bags]), return_counts=True)
                columns = [pa.array([*terms.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), len(bags)], pa.int64()), pa.array([0] * len(n) + [sum(map(len, bags))], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * (len(n) + 1), pa.int64()), *columns], names=["shard", "term", "n", "words"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [question_and_answer(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in parts], pa.string()) for i in (0, 1))], names=["id", "q", "a"])


def _write_index(folder: str, segments: int, average: float):
    def run(key: tuple, items: pa.Table, terms: pa.Table) -> pa.Table:
        """One shard's index file. Each attempt has a name of its own; the manifest names the one that counts."""
        import uuid

        from pyarrow import fs

        hashes = terms.column("term").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        known = Statistics(segments, average, hashes[order], terms.column("df").to_numpy()[order])
        rows = sorted(zip(*(items.column(x).to_pylist() for x in ("id", "q", "a")), strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"index-{uuid.uuid4().hex}.pickle"
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(pickle.dumps(Bm25Index(rows, known)))
        return pa.table({"path": pa.array([f"{folder}/{name}"])})

    return run


def build_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None, shard_bytes: int = SHARD_BYTES) -> list[str]:
    """Index files of all items, one for each ``shard_bytes`` of them; rows that repeat id and text count once.

    An item is never cut between files, so one that is larger makes a larger file.
    """
    spark = items.sparkSession
    key = F.col(id_col).cast("long").alias("id")
    if question_col:
        rows = items.select(key, *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((question_col, "q"), (answer_col, "a")))).distinct()
    else:
        rows = items.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct().mapInArrow(_split, "id long, q string, a string")
    rows = materialise(rows.where(F.octet_length("q") + F.octet_length("a") > 0), "bm25-items")
    total = rows.agg(F.sum(F.octet_length("q") + F.octet_length("a"))).first()[0] or 0
    if not total:
        return []
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "q", "a"), F.lit(math.ceil(total / shard_bytes))))
    counted = materialise(rows.select("shard", "q", "a").mapInArrow(_count_terms, "shard long, term long, n long, words long"), "bm25-terms")
    segments, words = counted.where(F.col("term").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    terms = counted.where(F.col("term").isNotNull())
    own = terms.select("shard", "term").distinct().join(terms.groupBy("term").agg(F.sum("n").alias("df")), "term").select("shard", "term", "df")
    made = rows.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(_write_index(scratch_path(spark, "bm25"), segments, max(1.0, words / max(1, segments))), "path string")
    return sorted(r["path"] for r in materialise(made, "bm25-manifest").collect())


def _groups(batches: Iterator[pa.RecordBatch], text: int, many: bool) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for step in text_steps(batch, text):
            held.append(step)
            if not many or len(held) >= STEPS:
                yield held
                held = []
    if held:
        yield held


def _leaks_of_steps(paths: list[str], batches: Iterator[pa.RecordBatch], text: int, threshold: float, least: tuple[float, float]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int | None, Leak]]]]:
    """Each step of the batches with the leaks of its texts and the items' ids, through all indexes."""
    for steps in _groups(batches, text, len(paths) > HELD):
        words = [hash_words(step.column(text), ALNUM_ONLY, unspaced=True) for step in steps]
        found: list[list] = [[] for _ in steps]
        for path in paths:
            index = _load(path)
            for out, w in zip(found, words, strict=True):
                out += [(index.items[x.item], x) for x in _leaks(index, w, threshold, least)]
        yield from zip(steps, found, strict=True)


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", question_col: str | None = None,
    answer_col: str | None = None, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_passages, score, question_overlap, answer_overlap): one row per document row and item it leaks.

    ``n_passages`` counts the passages that retrieved the item, ``score`` is the best. Items
    come with question and answer columns or with one text (see ``question_and_answer``).
    Items of fewer than LEAST_WORDS words are leaked by a copy of all their words in order,
    with score and overlaps 1. Items without any word are left out; null and empty
    documents leak nothing; null ids are kept; repeated rows are each reported; empty tables
    on either side give no rows. Other columns are not read. Items that repeat id and text
    count once. Documents are read once and are not shuffled.
    """
    spark = docs.sparkSession
    importable(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    paths = build_indexes(items, item_id_col, item_text_col, question_col, answer_col, shard_bytes)
    return texts.mapInArrow(_report(paths, threshold, (question, answer)), FOUND)


def _report(paths: list[str], threshold: float, least: tuple[float, float]):
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, found in _leaks_of_steps(paths, batches, 1, threshold, least):
            if found:
                ids = step.column(0).to_pylist()
                rows = [(ids[x.text], item, x.n_passages, x.score, *x.overlaps) for item, x in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _without(paths: list[str], place: int, threshold: float, least: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, found in _leaks_of_steps(paths, batches, place, threshold, least):
            clean = np.ones(step.num_rows, bool)
            clean[[x.text for _, x in found]] = False
            yield step.filter(pa.array(clean))

    return run


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", question_col: str | None = None, answer_col: str | None = None,
    threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` without the rows whose text leaks an item, decided row by row, without a shuffle.

    Null and empty texts stay. All columns stay as they are. ``text_col`` is a string column.
    """
    importable(docs.sparkSession)
    place = docs.columns.index(text_col)
    paths = build_indexes(items, item_id_col, item_text_col, question_col, answer_col, shard_bytes)
    return docs.mapInArrow(_without(paths, place, threshold, (question, answer)), docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_passages", *(F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")))
