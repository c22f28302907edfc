"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its evidence comes from binned measurements of the line itself
and of the lines before and after it; the chain adds how labels follow one another.
Forward-backward gives each line's probability of being good; their mean, weighted by the
lines' lengths, is the document's quality, which a logistic curve makes a probability.

Only documents have labels; the lines' are latent. All lines of a good document are good.
A line of a bad one is bad unless lines like it, looked at alone, stand in good documents
more than in bad ones; its least likely line is bad in any case. The chain is trained on
these labels, so its links learn where labels change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, table
from .shingles import hash_words, shingle_sets, text_steps

#: Bound of the training sample: labelled documents, and bytes and lines of one of them; 80 MB of measurements at most.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_LINES = 4000, 1 << 16, 1000
FOLDS, CUT = 5, 0.3
#: Training: passes, step size, and the weight of the squared parameters for each line.
PASSES, RATE, RIDGE = 120, 0.1, 1e-4

#: Upper edges of the bins of each measurement; below all edges is bin 0.
EDGES: dict[str, tuple[float, ...]] = {
    "words": (0, 2, 7, 20, 60),
    "bytes_per_word": (2, 4, 6, 8, 12),
    "symbols_per_word": (0, 0.05, 0.2, 0.5, 1.5),
    "bars_per_word": (0, 0.05, 0.2, 0.5),
    "exclamations_per_word": (0, 0.05, 0.3, 1),
    "capitals_of_letters": (0, 0.05, 0.15, 0.5),
    "digits_of_bytes": (0, 0.02, 0.1, 0.4),
    "punctuation_per_word": (0, 0.05, 0.15, 0.4, 1),
    "repeats_of_words": (0, 0.1, 0.3, 0.6),
    "distinct_of_words": (0.1, 0.3, 0.5, 0.7, 0.9),
    "same_as_a_line_before": (0,),
}
N_BINS = max(len(x) for x in EDGES.values()) + 2
#: The bin of a neighbour that is not there.
NO_LINE = N_BINS - 1

_CLASSES = {
    "symbols": set(b"#*$%&<>=~^@_\\{}[]+"),
    "bars": set(b"|"),
    "exclamations": set(b"!"),
    "punctuation": set(b".,;:?"),
    "capitals": set(range(65, 91)),
    "letters": {*range(65, 91), *range(97, 123), *range(128, 256)},
    "digits": set(range(48, 58)),
}
_IN = {name: np.array([i in members for i in range(256)]) for name, members in _CLASSES.items()}


class Lines(NamedTuple):
    """Lines of several texts: where each text's lines begin, bins (line x measurement), and bytes."""

    begin: np.ndarray
    bins: np.ndarray
    weight: np.ndarray


def measure_lines(column: pa.Array) -> Lines:
    """The lines (split at \\n) of each text; a null or empty text is one empty line."""
    parts = pc.split_pattern(pc.fill_null(column, "") if column.null_count else column, "\n")
    begin = parts.offsets.to_numpy().astype(np.int64)
    lines = parts.flatten()
    begin -= begin[0]
    words = hash_words(lines)
    n = np.bincount(words.text, minlength=len(lines))
    per = np.maximum(n, 1)
    offsets = np.frombuffer(lines.buffers()[1], np.int64 if pa.types.is_large_string(lines.type) else np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    raw = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets -= offsets[0]
    size = np.diff(offsets)

    def count(name: str) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(_IN[name][raw], dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    seen = np.bincount(words.text[again], minlength=len(lines))
    distinct, _, _ = shingle_sets(words, 1)
    # A line's fingerprint is the order-sensitive sum of its words; blank lines repeat nothing.
    place = np.arange(len(words.hash)) - np.repeat(np.cumsum(n) - n, n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hash * (2 * place.astype(np.uint64) + np.uint64(1)))))
    ends = np.cumsum(n)
    prints = sums[ends] - sums[ends - n]
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((np.arange(len(lines)), prints, text))
    copy = np.zeros(len(lines), bool)
    same = (prints[order][1:] == prints[order][:-1]) & (text[order][1:] == text[order][:-1]) & (n[order][1:] > 0)
    copy[order[1:][same]] = True
    values = {
        "words": n,
        "bytes_per_word": size / per,
        "symbols_per_word": count("symbols") / per,
        "bars_per_word": count("bars") / per,
        "exclamations_per_word": count("exclamations") / per,
        "capitals_of_letters": count("capitals") / np.maximum(count("letters"), 1),
        "digits_of_bytes": count("digits") / np.maximum(size, 1),
        "punctuation_per_word": count("punctuation") / per,
        "repeats_of_words": seen / per,
        "distinct_of_words": np.where(n > 0, distinct / per, 1.0),
        "same_as_a_line_before": copy.astype(float),
    }
    bins = np.stack([np.searchsorted(EDGES[name], values[name], side="left") for name in EDGES], axis=1).astype(np.uint8)
    return Lines(begin, bins, (size + 1).astype(float))


def _neighbours(lines: Lines) -> np.ndarray:
    """Bins of the line before, of the line, and of the line after: (3, line, measurement)."""
    out = np.full((3, *lines.bins.shape), NO_LINE, np.uint8)
    out[1] = lines.bins
    if len(lines.bins):
        first = np.zeros(len(lines.bins), bool)
        first[lines.begin[:-1][np.diff(lines.begin) > 0]] = True
        inner = np.flatnonzero(~first)
        out[0][inner] = lines.bins[inner - 1]
        out[2][inner - 1] = lines.bins[inner]
    return out


def forward_backward(evidence: np.ndarray, begin: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability that each line is good, expected label pairs, sum of log partitions).

    ``evidence``: log odds that a line is good on its own; ``links``: 2 x 2 log weights of
    (label, next label). Step t handles the t-th line of every text that has one.
    """
    lengths = np.diff(begin)
    order = np.argsort(-lengths, kind="stable")
    lengths, start = lengths[order], begin[:-1][order]
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    half = np.clip(evidence, -60, 60) / 2
    own = np.exp(np.stack((-half, half), axis=1))
    step = np.exp(links)
    ahead, scale = np.empty_like(own), np.ones(len(own))
    for t in range(longest):
        at = start[: alive[t]] + t
        x = own[at] if t == 0 else (ahead[at - 1] @ step) * own[at]
        scale[at] = x.sum(axis=1)
        ahead[at] = x / scale[at, None]
    back = np.ones_like(own)
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = start[: alive[t]] + t
        y = back[at] * own[at] / scale[at, None]
        back[at - 1] = y @ step.T
        pairs += step * (ahead[at - 1].T @ y)
    good = ahead * back
    return good[:, 1] / good.sum(axis=1), pairs, float(np.log(scale).sum())


@dataclass
class LineCrf:
    """Weights of (neighbour, measurement, bin), label links, and the logistic curve of the final score."""

    weights: np.ndarray
    bias: float
    links: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def evidence(self, near: np.ndarray) -> np.ndarray:
        kinds = np.arange(near.shape[2])
        return self.bias + sum(self.weights[k][kinds, near[k]].sum(axis=1) for k in range(3))

    def good_lines(self, lines: Lines) -> np.ndarray:
        """The probability that each line is good."""
        return forward_backward(self.evidence(_neighbours(lines)), lines.begin, self.links)[0]

    def quality(self, lines: Lines) -> np.ndarray:
        """Length-weighted share of good lines of each text."""
        good = self.good_lines(lines)
        total = lambda x: np.add.reduceat(x, lines.begin[:-1]) if len(lines.begin) > 1 else np.empty(0)
        return total(good * lines.weight) / total(lines.weight)

    def score(self, lines: Lines) -> np.ndarray:
        q = np.clip(self.quality(lines), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.shift)))


def _ascend(start: np.ndarray, gradient, passes: int, rate: float) -> np.ndarray:
    """Adam."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, passes + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return x


def line_labels(lines: Lines, labels: np.ndarray, passes: int = PASSES, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """The latent label (True: good) of each line, from the labels (1 or 0) of the texts.

    A logistic regression of the documents' labels on single lines gives how much more often
    a line like this stands in a good document.
    """
    of_line = np.repeat(labels, np.diff(lines.begin)).astype(float)
    if not len(of_line):
        return of_line > 0
    kinds = len(EDGES)
    flat = np.arange(kinds) * N_BINS + lines.bins
    odds = lambda x: x[:-1][flat].sum(axis=1) + x[-1]

    def gradient(x: np.ndarray) -> np.ndarray:
        off = of_line - 1 / (1 + np.exp(-odds(x)))
        return np.append(np.bincount(flat.ravel(), np.repeat(off, kinds), minlength=kinds * N_BINS), off.sum()) / len(of_line) - ridge * x

    alone = odds(_ascend(np.zeros(kinds * N_BINS + 1), gradient, passes, rate))
    share = np.clip(of_line.mean(), 1e-6, 1 - 1e-6)
    good = (of_line > 0) | (alone > np.log(share / (1 - share)))
    text = np.repeat(np.arange(len(labels)), np.diff(lines.begin))
    order = np.lexsort((np.arange(len(alone)), alone, text))
    worst = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))]
    good[worst[of_line[worst] == 0]] = False
    return good


def fit(lines: Lines, labels: np.ndarray, passes: int = PASSES, rate: float = RATE, ridge: float = RIDGE) -> LineCrf:
    """Maximum penalised likelihood of the latent line labels under the documents' ``labels`` (1 or 0 for each text).

    With one label only, or no text, scores are that share of ones as far as the penalty lets them.
    """
    near = _neighbours(lines)
    shape = (3, len(EDGES), N_BINS)
    size = int(np.prod(shape))
    of_line = line_labels(lines, labels, passes, rate, ridge).astype(float)
    inner = np.ones(len(of_line), bool)
    inner[lines.begin[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (of_line[at - 1].astype(int), of_line[at].astype(int)), 1)
    flat = [(np.arange(shape[1]) * N_BINS + near[k]).ravel() for k in range(3)]
    n = max(1, len(of_line))

    def model(x: np.ndarray) -> LineCrf:
        return LineCrf(x[:size].reshape(shape), x[size], x[size + 1 :].reshape(2, 2))

    def gradient(x: np.ndarray) -> np.ndarray:
        crf = model(x)
        good, pairs, _ = forward_backward(crf.evidence(near), lines.begin, crf.links)
        off = of_line - good
        by_bin = np.concatenate([np.bincount(f, np.repeat(off, shape[1]), minlength=shape[1] * N_BINS) for f in flat])
        return np.concatenate((by_bin, [off.sum()], (seen - pairs).ravel())) / n - ridge * x

    crf = model(_ascend(np.zeros(size + 5), gradient, passes, rate)) if len(of_line) else model(np.zeros(size + 5))
    if len(labels):
        q = np.clip(crf.quality(lines), 1e-6, 1 - 1e-6)
        odds = np.log(q / (1 - q))

        def curve(x: np.ndarray) -> np.ndarray:
            off = labels - 1 / (1 + np.exp(-(x[0] * odds + x[1])))
            return np.array([(off * odds).mean(), off.mean()]) - 1e-3 * (x - [1, 0])

        crf.slope, crf.shift = _ascend(np.array([1.0, 0.0]), curve, 300, 0.05)
    return crf


def _fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, sample_lines: int = SAMPLE_LINES) -> LineCrf:
    """Fits a model on at most ``sample_docs`` labelled documents of at most ``sample_bytes`` bytes and ``sample_lines`` lines.

    The sample is, but for longer ones, the labelled documents outside fold 0 with the smallest id hashes. Only
    their line measurements reach the driver. Null ids and labels are left out; of a
    document with several labels the lowest counts. Ties in the hash are broken by the id.
    """
    importable(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (_fold(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.octet_length(F.coalesce("_text", F.lit(""))) <= sample_bytes)
    texts = texts.where(F.char_length(F.coalesce("_text", F.lit(""))) - F.char_length(F.replace(F.coalesce("_text", F.lit("")), F.lit("\n"), F.lit(""))) < sample_lines)
    # At most sample_docs rows of two numbers.
    sample = texts.join(F.broadcast(known), "_id").select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                lines = measure_lines(step.column(1))
                cut = list(zip(lines.begin[:-1].tolist(), lines.begin[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [step.column(0).cast(pa.int32()), pa.array([lines.bins[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([lines.weight[a:b].astype("<f8").tobytes() for a, b in cut], pa.binary())],
                    names=["label", "bins", "weight"],
                )

    # An order of its own makes the sums, and so the model, the same in every run.
    rows = sample.mapInArrow(run, "label int, bins binary, weight binary").orderBy(F.xxhash64("bins", "weight", "label")).limit(sample_docs).toArrow()
    bins = [np.frombuffer(x, np.uint8).reshape(-1, len(EDGES)) for x in rows.column("bins").to_pylist()]
    weight = [np.frombuffer(x, "<f8") for x in rows.column("weight").to_pylist()]
    begin = np.cumsum([0, *map(len, weight)])
    lines = Lines(begin, np.concatenate(bins) if bins else np.empty((0, len(EDGES)), np.uint8), np.concatenate(weight) if weight else np.empty(0))
    return fit(lines, np.array(rows.column("label").to_pylist(), float))


def score_texts(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability that a whole text is good, row by row, without a shuffle.

    A null or empty text is one empty line and has a score like any other; repeated rows
    get equal scores; an empty table gives no rows. Other columns are not read.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(model.score(measure_lines(step.column(1))))], names=[id_col, "score"])

    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def label_lines(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, good, probability): the label of every line of every text, lines counted from 0.

    A null or empty text is one empty line. Each repeated row has lines of its own.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                lines = measure_lines(step.column(1))
                many, good = np.diff(lines.begin), model.good_lines(lines)
                ids = step.column(0).take(pa.array(np.repeat(np.arange(len(many)), many)))
                place = np.arange(len(good)) - np.repeat(lines.begin[:-1], many)
                yield pa.RecordBatch.from_arrays([ids, pa.array(place.astype(np.int32)), pa.array(good >= 0.5), pa.array(good)], names=[id_col, "line", "good", "probability"])

    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, line int, good boolean, probability double")


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model).select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
