"""Language identification: a linear-chain conditional random field over the words of a text.

Every word, a run of letters, has a language. Its evidence comes from its beginnings and endings
(affixes), its letter n-grams and a lexicon of words with the languages they are at home in;
learned links say how languages follow one another, so that a text that switches
between languages is cut where it switches. Forward-backward gives each word's
probabilities; their sum over all words, weighted by letters, says the text's language.

Only texts have labels. Training sequences are joined from pieces of texts of the same and of other
languages, and a word's label is the one of its piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, importable, table
from .shingles import text_steps

#: Bound of the training sample: texts in all and texts of a language at least, pieces of a text and words of a piece.
SAMPLE_DOCS, LEAST_DOCS, PIECES, PIECE_WORDS = 3000, 20, 3, 12
FOLDS = 5
UNKNOWN = "und"
#: A longer run of letters is cut into words of this many.
LONGEST_WORD = 32
#: Hashed weights for each language, and what lexicon entries need.
BUCKETS, LEAST_SEEN = 1 << 16, 3
#: Lexicon bins: log odds of a word's best language against the rest; bin 0 has words that the lexicon lacks.
ODDS = (0.5, 1.5, 3.0)
PASSES, RATE, RIDGE = 30, 0.15, 1e-5
#: Code points whose features are held at a time.
SEGMENT = 1 << 20
#: Words of a chunk of the chain; chunks are passed side by side.
CHUNK = 64

_letter: list[np.ndarray] = []
_PLACE = np.random.default_rng(20).integers(1, 1 << 62, LONGEST_WORD, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter[0]


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    y = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))) * _MIX
    y ^= y >> np.uint64(29)
    y *= np.uint64(0xBF58476D1CE4E5B9)
    return y ^ (y >> np.uint64(32))


class Words(NamedTuple):
    """Words of several texts: where each text's words begin, their letters' count, place in the texts' code points and hashes, and features (word, bucket)."""

    begin: np.ndarray
    letters: np.ndarray
    start: np.ndarray
    key: np.ndarray
    of: np.ndarray
    bucket: np.ndarray


class Labelled(NamedTuple):
    """Words of several texts: where each text's begin, letters, places in code points, and (word, language) probabilities."""

    begin: np.ndarray
    letters: np.ndarray
    start: np.ndarray
    chance: np.ndarray


def _segment_end(text: str, at: int) -> int:
    """Where a segment of a long text ends: between words, or inside a word that is longer than a tenth of a segment."""
    end = at + SEGMENT
    if end >= len(text):
        return len(text)
    least = end - SEGMENT // 10
    while end > least and text[end - 1].isalpha() and text[end].isalpha():
        end -= 1
    return end


def read_words(texts: list[str]) -> Words:
    """The words of each text in order, in lower case; a mark between texts keeps them apart."""
    # Lower case that keeps the count of code points, so that places hold in the text.
    joined = "\n".join(texts)
    low = joined.lower()
    if len(low) != len(joined):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in joined)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    at = np.flatnonzero(is_letter()[code])
    if not len(at):
        none = np.empty(0, np.int64)
        return Words(np.zeros(len(texts) + 1, np.int64), none, none, none.astype(np.uint64), none, none)
    run = np.concatenate(([True], at[1:] != at[:-1] + 1))
    run_start = np.flatnonzero(run)
    inside = np.arange(len(at)) - np.repeat(run_start, np.diff(np.append(run_start, len(at))))
    opens = inside % LONGEST_WORD == 0
    place = inside % LONGEST_WORD
    head = np.flatnonzero(opens)
    letters = np.diff(np.append(head, len(at)))
    word = np.cumsum(opens) - 1
    # Letters with a mark on both sides of a word: n-grams never join two words.
    c = code[at].astype(np.uint64) + np.uint64(1)
    zero = np.zeros(1, np.uint64)
    last = np.concatenate((opens[1:], [True]))
    before = np.where(opens, np.uint64(0), np.concatenate((zero, c[:-1])))
    after = np.where(last, np.uint64(0), np.concatenate((c[1:], zero)))
    two = c << np.uint64(21) | after
    three = before << np.uint64(42) | two
    key = np.add.reduceat(_hash(c * _PLACE[place], 9), head)
    size = letters
    tails = head + size - 1
    reach = lambda x, back: np.where(size > back, x, np.uint64(0))
    nxt = lambda k: np.minimum(head + k, len(c) - 1)
    prv = lambda k: np.maximum(tails - k, 0)
    prefix = c[head] << np.uint64(42) | reach(c[nxt(1)], 1) << np.uint64(21) | reach(c[nxt(2)], 2)
    suffix = c[tails] << np.uint64(42) | reach(c[prv(1)], 1) << np.uint64(21) | reach(c[prv(2)], 2)
    prefix4, suffix4 = prefix ^ _hash(reach(c[nxt(3)], 3), 7), suffix ^ _hash(reach(c[prv(3)], 3), 8)
    words = np.arange(len(head))
    features = [_hash(two, 1), _hash(three, 2), _hash(prefix, 3), _hash(suffix, 4), _hash(prefix4, 5), _hash(suffix4, 6)]
    of = np.concatenate((word, word, words, words, words, words))
    bucket = (np.concatenate(features) % np.uint64(BUCKETS)).astype(np.int64)
    start = at[head]
    text = np.searchsorted(first, start, side="right") - 1
    begin = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts)))))
    return Words(begin, letters, start - first[text], key, of, bucket)


def forward_backward(score: np.ndarray, begin: np.ndarray, links: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word, label) probabilities, and the expected pairs of neighbouring labels if asked for.

    ``score``: log evidence (word, label); ``links``: log weights (label, next label). Texts are cut into
    chunks. What a chunk does to the chain is a product of matrices, taken for all chunks side by
    side; these join the chunks of a text, and then each chunk's words are done, again side by side.
    """
    n, k = score.shape
    out, expected = np.ones((n, k)), np.zeros((k, k))
    lengths = np.diff(begin)
    many = -(-lengths // CHUNK)
    total = int(many.sum())
    if not total:
        return out, expected
    text = np.repeat(np.arange(len(many)), many)
    rank = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    start = begin[:-1][text] + rank * CHUNK
    size = np.minimum(CHUNK, lengths[text] - rank * CHUNK)
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(CHUNK), side="left")
    own = np.exp(score - score.max(axis=1, keepdims=True))
    step = np.exp(links - links.max())
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    # entry: forward weights before a chunk's first link; leave: backward weights after its last word.
    entry, leave = np.ones((total, k)), np.ones((total, k))
    longer = np.flatnonzero(many > 1)
    if len(longer):
        turn = np.empty((total, k, k))
        for t in range(int(size.max())):
            who = order[: alive[t]]
            e = own[start[who] + t][:, None, :]
            m = (np.where((rank[who] == 0)[:, None, None], np.eye(k), step) if t == 0 else turn[who] @ step) * e
            turn[who] = m / m.sum(axis=(1, 2), keepdims=True)
        base = np.cumsum(many) - many
        for r in range(1, int(many.max())):
            here = base[many > r] + r
            entry[here] = norm((entry[here - 1][:, None, :] @ turn[here - 1])[:, 0], 1)
        for r in range(int(many.max()) - 1, 0, -1):
            here = base[many > r] + r
            leave[here - 1] = norm((turn[here] @ leave[here][:, :, None])[:, :, 0], 1)
    ahead = np.empty((n, k))
    for t in range(int(size.max())):
        who = order[: alive[t]]
        at = start[who] + t
        came = np.where((rank[who] == 0)[:, None], 1.0, entry[who] @ step) if t == 0 else ahead[at - 1] @ step
        ahead[at] = norm(came * own[at], 1)
    back = leave.copy()
    for t in range(int(size.max()) - 1, -1, -1):
        who = order[: alive[t]]
        at = start[who] + t
        out[at] = norm(ahead[at] * back[who], 1)
        right = own[at] * back[who]
        if pairs:
            inner = np.ones(len(who), bool) if t else rank[who] > 0
            left = (ahead[at - 1] if t else entry[who])[inner]
            both = left[:, :, None] * step * right[inner][:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        if t:
            back[who] = norm(right @ step.T, 1)
    return out, expected


@dataclass
class LanguageCrf:
    """Languages in order, weights (bucket, language) with the lexicon's bins behind them, links, and the lexicon by word hash."""

    languages: list[str]
    weights: np.ndarray
    links: np.ndarray
    lexicon: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    entry: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def rows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, row of the weights) of all features: hashed ones, the lexicon's bin and one for every word."""
        n = len(words.letters)
        bins = np.zeros(n, np.int64)
        if len(self.lexicon) and n:
            at = np.minimum(np.searchsorted(self.lexicon, words.key), len(self.lexicon) - 1)
            bins = np.where(self.lexicon[at] == words.key, self.entry[at], 0)
        every = np.arange(n)
        return np.concatenate((words.of, every, every)), np.concatenate((words.bucket, BUCKETS + 1 + bins, np.full(n, BUCKETS)))

    def evidence(self, words: Words) -> np.ndarray:
        of, row = self.rows(words)
        n = len(words.letters)
        return np.stack([np.bincount(of, self.weights[row, j], minlength=n) for j in range(len(self.languages))], axis=1) if n else np.empty((0, len(self.languages)))

    def label(self, texts: list[str]) -> Labelled:
        """The words of whole texts with their probabilities. Features are held for one segment at a time."""
        parts, owner, shift = [], [], []
        for i, text in enumerate(texts):
            at = 0
            while at < len(text) or at == 0:
                end = _segment_end(text, at)
                parts.append(text[at:end])
                owner.append(i)
                shift.append(at)
                at = max(end, 1)
        steps, held = [[]], 0
        for i, part in enumerate(parts):
            if held and held + len(part) > SEGMENT:
                steps.append([])
                held = 0
            steps[-1].append(i)
            held += len(part)
        counts, letters, start, score = [], [], [], []
        for step in steps:
            words = read_words([parts[i] for i in step])
            n = np.diff(words.begin)
            counts.append(n)
            letters.append(words.letters)
            start.append(words.start + np.repeat(np.array([shift[i] for i in step], np.int64), n))
            score.append(self.evidence(words))
        by_text = np.bincount(np.array(owner, np.int64), np.concatenate(counts), minlength=len(texts)).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(by_text)))
        return Labelled(begin, np.concatenate(letters), np.concatenate(start), forward_backward(np.concatenate(score), begin, self.links)[0])

    def shares(self, found: Labelled) -> np.ndarray:
        """(text, language): the share of its letters; zeros for a text without any."""
        p = found.chance * found.letters[:, None]
        sums = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)))
        own = sums[found.begin[1:]] - sums[found.begin[:-1]]
        return own / np.maximum(own.sum(axis=1, keepdims=True), 1e-300)


def build_lexicon(key: np.ndarray, label: np.ndarray, k: int, least: int = LEAST_SEEN) -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, bins): words seen ``least`` times or more, with the language they are most at home in and how much."""
    known, at = np.unique(key, return_inverse=True)
    seen = np.zeros((len(known), k))
    np.add.at(seen, (at, label), 1)
    known, seen = known[seen.sum(axis=1) >= least], seen[seen.sum(axis=1) >= least]
    share = (seen + 0.5) / (seen + 0.5).sum(axis=1, keepdims=True) if len(seen) else seen
    top = share.max(axis=1) if len(seen) else np.empty(0)
    odds = np.searchsorted(ODDS, np.log(top / np.maximum(1 - top, 1e-9)))
    return known, 1 + (share.argmax(axis=1) if len(seen) else np.empty(0, np.int64)) * (len(ODDS) + 1) + odds


def fit(languages: list[str], words: Words, label: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray] | None = None, passes: int = PASSES, rate: float = RATE, ridge: float = RIDGE) -> LanguageCrf:
    """Maximum penalised likelihood of the words' labels along the sequences of ``words``. Adam."""
    k = len(languages)
    crf = LanguageCrf(languages, np.zeros((BUCKETS + 2 + k * (len(ODDS) + 1), k)), np.zeros((k, k)), *(lexicon or ()))
    n = len(label)
    if n == 0:
        return crf
    of, row = crf.rows(words)
    used, row = np.unique(row, return_inverse=True)
    first = np.zeros(n, bool)
    first[words.begin[:-1][np.diff(words.begin) > 0]] = True
    at = np.flatnonzero(~first)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[at - 1], label[at]), 1)
    truth = np.eye(k)[label]
    x = [np.zeros((len(used), k)), np.zeros((k, k))]
    m, v = [np.zeros_like(a) for a in x], [np.zeros_like(a) for a in x]
    for i in range(1, passes + 1):
        score = np.stack([np.bincount(of, x[0][row, j], minlength=n) for j in range(k)], axis=1)
        p, pairs = forward_backward(score, words.begin, x[1], True)
        off = truth - p
        slopes = [np.stack([np.bincount(row, off[of, j], minlength=len(used)) for j in range(k)], axis=1) / n - ridge * x[0], (seen - pairs) / n - ridge * x[1]]
        for a, b, c, g in zip(x, m, v, slopes, strict=True):
            b *= 0.9
            b += 0.1 * g
            c *= 0.99
            c += 0.01 * g * g
            a += rate * (b / (1 - 0.9**i)) / (np.sqrt(c / (1 - 0.99**i)) + 1e-9)
    crf.weights[used], crf.links = x
    return crf


def _fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def _pieces(text: str, pieces: int, size: int) -> list[str]:
    """``pieces`` stretches of ``size`` words, evenly spread over the whole text; all of it where it is shorter."""
    words = text.split()
    if len(words) <= pieces * size:
        return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
    gap = (len(words) - size) / max(1, pieces - 1)
    return [" ".join(words[int(i * gap) : int(i * gap) + size]) for i in range(pieces)]


def sequences(pieces: list[list[str]]) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Training texts from pieces of each language, and for each text the (code points, language) of its pieces.

    Sequences take three pieces. Of every four one stays in its language, the others move once or
    twice to the next ones with pieces left; pieces are used once.
    """
    left = [list(p) for p in pieces]
    texts, parts = [], []
    turn = 0
    while any(left):
        order = sorted((i for i in range(len(left)) if left[i]), key=lambda i: -len(left[i]))
        a = order[turn // 4 % len(order)]
        b = order[(turn // 4 + 1 + turn // (4 * len(order)) % max(1, len(order) - 1)) % len(order)]
        plan = ((a, a, a), (a, b, b), (a, a, b), (a, b, a))[turn % 4]
        taken = [(left[i].pop(), i) for i in plan if left[i]]
        turn += 1
        if taken:
            texts.append(" ".join(t for t, _ in taken))
            parts.append([(len(t) + 1, i) for t, i in taken])
    return texts, parts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, pieces: int = PIECES, piece_words: int = PIECE_WORDS) -> LanguageCrf:
    """Fits a model on pieces of at most ``sample_docs`` labelled texts (of each language 20, even if that makes more).

    The sample is the texts outside fold 0 with the smallest id hashes of each language; every
    second one serves the lexicon, the others the chain. Null labels and texts are left out, as are
    all columns but these three. Without any labelled text there are no languages.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit(""))) % FOLDS != 0))
    counts = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"))
    n_languages = counts.count()
    share = max(LEAST_DOCS, sample_docs // max(1, n_languages))
    # A row for each language, and for each chosen text.
    small = F.broadcast if n_languages * share <= BROADCAST_KEYS else lambda df: df
    # A hash leaves some eight times as many ids as are wanted; these are ranked.
    hashed = rows.select("_id", "_lang", F.xxhash64("_id", "_lang").alias("_h")).join(small(counts), "_lang").where(F.pmod(F.shiftright("_h", 20), F.lit(1 << 20)) < F.lit(8 * share << 20) / F.col("n"))
    ranked = hashed.select("_id", "_lang", "_h").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id")))
    chosen = ranked.where((F.col("_k") <= share) & F.col("_id").isNotNull())
    picked = rows.join(small(chosen.select("_id", "_lang", "_h")), ["_lang", "_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_pieces(t, pieces, piece_words) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), batch.column("_h"), pa.array(cut, pa.list_(pa.string()))], names=["lang", "h", "pieces"])

    # Of several texts with one id and language one counts.
    sample = picked.select("_lang", "_h", "_text").mapInArrow(run, "lang string, h long, pieces array<string>").groupBy("lang", "h").agg(F.min("pieces").alias("pieces")).toArrow()
    got = sorted(zip(sample.column("lang").to_pylist(), sample.column("h").to_pylist(), sample.column("pieces").to_pylist(), strict=True))
    languages = sorted({x[0] for x in got})
    at = {x: i for i, x in enumerate(languages)}
    lists: tuple[list[list[str]], list[list[str]]] = ([[] for _ in languages], [[] for _ in languages])
    for place, (lang, _, cut) in enumerate(got):
        lists[place % 2][at[lang]].extend(cut)
    names = [(" ".join(p), i) for i, p in enumerate(lists[0])]
    known = read_words([t for t, _ in names])
    lexicon = build_lexicon(known.key, np.repeat([i for _, i in names], np.diff(known.begin)), len(languages)) if len(known.key) else None
    texts, parts = sequences(lists[1] if any(map(any, lists[1])) else lists[0])
    words = read_words(texts)
    ends = [np.cumsum([n for n, _ in p]) for p in parts]
    text = np.repeat(np.arange(len(texts)), np.diff(words.begin))
    label = np.array([parts[t][int(np.searchsorted(ends[t], s, side="right"))][1] for t, s in zip(text.tolist(), words.start.tolist(), strict=True)], np.int64)
    return fit(languages, words, label, lexicon)


def identify(docs: DataFrame, model: LanguageCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the language with most of a text's letters and its share, row by row, without a shuffle.

    A null text and one without a letter are ``und`` with score 0, as is every text of a model without
    languages. Of equal shares the first language in order wins. Repeated rows get equal
    results; an empty table gives no rows.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                texts = [t or "" for t in step.column(1).to_pylist()]
                if model.languages:
                    labelled = model.label(texts)
                    found, share = np.diff(labelled.begin) > 0, model.shares(labelled)
                    best = share.argmax(axis=1)
                    names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), found.tolist(), strict=True)]
                    score = np.where(found, np.minimum(share[np.arange(len(best)), best], 1.0), 0.0)
                else:
                    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def language_spans(docs: DataFrame, model: LanguageCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, lang, score): stretches of words of one language in code points, with their mean probability.

    A text without letters has none.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                if not model.languages:
                    continue
                words = model.label([t or "" for t in step.column(1).to_pylist()])
                p = words.chance
                if not len(p):
                    continue
                best = p.argmax(axis=1)
                text = np.repeat(np.arange(len(words.begin) - 1), np.diff(words.begin))
                opens = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (text[1:] != text[:-1]))))
                ends = np.append(opens[1:], len(best)) - 1
                mean = np.add.reduceat(p[np.arange(len(best)), best], opens) / (ends - opens + 1)
                ids = step.column(0).take(pa.array(text[opens]))
                columns = [ids, pa.array(words.start[opens]), pa.array(words.start[ends] + words.letters[ends]), pa.array([model.languages[i] for i in best[opens]], pa.string()), pa.array(mean)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "end", "lang", "score"])

    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, end long, lang string, score double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")
