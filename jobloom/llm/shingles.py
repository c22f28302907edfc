"""Hashes of words and word shingles for whole Arrow batches, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together (a longer text is hashed alone): bounds a worker's arrays.
STEP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The other way to cut: every ASCII byte but letters and digits separates.
ALNUM_ONLY = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _code_points(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Scripts without spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, bopomofo and Han; and their full-width punctuation.
_UNSPACED = _code_points((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FA), (0x30FC, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
_WIDE_MARKS = _code_points((0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES)
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


class Words(NamedTuple):
    """Words of several texts in order: the text each is in, and its hash."""

    n_texts: int
    text: np.ndarray
    hash: np.ndarray


def text_steps(batch: pa.RecordBatch, text: int = 1, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``step_bytes`` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + step_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _unspaced(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length) of each character of a script without spaces, and the first bytes of wide punctuation."""
    lead = np.flatnonzero(raw >= 0xE0)
    high = raw[lead] >= 0xF0
    three, four = lead[~high], lead[high]
    code = ((raw[three] & 15).astype(np.int32) << 12) | ((raw[three + 1] & 63).astype(np.int32) << 6) | (raw[three + 2] & 63)
    # Han beyond the first plane: U+20000 to U+3FFFF.
    four = four[(raw[four] == 0xF0) & (raw[four + 1] >= 0xA0)]
    alone = three[_UNSPACED[code]]
    return np.concatenate((alone, four)), np.repeat((3, 4), (len(alone), len(four))), three[_WIDE_MARKS[code]]


def hash_words(column: pa.Array, separators: np.ndarray = _SPACE, unspaced: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased; a null text has none.

    ``separators``: a flag for each byte value that takes the place of white space.
    ``unspaced``: each character of a script without spaces is a word, and wide punctuation separates.
    A word's hash is a polynomial of its bytes, taken from prefix sums over all texts.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0 or offsets[-1] == offsets[0]:
        return Words(len(column), np.empty(0, np.int64), np.empty(0, np.uint64))
    raw = _LOWER[np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets -= offsets[0]
    space = separators[raw]
    if unspaced:
        alone, sizes, marks = _unspaced(raw)
        for k in range(3):
            space[marks + k] = True
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first = np.concatenate(([True], space[:-1]))
    first[edges] = True
    last = np.concatenate((space[1:], [True]))
    last[edges - 1] = True
    if unspaced:
        after = alone + sizes
        first[alone] = last[after - 1] = True
        first[after[after < len(raw)]] = last[alone[alone > 0] - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    power, inverse = _power_tables(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power)))
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(len(column), np.searchsorted(offsets[1:], starts, side="right"), hashes)


def _chain(seed: int, parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(parts[0]), seed, np.uint64)
    for part in parts:
        out = mix(out * _U(_BASE) + part)
    return out


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``size`` words inside one text."""
    n = len(words.text) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
    return at, _chain(size, [words.hash[at + k] for k in range(size)])


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size of each text, text of each element, element): distinct shingles, sorted in each text.

    A text of fewer than ``size`` words has its whole word sequence as its one shingle.
    """
    at, hashes = windows(words, size)
    texts = words.text[at]
    counts = np.bincount(words.text, minlength=words.n_texts)
    begin = np.cumsum(counts) - counts
    for n in range(1, size):
        if len(short := np.flatnonzero(counts == n)):
            texts = np.concatenate((texts, short))
            hashes = np.concatenate((hashes, _chain(n, [words.hash[begin[short] + k] for k in range(n)])))
    order = np.argsort(texts, kind="stable")
    texts, hashes = texts[order], hashes[order]
    bounds = np.searchsorted(texts, np.arange(words.n_texts + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(texts), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    texts, hashes = texts[new], hashes[new]
    return np.bincount(texts, minlength=words.n_texts), texts, hashes
