"""BPE encoding and decoding by forced-boundary splitting.

Two adjacent bytes that stand side by side inside no vocabulary token can never end up
in one token: no merge across them exists. Such a pair marks a certain cut. A word is
cut there, its fragments are encoded independently (and cached), and their tokens are
concatenated. White space is in no token at all, so texts fall apart there first.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, importable, table

#: Entries of a worker's caches, and the length of what is cached: together they bound its memory.
CACHE_ENTRIES, CACHED_LENGTH = 600_000, 32
#: Letters whose lower case and word pattern need no library, if a probe of the file agrees.
LATIN = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))
MARKS = ".,;:!?"
#: Texts that are encoded together.
STEP = 256


class ForcedBoundaryBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library.

    Normaliser, word pattern and merges come from the file; the cuts from its vocabulary.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = models.BPE(model["vocab"], merges, end_of_word_suffix=suffix or None)
        #: Fragments before the last of a word carry no end-of-word suffix.
        self.inner = models.BPE(model["vocab"], merges)
        self.joined = {a + b for token in model["vocab"] for a, b in pairwise(token.removesuffix(suffix) if suffix else token)}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in chain(model["vocab"].items(), self.special.items()):
            self.tokens[i] = token
        self.fragments: dict[tuple[str, bool], list[int]] = {}
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = {i: chr(i if i in plain else next(rest)) for i in range(256)}
        self.latin = re.compile(f"[{LATIN}]+") if self._words(LATIN) == [self._spelled(LATIN)] else None
        self.marks = {c: self._encode_words(c) for c in MARKS} if all(self._words(f"a{c}") == ["a", c] for c in MARKS) else {}
        self.pieces: dict[str, bytes] = {"": b""}

    def cut(self, word: str) -> list[str]:
        """The fragments of a word: cut between two bytes that no token joins."""
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined]
        return [word[a:b] for a, b in pairwise([0, *at, len(word)])]

    def _spelled(self, word: str) -> str:
        """A word of Latin letters in the byte-level alphabet, in lower case."""
        return word.lower().encode().decode("latin-1").translate(self.alphabet)

    def _words(self, text: str) -> list[str]:
        return [word for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text) if self.normalizer else text)]

    def _fragment(self, text: str, last: bool) -> list[int]:
        ids = self.fragments.get((text, last))
        if ids is None:
            ids = [x.id for x in (self.last if last else self.inner).tokenize(text)]
            if len(text) <= CACHED_LENGTH:
                if len(self.fragments) >= CACHE_ENTRIES:
                    self.fragments.clear()
                self.fragments[text, last] = ids
        return ids

    def _encode_word(self, word: str) -> list[int]:
        *inner, end = self.cut(word)
        ids: list[int] = []
        for fragment in inner:
            ids += self._fragment(fragment, False)
        return ids + self._fragment(end, True)

    def _encode_words(self, piece: str) -> bytes:
        ids: list[int] = []
        for part in self.special_pattern.split(piece) if self.special_pattern and "<" in piece else (piece,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for word in self._words(part):
                ids += self._encode_word(word)
        return np.array(ids, dtype="<u4").tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        """The ids of a piece without spaces; a closing mark is a word of its own."""
        if self.latin and self.latin.fullmatch(piece):
            return np.array(self._encode_word(self._spelled(piece)), dtype="<u4").tobytes()
        if self.latin and piece[-1] in self.marks and self.latin.fullmatch(piece, 0, len(piece) - 1):
            body = piece[:-1]
            return (self.pieces.get(body) or self._kept(body)) + self.marks[piece[-1]]
        return self._encode_words(piece)

    def _kept(self, piece: str) -> bytes:
        """Encodes a piece and keeps it for the next time, unless it is long."""
        ids = self._encode_piece(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
                self.pieces[""] = b""
            self.pieces[piece] = ids
        return ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for text in texts:
            pieces = (text or "").replace("\n", " ").split(" ")
            known = self.pieces
            try:
                yield b"".join([known[x] for x in pieces])
                continue
            except KeyError:
                pass
            out = []
            for piece in pieces:
                ids = known.get(piece)
                if ids is None:
                    ids = self._kept(piece)
                out.append(ids)
            yield b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder: its tokens are joined by spaces, special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_loaded: dict[str, ForcedBoundaryBpe] = {}


def loaded(path: str) -> ForcedBoundaryBpe:
    """One encoder, and one cache, for each worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBpe(path)
    return _loaded[path]


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            yield batch.slice(start, STEP)


def _list_array(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in parts)], dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))


def encode_texts(docs: DataFrame, vocabulary: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` plus ``token_ids`` (array<int>) and, if asked for, ``decoded``: those ids decoded again.

    Whole texts, no special tokens added. Null and empty texts have no ids and decode to "".
    Row by row: no shuffle, ties and repeated rows are encoded alike. ``vocabulary`` is a
    path that every worker can open. New columns get leading underscores if names are taken.
    """
    importable(docs.sparkSession)
    ids_col, decoded_col = fresh(docs, "token_ids", "decoded")
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded_col, T.StringType())] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in _steps(batches):
            parts = list(bpe.encode(batch.column(text_col).to_pylist()))
            more = [_list_array(parts)]
            if decoded:
                more.append(pa.array([bpe.decode(np.frombuffer(x, dtype="<u4")) for x in parts], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def decode_ids(encoded: DataFrame, vocabulary: str, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` plus ``decoded``; a null array of ids decodes to null."""
    importable(encoded.sparkSession)
    (decoded_col,) = fresh(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in _steps(batches):
            out = [None if x is None else bpe.decode(np.array(x, dtype="<u4")) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, decoded_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(decoded_col, T.StringType())]))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    out = encode_texts(docs.select("doc_id", "text"), vocabulary, decoded=True)
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from .vocabularies import path

    return digests(table(spark, sf_dir, "documents"), vocabulary or path("word_bpe_49k.json"))
