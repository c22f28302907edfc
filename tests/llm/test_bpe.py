from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jobloom.llm.bpe import decode_ids, encode_texts, loaded, op6_forced_boundary_bpe
from jobloom.llm.vocabularies import path

FILE = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


PARTS = ["word", "Word,", "don't", " ", "\n", "\t", "é", "ÈRE.", "123", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "ß", "ﬁ", " ", "́", "x" * 70, "🙂", "\x1f", "​", "İ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10).map("".join) | st.text(max_size=30))
def test_ids_and_text_like_the_library(text):
    t, bpe = Tokenizer.from_file(FILE), loaded(FILE)
    want = t.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(next(bpe.encode([text])), "<u4")
    assert got.tolist() == want and bpe.decode(got) == t.decode(want, skip_special_tokens=False)


def test_cuts_join_no_token(plain):
    bpe = loaded(FILE)
    word = plain.pre_tokenizer.pre_tokenize_str("qzxjkqvñß日本語")[0][0]
    parts = bpe.cut(word)
    assert "".join(parts) == word and all(a[-1] + b[0] not in bpe.joined for a, b in zip(parts, parts[1:], strict=False))


def test_edges(spark, plain):
    rows = [(1, None, 1), (2, "", 1), (3, "Hello World! " * 9_000, 1), (None, "x", 1), (3, "Hi", 1), (3, "Hi", 1)]
    out = decode_ids(encode_texts(spark.createDataFrame(rows, "doc_id long, text string, token_ids int"), FILE), FILE, "_token_ids")
    assert out.columns == ["doc_id", "text", "token_ids", "_token_ids", "decoded"]
    for r in out.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        assert r._token_ids == ids and r.decoded == plain.decode(ids, skip_special_tokens=False)
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_documents(spark, sf_dir, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_forced_boundary_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()
