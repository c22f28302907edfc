"""Language identification: the chain against plain sums, held-out accuracy, code-switched texts, edges."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pytest

from jobloom.llm import language_id
from jobloom.llm.language_id import forward_backward, identify, language_spans, op13_language_id, read_words, train


def test_chain_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    lengths = [3, 1, 0, 5]
    begin = np.concatenate(([0], np.cumsum(lengths)))
    score, links = rng.normal(size=(sum(lengths), 3)) * 3, rng.normal(size=(3, 3)) * 2
    got, pairs = forward_backward(score, begin, links, True)
    want, expected = np.zeros_like(got), np.zeros((3, 3))
    for a, b in itertools.pairwise(begin):
        paths = list(itertools.product(range(3), repeat=int(b - a)))
        weight = [np.exp(sum(score[a + i, x] for i, x in enumerate(p)) + sum(links[x, y] for x, y in itertools.pairwise(p))) for p in paths]
        for p, w in zip(paths, weight, strict=True):
            for i, x in enumerate(p):
                want[a + i, x] += w / sum(weight)
            for x, y in itertools.pairwise(p):
                expected[x, y] += w / sum(weight)
    assert np.allclose(got, want) and np.allclose(pairs, expected)


def test_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    begin = np.cumsum([0, 200, 1, 0, 7, 63, 64, 65, 500])
    score, links = rng.normal(size=(begin[-1], 4)) * 4, rng.normal(size=(4, 4)) * 2
    got = forward_backward(score, begin, links, True)
    monkeypatch.setattr(language_id, "CHUNK", 1000)
    whole = forward_backward(score, begin, links, True)
    assert np.allclose(got[0], whole[0]) and np.allclose(got[1], whole[1])


def test_words_are_runs_of_letters():
    texts = ["Ein Wort, zwei!", "", "x1y", "1 2", "é" * 70, "ΑΣ İx", "日本語 a"]
    words = read_words(texts)
    got = [[(int(words.start[i]), int(words.letters[i])) for i in range(words.begin[t], words.begin[t + 1])] for t in range(len(texts))]
    want = []
    for t in texts:
        runs = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)]
        want.append([(i, min(32, b - i)) for a, b in runs for i in range(a, b, 32)])
    assert got == want
    one, two = read_words(["Wort"]), read_words(["ein wort hier"])
    assert one.key[0] == two.key[1]
    assert sorted(one.bucket) == sorted(two.bucket[two.of == 1])


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return train(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op13_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    for held in (True, False):
        own = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out == held and docs[r.doc_id].lang]
        assert np.mean(own) >= 0.97, held


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 'xx', lang) AS lang", "'z' AS source", "1 AS score", "2 AS lang_pred")
    again = train(other)
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights) and np.array_equal(again.links, model.links)


def test_code_switched_texts_are_cut_where_they_switch(spark, sf_dir, model):
    """Held-out texts of two languages, joined in turns of twelve words: nine words in ten get their language."""
    held = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and re.fullmatch(r"[\w\s.,]+", r.text):
            held.setdefault(r.lang, []).extend(re.findall(r"[^\W\d_]+", r.text)[:120])
    a, b = sorted(held, key=lambda x: -len(held[x]))[:2]
    text, label = [], []
    for i in range(0, min(len(held[a]), len(held[b]), 240) - 12, 12):
        for lang in (a, b):
            text += held[lang][i : i + 12]
            label += [lang] * 12
    assert len(text) >= 96
    joined = " ".join(text)
    spans = language_spans(spark.createDataFrame([(1, joined)], "doc_id long, text string"), model).collect()
    assert spans[0].start == 0 and spans[-1].end == len(joined)
    at = {m.start(): lang for m, lang in zip(re.finditer(r"\S+", joined), label, strict=True)}
    hits = [lang == s.lang for s in spans for start, lang in at.items() if s.start <= start < s.end]
    assert len(hits) == len(text) and np.mean(hits) >= 0.9


def test_odd_rows(spark, model, monkeypatch):
    rows = [(1, None), (2, ""), (3, "12 !? _"), (4, "The and of " * 40_000), (4, "The and of " * 40_000), (None, "the and"), (5, "x" * 100_000), (6, "日本語" * 50)]
    docs = spark.createDataFrame([(*r, 9, "q") for r in rows], "doc_id long, text string, score int, lang string")
    got = sorted((tuple(r) for r in identify(docs, model).collect()), key=repr)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert all(by[i][1:] == ("und", 0.0) for i in (1, 2, 3))
    assert by[4][1] == by[None][1] == "en" and all(by[i][1] in model.languages for i in (5, 6))
    assert identify(docs.limit(0), model).count() == 0
    texts = ["The and of " * 300, "der die das und", ""]
    whole = model.label(texts)
    monkeypatch.setattr(language_id, "SEGMENT", 100)
    parts = model.label(texts)
    assert all(np.allclose(x, y) for x, y in zip(whole, parts, strict=True))


@pytest.mark.parametrize("rows", [[], [(1, "a b", None)], [(2, None, "en"), (3, "", "de")], [(7, "einzig", "de")], [(i, "gleich wort", "de") for i in (7, 7, 7, 2)]])
def test_little_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    assert identify(docs, model).count() == len(rows)
    if not model.languages:
        assert {r.lang_pred for r in identify(docs, model).collect()} <= {"und"}
