"""The stages and the whole pipeline against plain Python over the small documents."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from jobloom.llm.bpe import loaded
from jobloom.llm.vocabularies import path

from . import test_decontamination, test_ngram_join

WHITE = " \t\n\x0b\f\r"


def good(text):
    words = test_ngram_join.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    n, chars = len(words), sum(map(len, words))
    symbols, capitals, shouts = (sum(text.count(c) for c in cs) if text else 0 for cs in ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!"))
    dups = len(lines) - len(set(lines))
    return not (n < 50 or 100 * len(covered) > 50 * n or 100 * symbols > 25 * n or (2 * dups > len(lines) >= 4) or chars > 20 * n or chars < 2 * n or 100 * capitals > 40 * chars or 100 * shouts > 40 * n)


def units(line):
    """A line; one of over 50 words is cut before the word after a sentence, and after 16 words of a sentence."""
    words = list(test_ngram_join.WORD.finditer(line))
    if len(words) <= 50:
        return [line]
    cuts, n = [], 0
    for w, after in zip(words, [*words[1:], None], strict=True):
        n += 1
        if (w[0][-1] in ".!?" or n == 16) and after:
            cuts, n = [*cuts, after.start()], 0
    return [line[x:y] for x, y in zip([0, *cuts], [*cuts, len(line)], strict=True) if x < y]


def dedup(rows):
    seen, cut = set(), {}
    for i, (doc, text) in sorted(enumerate(rows), key=lambda x: x[1][0]):
        parts = [(n, u) for n, line in enumerate(text.split("\n")) for u in units(line)]
        solid = [k for k, (_, u) in enumerate(parts) if u.strip(WHITE)]
        gone = set()
        for a in range(len(solid) - 2):
            key = tuple(parts[k][1].strip(WHITE) for k in solid[a : a + 3])
            if key in seen:
                gone |= set(solid[a : a + 3])
            seen.add(key)
        lines = {}
        for k, (n, u) in enumerate(parts):
            if k not in gone:
                lines[n] = lines.get(n, "") + u
        cut[i] = "\n".join(lines.values())
    return [(doc, cut[i]) for i, (doc, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def brute(spark, sf_dir):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols).collect()]
    steps = [[r for r in read("documents", "doc_id", "text") if good(r[1])]]
    steps.append(dedup(steps[-1]))
    groups = [eval(x) for x in test_ngram_join.brute(steps[-1])]
    kept = {doc for doc, _, component in groups if doc == component}
    steps.append([r for r in steps[-1] if r[0] in kept])
    items = read("benchmark", "item_id", "text")
    # Scoring all pairs is slow: only documents that share a word trigram with an item can leak one.
    grams = set().union(*(test_decontamination.grams(test_decontamination.words(t)) for _, t in items))
    near = [r for r in steps[-1] if test_decontamination.grams(test_decontamination.words(r[1])) & grams]
    leaks = {x[0] for x in test_decontamination.brute(near, items)}
    steps.append([r for r in steps[-1] if repr(r[0]) not in leaks])
    return steps


def test_stages_and_run(spark, sf_dir, brute):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], brute, strict=True):
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        rows = docs.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in rows)
    assert 0 < len(brute[3]) < len(brute[2]) < len(brute[0])
    e = loaded(path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    plain.no_truncation()
    plain.no_padding()
    want = {}
    for doc, text in brute[3]:
        ids = plain.encode(text, add_special_tokens=False).ids
        want[doc] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert e.special
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.count() == 0


def test_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    prose = " ".join(f"word{i} says{i} things{i} here{i}." for i in range(30))
    rows = [(1, prose, None, None, None, "a"), (1, prose, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (3, None, None, None, None, None), (None, prose + " End.", "en", "s", 1, "c"), (4, "long word " * 60_000, "en", "s", 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_units_removed string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"odd-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_units_removed"]
    assert sorted(docs.collect(), key=repr) == sorted([rows[0], rows[1], rows[4]], key=repr)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(repr(r.doc_id) for r in out.collect()) == ["1", "1", "None"]
    narrow = corpus_pipeline.line_dedup(spark, docs.select("doc_id", "text"), sf_dir)
    assert narrow.columns == ["doc_id", "text"]
