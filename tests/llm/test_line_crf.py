from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from jobloom.llm.line_crf import EDGES, Lines, fit, forward_backward, label_lines, measure_lines, op3_line_crf, score_texts, train


def test_marginals_and_partition_like_all_labelings():
    rng = np.random.default_rng(1)
    lengths = [1, 4, 6, 3]
    begin = np.cumsum([0, *lengths])
    evidence, links = rng.normal(size=begin[-1]), rng.normal(size=(2, 2))
    good, pairs, logs = forward_backward(evidence, begin, links)
    want_good, want_pairs, want_logs = np.zeros(begin[-1]), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(begin):
        total, marg, pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum((e if v else -e) / 2 for e, v in zip(evidence[a:b], y)) + sum(links[p, q] for p, q in itertools.pairwise(y)))
            total += w
            marg += w * np.array(y)
            for p, q in itertools.pairwise(y):
                pair[p, q] += w
        want_good[a:b], want_pairs, want_logs = marg / total, want_pairs + pair / total, want_logs + np.log(total)
    assert np.allclose(good, want_good) and np.allclose(pairs, want_pairs) and np.isclose(logs, want_logs)


def test_measurements():
    lines = measure_lines(pa.array(["a b\n\nA B\nx x x", None, "", "é! | #"]))
    assert lines.begin.tolist() == [0, 4, 5, 6, 7]
    value = lambda i, name: int(lines.bins[i][list(EDGES).index(name)])
    assert [value(i, "words") for i in range(7)] == [1, 0, 1, 2, 0, 0, 2]
    assert [value(i, "same_as_a_line_before") for i in range(7)] == [0, 0, 1, 0, 0, 0, 0]
    assert value(3, "repeats_of_words") > value(0, "repeats_of_words") and value(6, "bars_per_word") > 0
    assert lines.weight.tolist() == [4, 1, 4, 6, 1, 1, 8]


def test_learns_neighbours():
    """A plain line is bad beside a shouting one and good elsewhere: only the chain can tell."""
    texts, labels = [], []
    for i in range(60):
        bad = i % 3 == 0
        texts.append("\n".join(["plain words go here today"] * 3 + (["LOUD!! LOUDER!! LOUDEST!!"] * 3 if bad else ["soft words end here now"] * 3)))
        labels.append(0 if bad else 1)
    lines = measure_lines(pa.array(texts))
    model = fit(lines, np.array(labels, float))
    assert ((model.score(lines) >= 0.5) == np.array(labels, bool)).all()


def test_fit_of_nothing_or_one_label():
    none = Lines(np.zeros(1, np.int64), np.empty((0, len(EDGES)), np.uint8), np.empty(0))
    assert len(fit(none, np.empty(0)).score(none)) == 0
    one = measure_lines(pa.array(["some words here", ""]))
    assert (fit(one, np.ones(2), passes=20).score(one) > 0.5).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "word " * 30_000, 0.0), (None, "a\nb", 1.0), (4, "fine prose here.", 2.0), (4, "fine prose here.", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, 0), (4, 0, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, text int")
    model = train(docs, labels)
    out = score_texts(docs, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 4}) == 1
    assert score_texts(docs.limit(0), train(docs.limit(0), labels)).count() == 0


@pytest.fixture(scope="module")
def larger(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")


def test_held_out_documents(spark, larger):
    rows = op3_line_crf(spark, larger).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    pairs = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s, _ in pairs if y], [s for y, s, _ in pairs if not y]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([p == y for y, _, p in pairs]) > 0.95
    assert np.mean([p for y, _, p in pairs if y]) > 0.98


def test_lines_have_labels_of_their_own(spark):
    """Good lines of bad documents come out good: only documents are labelled, and half of each bad one is fine."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    fine = lambda: " ".join(word() for _ in range(12)) + "."
    junk = lambda: " ".join(word() + "!!" for _ in range(4)) + " ### | | $$"
    rows, truth = [], {}
    for i in range(400):
        bad = i % 2 == 0
        cut = int(rng.integers(1, 6))
        lines = [fine() for _ in range(cut)] + ([junk() for _ in range(6 - cut)] if bad else [fine() for _ in range(6 - cut)])
        rows.append((i, "\n".join(lines)))
        truth |= {(i, k): not (bad and k >= cut) for k in range(6)}
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int"))
    got = label_lines(docs, model).collect()
    assert len(got) == 2401
    assert np.mean([r.good == truth[r.doc_id, r.line] for r in got if r.doc_id is not None]) > 0.97
    assert all((r.probability >= 0.5) == r.good for r in got)
    assert label_lines(docs.limit(0), model).count() == 0


def plain_bins(text):
    """Bins of each line, one by one."""
    out, seen = [], set()
    for line in (text or "").split("\n"):
        raw = line.encode()
        words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
        n = len(words)
        per = max(n, 1)
        among = lambda cs: sum(b in cs for b in raw)  # noqa: B023, E731
        letters = sum(chr(b).isalpha() if b < 128 else True for b in raw)
        values = [
            n, len(raw) / per, among(b"#*$%&<>=~^@_\\{}[]+") / per, among(b"|") / per, among(b"!") / per, among(range(65, 91)) / max(letters, 1), among(range(48, 58)) / max(len(raw), 1),
            among(b".,;:?") / per, sum(a == b for a, b in itertools.pairwise(words)) / per, len(set(words)) / per if n else 1.0, float(n > 0 and tuple(words) in seen),
        ]
        seen.add(tuple(words))
        out.append((len(raw) + 1, [sum(v > e for e in edges) for v, edges in zip(values, EDGES.values(), strict=True)]))
    return out


def plain_score(model, text):
    """The score with loops over lines and labels, in logarithms."""
    rows = plain_bins(text)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    evidence = []
    for t in range(len(rows)):
        e = float(model.bias)
        for k in (-1, 0, 1):
            bins = rows[t + k][1] if 0 <= t + k < len(rows) else [model.weights.shape[2] - 1] * len(EDGES)
            e += sum(float(model.weights[k + 1][j][b]) for j, b in enumerate(bins))
        evidence.append(max(-60.0, min(60.0, e)))
    half, links = [(-e / 2, e / 2) for e in evidence], model.links.tolist()
    ahead, back = [half[0]], [(0.0, 0.0)]
    for h in half[1:]:
        ahead.append(tuple(add(ahead[-1][0] + links[0][z], ahead[-1][1] + links[1][z]) + h[z] for z in (0, 1)))
    for h in half[:0:-1]:
        back.append(tuple(add(links[z][0] + h[0] + back[-1][0], links[z][1] + h[1] + back[-1][1]) for z in (0, 1)))
    good = [1 / (1 + math.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, back[::-1], strict=True)]
    q = sum(g * w for g, (w, _) in zip(good, rows, strict=True)) / sum(w for w, _ in rows)
    q = min(max(q, 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(model.slope * math.log(q / (1 - q)) + model.shift)))


def test_query_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op3_line_crf(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-6, r.doc_id
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
