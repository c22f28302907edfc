"""Hard negatives: against brute force, and the brackets of the pivot table."""

from __future__ import annotations

import math

import numpy as np
import pytest

from jobloom.llm import hard_negatives
from jobloom.llm.hard_negatives import op11_hard_negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<float>, label int, norm double, v string, d int, windows int"


def by_hand(rows):
    taken = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        taken[i] = min(taken.get(i, (label, v)), (label, v))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for a in (i for i in taken if i % 50 == 0):
        label, v = taken[a]
        near = sorted((-score(v, w), i) for i, (other, w) in taken.items() if i != a and other == label)[:5]
        far = sorted((-score(v, w), i) for i, (other, w) in taken.items() if other != label)
        for p, i in near:
            fit = [(s, j) for s, j in far if 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, i, k, j, -p, -s) for k, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1.0, "v", 2, 3) for r in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    return op11_hard_negatives(spark, str(tmp_path))


def vectors(n, dim, seed, hot=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[:hot] = x[0] + 0.01 * x[:hot]
    return [[float(c) for c in r] for r in x]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, tmp_path, monkeypatch, small):
    if small:
        for name, value in {"STRIPE": 40, "ANCHORS": 3, "TILE": 16, "STEP": 2, "PIVOT_SAMPLE": 20}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    rows = [(i * 5, v, 3 if i % 3 == 0 else i % 10) for i, v in enumerate(vectors(400, 5, 1, hot=150))]
    rows += [(7000, [0.5, 0.5], 1), (7001, [], 1), (7050, None, 1), (7100, [float("nan")] * 5, 1), (7150, [None, 1.0], 2), (7200, [float("inf")] * 5, 2), (None, [1.0] * 5, 2), (7250, [1.0] * 5, None)]
    rows += [rows[10], rows[10], (rows[20][0], rows[21][1], 0), (7300, [0.0] * 5, 4), (-50, [-1.0] * 5, 4), (7350, list(rows[30][1]), rows[30][2]), (7400, [1000.0] * 5, 4)]
    got = run(spark, tmp_path, rows).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == by_hand(rows)


def test_few_rows(spark, tmp_path):
    rows = [(0, [1.0], 1), (1, [1.0], 2), (2, [0.9], 1)]
    got = run(spark, tmp_path, rows)
    assert got.columns == list(COLUMNS) and sorted(map(tuple, got.collect())) == by_hand(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert op11_hard_negatives(spark, str(tmp_path / "none")).count() == 0


def test_vectors_without_an_exact_score(spark, tmp_path):
    with pytest.raises(Exception, match="too long for exact scores"):
        run(spark, tmp_path, [(0, [1e9], 1), (1, [1.0], 1)]).count()


def test_brackets_leave_few_rows_where_vectors_lie_in_groups():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 32)) * 400
    group = rng.integers(0, 8, 4096)
    x = np.round(centres[group] + rng.normal(size=(4096, 32)) * 20)
    longest = float((x**2).sum(axis=1).max())
    pivots = hard_negatives.choose_pivots(x[:500], longest)
    last = np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))
    rows = {"x": x, "label": group, "id": np.arange(4096), "d": hard_negatives._distances(x, last, pivots).astype(np.float32)}
    q = x[:64]
    asked = {"x": q, "label": group[:64], "id": np.arange(64), "norm": (q**2).sum(axis=1), "dq": hard_negatives._distances(q, np.zeros(64), pivots).astype(np.float32), "low": np.full((64, 1), -(1 << 61)), "high": np.full((64, 1), 1 << 61)}
    anchor, _, ids, score, count = hard_negatives.search_stripe(asked, rows, longest, 5, False)
    exact = q @ x.T
    for i in range(64):
        want = sorted((-exact[i, j], j) for j in np.flatnonzero(group != group[i]))[:5]
        assert sorted(zip(-score[anchor == i], ids[anchor == i], strict=True)) == want
    assert count["exact"] < 0.5 * count["pairs"]
