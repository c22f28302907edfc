"""The Merkle manifest: against a plain Python one, and its edges."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from jobloom.llm.merkle import build_manifest, folded, leaf_digest, op12_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, g int, proof string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return H(*map(value, (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """Levels from the leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append((level[run:i], level[i + 1 : run + 8]))
        i //= 8
    return out


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {g: tree([leaf(r, r[1]) for r in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, at)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if hit and r[1] is not None else r[1]
            h = leaf(r, text)
            for left, right in steps:
                h = H(*left, h, *right)
            out.append((r[0], leaf(r, r[1]), trees[g][-1][0], top[-1][0], H(*(x for left, right in steps for x in (*left, *right))), h, h == top[-1][0]))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def run(spark, tmp_path, rows, name):
    spark.createDataFrame([(*r, "h", 1, "p") for r in rows], SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
    return op12_merkle_manifest(spark, str(tmp_path / name))


CASES = {
    "odd": [(1, None, None, None, None), (None, "É x", "en", "s", 3), (None, "É x", "en", "s", 3), (2, "", "", "s", 0), (2, "", "", "s", 0), (3, "Aa" * 50_000, "de", None, 5), (3, "b", "de", "", 5), (-4, "Z", "de", "1:x", 1)],
    "one": [(9, "Hello", "en", "s", 5)],
    "one_group": [(i, f"Text {i}", "en", "s", i) for i in range(9)],
    "many_groups": [(i, f"Text {i}", f"l{i}", "s", i) for i in range(70)],
    "deep": [(i * 7 % 601, f"T{i}", "en" if i % 3 else "fr", "s", i) for i in range(601)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_equals_plain_python(spark, tmp_path, name):
    got = run(spark, tmp_path, CASES[name], name).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(by_hand(CASES[name]), key=repr)


def test_empty_table(spark, tmp_path):
    df = run(spark, tmp_path, [], "none")
    assert df.columns == list(COLUMNS) and df.count() == 0


def test_a_changed_row_fails_alone(spark):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    manifest = build_manifest(docs.select("doc_id", "lang", leaf_digest().alias("h")), "lang", ["doc_id"])
    later = docs.withColumn("text", F.when(F.col("doc_id") == 42, "other").otherwise(F.col("text"))).select("doc_id", leaf_digest().alias("now"))
    seen = manifest.proofs().join(later, "doc_id").select("doc_id", (folded(F.col("now"), F.col("proof")) == manifest.root).alias("ok"))
    assert [r.doc_id for r in seen.collect() if not r.ok] == [42]
