from __future__ import annotations

import random
import re

import pytest

from jobloom.llm import ngram_join
from jobloom.llm.ngram_join import keep_one, ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, size=5, percent=75):
    """Sets by their words, every pair compared, components by relabelling."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            same_id = rows[i][0] == rows[j][0] and rows[i][0] is not None and x and sets[j]
            linked = x and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(x & sets[j]) >= percent * len(x | sets[j])
            if (linked or same_id) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if y == b else y for y in label]
    least = {}
    for (doc, _), c in zip(rows, label, strict=True):
        if doc is not None:
            least[c] = min(least.get(c, doc), doc)
    return sorted((repr((doc, len(s), None if doc is None else least[c])) for (doc, _), s, c in zip(rows, sets, label, strict=True)))


def got(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_components(docs, **more).collect())


def corpus(seed, groups=6, copies=14, words=60, edit=0.05):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.randint(1, copies)):
            text = [rng.choice(vocabulary) if rng.random() < edit * rng.random() else w for w in base]
            if rng.random() < 0.5:
                text = [*shared, *text]
            if rng.random() < 0.2:
                text = [w.upper() for w in text]
            rows.append(rng.choice([" ", "\n", "  "]).join(text))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_components_as_all_pairs(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed,small", [(3, 1), (4, 2)])
def test_hub_rounds_lose_no_link(spark, monkeypatch, seed, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = corpus(seed, groups=4, copies=30, edit=0.12)
    assert got(spark, rows) == brute(rows)


def test_many_chunks_and_heavy_shingles(spark, monkeypatch):
    rows = corpus(5, groups=8, copies=10)
    want = brute(rows)
    for name, value in (("CHUNK", 700), ("HEAVY", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    # Workers read these values from the closure's module, so run the packing with them directly.
    import pyarrow as pa

    from jobloom.llm.shingles import hash_words, shingle_sets

    batch = pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    sizes, texts, hashes = shingle_sets(hash_words(batch.column(1)), 5)
    held = []
    for a in range(0, len(rows), 7):
        b = min(len(rows), a + 7)
        inside = (texts >= a) & (texts < b)
        held.append((batch.column(0).slice(a, b - a), sizes[a:b], ngram_join._prints(sizes[a:b], texts[inside] - a, hashes[inside]), texts[inside] - a, hashes[inside]))
    packed = [ngram_join._pack_chunk(i, [x], 3) for i, x in enumerate(held)]
    whole = pa.Table.from_batches(packed)
    one = pa.Table.from_batches([ngram_join._pack_chunk(0, held, 1)])
    assert any(x for x in whole.column("own").to_pylist())
    import pyarrow.compute as pc

    counted = pa.concat_tables([ngram_join._count(whole.filter(pc.equal(whole.column("bucket"), b))) for b in range(3)])
    parts = [ngram_join._assemble(75, 3)(counted.filter(pc.equal(counted.column("chunk"), c))) for c in range(len(held))]
    profile = {r["doc_id"]: r for p in parts for r in p.to_pylist()}
    plain = {r["doc_id"]: r for r in ngram_join._assemble(75, 1)(ngram_join._count(one)).to_pylist()}
    assert len(want) == len(profile) == len(plain)
    for doc, r in profile.items():
        assert (r["n"], r["k"], r["print"]) == (plain[doc]["n"], plain[doc]["k"], plain[doc]["print"])
        assert len(r["shared"] or []) == len(plain[doc]["shared"] or []) and len(r["rare"] or []) == r["k"]


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One  TWO\n"), (6, "one two three four five"), (7, "one two three four five"), (None, "one two"), (8, long + " tail"), (9, long), (9, long), (10, "é À"), (11, "é à"), (12, "x" * 50_000), (12, "other words are here now")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_keep_one_keeps_smallest_and_all_columns(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 1), (2, "a b c d e f", 2), (5, "q r s t u v", 3), (None, "a b c d e f", 4), (6, None, 5)], "doc_id long, text string, member_id int")
    out = keep_one(docs)
    assert out.columns == ["doc_id", "text", "member_id"]
    assert sorted(r.member_id for r in out.collect()) == [2, 3, 4, 5]


def test_documents_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows) == brute(rows)
