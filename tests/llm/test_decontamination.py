from __future__ import annotations

import math
import random
import re

import pytest

from jobloom.llm import decontamination as d
from jobloom.llm.decontamination import drop_contaminated, find_contamination, question_and_answer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(w, size=3):
    size = min(size, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def brute(docs, items, threshold=d.THRESHOLD, least=(d.QUESTION, d.ANSWER)):
    """Every passage scored against every segment, words as strings."""
    bags, parts, items = [], {}, list(dict.fromkeys(items))
    for k, (_, text) in enumerate(items):
        if not text:
            continue
        q, a = map(words, question_and_answer(text))
        w = q + a
        if len(w) < d.LEAST_WORDS:
            continue
        parts[k] = (grams(q), grams(a))
        n = math.ceil(len(w) / d.SEGMENT)
        sizes = [len(w) // n + (i < len(w) % n) for i in range(n)]
        at = 0
        for size in sizes:
            bags.append((k, w[at : at + size]))
            at += size
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    average = sum(len(b) for _, b in bags) / max(1, len(bags))
    impacts = []
    for _, b in bags:
        row = {t: math.log1p((len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * b.count(t) * (d.K1 + 1) / (b.count(t) + d.K1 * (1 - d.B + d.B * len(b) / average)) for t in set(b)}
        whole = sum(row.values())
        impacts.append({t: x / whole for t, x in row.items()})
    of_item = {}
    for s, (k, _) in enumerate(bags):
        of_item.setdefault(k, []).append(s)
    out = []
    for doc, text in docs:
        w = words(text)
        every = set(w)
        for k in parts:
            if all(sum(x for t, x in impacts[s].items() if t in every) < threshold - d.SLACK for s in of_item[k]):
                continue
            spans, best = [], 0.0
            for a in range(0, len(w), d.SEGMENT):
                here = set(w[a : a + 2 * d.SEGMENT])
                scores = [sum(x for t, x in impacts[s].items() if t in here) for s in of_item[k]]
                hit = [x for x in scores if x >= threshold - d.SLACK]
                if hit:
                    spans.append(a)
                    best = max(best, *hit)
            if not spans:
                continue
            near = set()
            for a in spans:
                run = w[max(0, a - d.SEGMENT) : a + 3 * d.SEGMENT]
                for size in (1, 2, 3):
                    near |= {tuple(run[i : i + size]) for i in range(len(run) - size + 1)}
            overlaps = [len(g & near) / len(g) if g else 1.0 for g in parts[k]]
            if overlaps[0] >= least[0] and overlaps[1] >= least[1]:
                out.append((repr(doc), repr(items[k][0]), len(spans), round(best, 6), *(round(x, 6) for x in overlaps)))
    return sorted(out)


def got(spark, docs, items, **more):
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted((repr(r.doc_id), repr(r.item_id), r.n_passages, round(r.score, 6), round(r.question_overlap, 6), round(r.answer_overlap, 6)) for r in find_contamination(a, b, **more).collect())


def corpus(seed, n_items=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(600)]
    some = lambda n: [rng.choice(vocabulary[:20]) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(4, 40))).capitalize() + ". " + " ".join(some(rng.randint(1, 20))) + ".") for i in range(n_items)]
    items.append((n_items, " ".join(some(200)) + ". Answer here now."))
    docs = []
    for i in range(80):
        w = some(rng.randint(0, 400))
        if rng.random() < 0.6:
            leak = rng.choice(items)[1].split()
            leak = [x for x in leak if rng.random() > rng.choice([0, 0.05, 0.3])]
            at = rng.randint(0, len(w))
            w[at:at] = leak
        docs.append((i, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_scoring_all(spark, seed):
    docs, items = corpus(seed)
    want = brute(docs, items)
    assert want and got(spark, docs, items) == want


@pytest.mark.parametrize("block", [2, 64, 128])
def test_wand_finds_all_segments_over_any_threshold(block):
    _, items = corpus(7, 300)
    index = d.Bm25Index([(i, *question_and_answer(t)) for i, t in items], block=block)
    assert index.n_blocks == math.ceil(len(index.item_of) / block) > 1
    rng = random.Random(3)
    for _ in range(150):
        terms = rng.sample(range(len(index.vocabulary)), rng.randint(1, 120))
        scores = {}
        for t in terms:
            for block in index.blocks:
                if p := block.get(t):
                    for s, x in zip(p.segments, p.impacts, strict=True):
                        scores[s] = scores.get(s, 0.0) + x
        for threshold in (0.05, 0.2, 0.5):
            assert {s for s, _ in index.search(terms, threshold)} == {s for s, x in scores.items() if x >= threshold - d.SLACK}


def test_edges(spark):
    item = "Which river runs through the old capital city? The long and winding Temes river."
    items = [(1, item), (2, None), (3, ""), (4, "too short"), (1, item), (None, "Seven little birds were sitting on the wall. They flew away at noon.")]
    docs = [(1, None), (2, ""), (3, item.upper()), (3, item), (4, "Which river runs through the old capital city?"), (5, ("x " * 30_000) + item), (None, items[-1][1]), (6, "the long and winding road")]
    want = brute(docs, items)
    assert {(w[0], w[1]) for w in want} == {("3", "1"), ("5", "1"), ("None", "None")}
    assert got(spark, docs, items) == want
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
    assert got(spark, docs, items, shard_bytes=90) == want
    rows = spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, leaked_row int")
    kept = drop_contaminated(rows, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == rows.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "2", "4", "6"]


def test_columns_for_question_and_answer(spark):
    items = spark.createDataFrame([(9, "Who painted the ceiling of the great hall in autumn?", "Maria of Lund")], "item_id long, q string, a string")
    docs = spark.createDataFrame([(1, "So: who painted the ceiling of the great hall in autumn? maria of lund, of course"), (2, "who painted the ceiling of the great hall in autumn? nobody")], "doc_id long, text string")
    assert [r.doc_id for r in find_contamination(docs, items, question_col="q", answer_col="a").collect()] == [1]


@pytest.mark.parametrize("shard_bytes", [300, 2000])
def test_shards_change_nothing(spark, monkeypatch, shard_bytes):
    """One index or many, held at once or not: weights come from all items, so every figure is the same."""
    docs, items = corpus(5)
    want = got(spark, docs, items)
    assert want and got(spark, docs, items, shard_bytes=shard_bytes) == want
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept = {r.doc_id for r in drop_contaminated(a, b, shard_bytes=shard_bytes).collect()}
    assert kept == {doc for doc, _ in docs} - {int(x[0]) for x in want}


def test_query_against_brute_force(spark, sf_dir):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    rows = d.op1_decontamination(spark, sf_dir).collect()
    assert want and sorted((repr(r.doc_id), repr(r.item_id), r.n_passages, round(r.score, 6), round(r.question_overlap, 6), round(r.answer_overlap, 6)) for r in rows) == want


def test_short_items_are_phrases(spark):
    items = [(1, "12 * 13 = ? 156"), (2, "Capital of France? Paris."), (3, "Capital of France? Paris."), (4, "..."), (5, "Eureka")]
    filler = lambda n: " ".join(f"x{i}" for i in range(n))
    docs = [(1, "so 12 * 13 = 156, he said"), (2, "13 12 156"), (3, filler(62) + " capital of France: Paris " + filler(100)), (4, "capital of France is Paris"), (5, filler(70) + " 12 13 156 " + filler(5)), (6, "capital of"), (7, "France Paris"), (8, "a eureka!"), (9, None), (10, "")]
    assert got(spark, docs, items) == sorted((d, i, n, 1.0, 1.0, 1.0) for d, i, n in (("1", "1", 1), ("3", "2", 1), ("3", "3", 1), ("5", "1", 2), ("8", "5", 1)))
    kept = drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 7, 9, 10]


def test_scripts_without_spaces(spark):
    chinese = "\u54ea\u6761\u6cb3\u6d41\u7ecf\u8fd9\u5ea7\u53e4\u8001\u7684\u9996\u90fd\uff1f\u8fd9\u6761\u6cb3\u53eb\u505a\u6c38\u5b9a\u6cb3\u3002"
    japanese = "\u65e5\u672c\u3067\u4e00\u756a\u9ad8\u3044\u5c71\u306f\u4f55\u3067\u3059\u304b\uff1f\u305d\u308c\u306f\u5bcc\u58eb\u5c71\u3067\u3059\u3002"
    thai = "\u0e40\u0e21\u0e37\u0e2d\u0e07\u0e2b\u0e25\u0e27\u0e07\u0e02\u0e2d\u0e07\u0e1b\u0e23\u0e30\u0e40\u0e17\u0e28\u0e44\u0e17\u0e22\u0e04\u0e37\u0e2d\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e"
    far = "\U00020000\U00020001\U00020002"
    assert question_and_answer(chinese) == (chinese[:13], chinese[13:])
    items = list(enumerate((chinese, japanese, thai, far, "\u5317\u4eac")))
    docs = [(k, "\u524d" + text.rstrip("\u3002") + "\u540e\u9762 and more") for k, text in items] + [(10, chinese[:13] + "\u4e0d\u77e5\u9053"), (11, "\u4eac\u5317"), (12, far[::-1])]
    assert [x[:2] for x in got(spark, docs, items)] == [(str(k), str(k)) for k, _ in items]
