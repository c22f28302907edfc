"""The text index: the same answers as without it, after changes too, from a few buckets and no text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.functions import search
from jobloom.operators.text_index import TextIndex

ROWS = [(1, "Backend Engineer", "writing services in the cloud"), (2, "Clerk", "an engineer sits near"), (3, "Engineers wanted", "sales of services"), (4, None, None), (5, "", "Engineer the cloud, engineering clouds"), (6, "État", "données et services"), (7, "Data", "engineer")]
QUERIES = ["engineer", "the", "-engineer", '"services in the cloud"', '"services cloud"', "services or -clerk", "état", "-services -clerk or backend", "engineer services", "engineer -sales"]
FEW = ["-engineer", '"backend engineer" or clerk', "engineer services"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, title string, description_text string").withColumn("rank_", F.lit(1))


def answers(rows, index=None, queries=FEW):
    return {q: {r.id: round(r.rank, 9) for r in search.search(rows, q, index=index).collect()} for q in queries}


def test_what_matches(rows):
    got = answers(rows, queries=QUERIES)
    assert {q: sorted(x) for q, x in got.items()} == {
        "engineer": [1, 2, 3, 5, 7], "the": [], "-engineer": [4, 6], '"services in the cloud"': [1], '"services cloud"': [], "services or -clerk": [1, 3, 4, 5, 6, 7], "état": [6], "-services -clerk or backend": [1, 4, 5, 7],
        "engineer services": [1, 3], "engineer -sales": [1, 2, 5, 7],
    }
    # One term: a title hit 1, a body hit 0.4, the k-th hit a k-th squared, over the sum of squares.
    assert got["engineer"][1] == pytest.approx(1 / 1.64493406685) and got["engineer"][2] == pytest.approx(0.4 / 1.64493406685) and got["engineer"][5] == pytest.approx(0.4 * 1.25 / 1.64493406685)
    # Two terms: place 2 in the title and 4 in the body.
    assert got["engineer services"][1] == pytest.approx(0.4**0.5 * search.nearness(2))
    assert got["engineer -sales"][1] == pytest.approx(search.FAR)


def test_index_gives_the_same(spark, rows, tmp_path):
    index = TextIndex.build(rows, str(tmp_path / "index"), buckets=4)
    assert answers(rows, index) == answers(rows)


def test_changes_compaction_and_a_broken_write(spark, rows, tmp_path):
    index = TextIndex.build(rows, str(tmp_path / "index"), buckets=4)
    new = spark.createDataFrame([(2, "Clerk", "no more of it"), (8, "Engineer", "near a clerk"), (4, "Backend", "services")], "id long, title string, description_text string")
    index.apply(new, removed=spark.createDataFrame([(3,), (99,)], "id long"))
    new2 = spark.createDataFrame([(2, "Engineer again", "")], "id long, title string, description_text string")
    index.apply(new2)
    index.apply(None, removed=spark.createDataFrame([(7,)], "id long"))
    now = rows.select("id", "title", "description_text").where("id NOT IN (2, 3, 4, 7)").unionByName(new.where("id <> 2")).unionByName(new2)
    want = answers(now)
    assert answers(now, index) == want
    # A segment without its documents was cut short: nobody sees it, and the next one takes its place.
    (tmp_path / "index" / "hits" / "segment=4" / "bucket=0").mkdir(parents=True)
    assert index.segments() == [0, 1, 2, 3] and answers(now, index) == want
    last = index.compact()
    assert last == 4 and answers(now, index) == want
    index.vacuum(last)
    assert index.segments() == [4] and answers(now, index) == want
    assert sorted(r.id for r in index.ids().collect()) == [1, 2, 4, 5, 6, 8]


def test_empty_index(spark, tmp_path, rows):
    index = TextIndex.build(rows.limit(0), str(tmp_path / "index"))
    assert search.search(rows.limit(0), "engineer", index=index).count() == 0


def test_plan_reads_two_columns_of_terms_from_their_buckets(spark, rows, tmp_path):
    index = TextIndex.build(rows, str(tmp_path / "index"), buckets=16)
    plan = search.parse(spark, "engineer services")
    found = search.find(index.hits(plan.terms), plan)
    text = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "description_text" not in text and "PartitionFilters: [bucket" in text and "In(term" in text


def test_words_and_hits_are_shuffled_once(spark, rows, tmp_path, monkeypatch):
    """A build writes no hits aside, a query's hits meet in tasks of a bounded number, and nearness needs no join."""
    from jobloom.functions import search as functions
    from jobloom.operators import text_index

    written, store = [], text_index.store.written
    for module in (text_index.store, functions):
        monkeypatch.setattr(module, "written", lambda df, name: (written.append(name), store(df, name))[1])
    index = TextIndex.build(rows, str(tmp_path / "index"), buckets=4)
    assert "index-hits" not in written
    monkeypatch.setattr(text_index, "TASK_HITS", 2)
    plan = search.parse(spark, "engineer services")
    hits = index.hits(plan.terms)
    assert hits.count() == 8 and hits.rdd.getNumPartitions() == 4
    assert "Join" not in search.find(hits, plan)._jdf.queryExecution().executedPlan().toString()


def test_nearness_across_stretches(spark):
    """Pairs count over the ends of stretches of places, once each, up to their reach."""
    rows = spark.createDataFrame([(1, "x", " ".join(["alpha", *["z"] * 97, "alpha", "beta", *["z"] * 40, "beta"]))], "id long, title string, description_text string")
    at_a, at_b = (2, 100), (101, 142)
    rest = 1.0
    for a in at_a:
        for b in at_b:
            if b - a <= search.REACH:
                rest *= 1 - 0.4 * search.nearness(b - a)
    assert [r.rank for r in search.search(rows, "alpha beta").collect()] == [pytest.approx(1 - rest)]
