from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.bindings import AS_OF, bound
from jobloom.operators import account, feed, maintenance, scoring
from jobloom.operators.feed import FeedFilter, FilterError, parse_query
from jobloom.plans.queries import PROFILE, live_feed, with_skills

NOW = dt.datetime(2026, 1, 31)
DAYS = lambda n: NOW - dt.timedelta(days=n)
SCHEMA = """id long, title string, country string, mode string, yoe_min int, yoe_confidence double, comp_min double, comp_max double, comp_currency string, field string, posted_at timestamp_ntz,
  first_seen_at timestamp_ntz, vendor string, status string"""
ROWS = [
    (1, "a", "IN", "remote", 3, None, 4000000.0, None, "INR", "software", DAYS(1), DAYS(1), "greenhouse", "live"),
    (2, "b", "US", "remote", 6, None, 150000.0, 180000.0, "USD", "software", DAYS(2), DAYS(2), "ashby", "live"),
    (3, "c", "US", "onsite", 9, None, None, 120000.0, "USD", "software", DAYS(3), DAYS(3), "ashby", "live"),
    (4, "d", "GB", "hybrid", 1, None, 90000.0, 100000.0, "GBP", "software", DAYS(4), DAYS(4), "greenhouse", "live"),
    (5, "e", None, "remote", 4, None, 100.0, None, "USD", "software", None, DAYS(5), "ashby", "live"),
    (6, "f", "US", "unknown", None, 0.9, 100.0, None, "USD", "unknown", DAYS(6), DAYS(6), "ashby", "live"),
    (7, "g", "US", "remote", 2, 0.4, None, None, None, "software", DAYS(7), DAYS(7), "greenhouse", "live"),
    (8, "h", "US", "remote", 2, 0.9, None, None, None, "other", DAYS(8), DAYS(8), "greenhouse", "live"),
    (9, "i", "US", "remote", 2, 0.9, None, None, None, "software", DAYS(120), DAYS(120), "greenhouse", "live"),
    (10, "j", "US", "remote", 2, 0.9, None, None, None, "software", DAYS(1), DAYS(1), "greenhouse", "closed"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    "query,want",
    [
        ("", {1, 2, 3, 4, 5, 6, 7, 9}), ("country=IN", {1, 5}), ("mode=remote", {1, 2, 5, 7, 9}), ("yoe=3-5", {1, 5, 6, 7}), ("yoe=7", {2, 6, 7}), ("yoe=nonsense", {1, 2, 3, 4, 5, 6, 7, 9}), ("comp_min=110000", {2, 3, 4, 7, 9}),
        ("comp_min=110000&disclosed=1", {2, 4}), ("disclosed=1", {1, 2, 4, 5, 6}), ("field=other", {8}), ("field=all&posted=7d", {1, 2, 3, 4, 5, 6, 7}), ("vendor=ashby", {2, 3, 5, 6}), ("country=US&mode=onsite", {3}),
    ],
)
def test_filters_give_exact_sets(rows, query, want):
    assert {r.id for r in rows.where(feed.predicate(parse_query(query), NOW.isoformat())).select("id").collect()} == want


def test_a_repeated_skill_matches_nothing(rows, spark):
    skills = spark.createDataFrame([(1, "go"), (1, "sql"), (2, "go")], "posting_id long, skill string")
    assert [r.id for r in feed.with_all_skills(rows, skills, ("go", "sql")).collect()] == [1]
    assert feed.with_all_skills(rows, skills, ("go", "go")).count() == 0


@pytest.mark.parametrize("query", ["page=2", "limit=0", "limit=51", "limit=x", "sort=best", "posted=2d", "comp_min=a"])
def test_bad_queries(query):
    with pytest.raises(FilterError):
        parse_query(query)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text(min_size=1), st.integers() | st.text()))
def test_cursors_round_trip(values):
    assert feed.decode_cursor(feed.encode_cursor(values)) == values


def test_keyset_walk_is_the_whole_order(rows):
    f, seen, cursor = FeedFilter(field="all", limit=3), [], ""
    for _ in range(5):
        got = feed.collect_page(rows, FeedFilter(field="all", limit=3, cursor=cursor), NOW.isoformat())
        seen += [r.id for r in got.rows]
        cursor = got.cursor
        if not cursor:
            break
    whole = rows.where(feed.predicate(f, NOW.isoformat())).orderBy(feed.freshness().desc(), rows["id"].desc()).collect()
    assert seen == [r.id for r in whole]


def test_scores_stay_in_bounds_and_unreadable_scores_zero(spark, sf_dir):
    out = scoring.score(with_skills(spark, sf_dir, live_feed(spark, sf_dir)), PROFILE, AS_OF).collect()
    assert all(0 <= r.score <= 100 and 0 <= r.confidence <= 1 for r in out)
    assert all(r.score == 0 and r.band == "unlikely" for r in out if r.parse_confidence is None or r.parse_confidence < 0.4)
    assert all(r.evidence >= 1 for r in out if r.band == "strong")


def test_score_arithmetic(spark):
    row = (["go", "mysql", "x"], [], 5, None, 0.9, "US", "remote", 100000.0, None, "USD", NOW - dt.timedelta(days=7), 0.8)
    schema = "must array<string>, nice array<string>, yoe_min int, yoe_max int, yoe_confidence double, country string, mode string, comp_min double, comp_max double, comp_currency string, posted_at timestamp_ntz, parse_confidence double"
    p = scoring.Profile(skills=("go", "postgresql"), total_yoe=4, countries=("US",), modes=("onsite",), comp_min=90000, currency="USD")
    got = scoring.score(spark.createDataFrame([row], schema), p, NOW.isoformat()).first()
    assert got.skills_score == pytest.approx(40 * 1.5 / 3) and got.experience_score == 16 and got.location_score == 7.5 and got.compensation_score == 12 and got.freshness_score == pytest.approx(5)
    assert got.score == pytest.approx(round((20 + 16 + 7.5 + 12 + 5) / 100 * 1000) / 10) and got.missing == ["x"] and got.headline == "2 of 3 must-haves; lacks x"


def test_duplicates_are_antisymmetric(spark, sf_dir):
    pairs = {(r.loser_id, r.keeper_id) for r in maintenance.duplicate_pairs(bound(spark, sf_dir, "job_postings")).collect()}
    assert not pairs & {(b, a) for a, b in pairs}


def test_empty_seen_list_closes_a_polled_source_only(spark):
    p = spark.createDataFrame([(1, 1, "a", "live", 1, None), (2, 1, "b", "live", 0, None), (3, 2, "c", "live", 1, None)], "id long, source_id long, external_id string, status string, missing_count int, closed_at timestamp_ntz")
    out = maintenance.reconcile_absent(p, p.limit(0).select("source_id", "external_id"), spark.createDataFrame([(1,)], "source_id long"), AS_OF)
    assert {(r.id, r.status, r.missing_count) for r in out.collect()} == {(1, "closed", 2), (2, "live", 1), (3, "live", 1)}


def test_children_boards_and_export(spark):
    old = spark.createDataFrame([(1, "go"), (1, "sql"), (2, "go")], "posting_id long, skill string")
    new = spark.createDataFrame([(1, "rust"), (1, "unknown")], "posting_id long, skill string")
    words = spark.createDataFrame([("go",), ("rust",), ("sql",)], "skill string")
    assert {tuple(r) for r in maintenance.replace_children(old, new, words, "posting_id", "skill").collect()} == {(1, "rust"), (2, "go")}
    boards = spark.createDataFrame([(1, "ashby", "x"), (2, "ashby", "y")], "id long, vendor string, board_token string")
    listed = spark.createDataFrame([("ashby", "y"), ("keka", "z")], "vendor string, board_token string")
    assert {tuple(r) for r in maintenance.register_boards(boards, listed).collect()} == {(2, "ashby", "y"), (None, "keka", "z")}
    with pytest.raises(ValueError):
        maintenance.register_boards(boards, listed.limit(0))
    assert maintenance.append_new(old, old.unionByName(new), ["posting_id", "skill"]).count() == 5
    users = spark.createDataFrame([(1, 5, 4.0, "t", ["US"], [], None), (2, 0, None, None, [], [], None)], "id long, n_skills int, total_yoe double, current_title string, countries array<string>, modes array<string>, comp_min double")
    assert {(r.id, r.strength) for r in account.profile_strength(users).collect()} == {(1, 67), (2, 0)}
    assert account.export({"users": users, "applications": spark.createDataFrame([(1, 7)], "user_id long, id long")}, 1).count() == 2


def test_pages_read_query_skills_bands_dismissals_and_sorts(spark, rows):
    from pyspark.sql import functions as F

    bodies = {1: "go and spark", 2: "spark spark spark", 3: "java", 4: "go", 5: "spark"}
    text = F.create_map(*(F.lit(x) for kv in bodies.items() for x in kv))
    full = rows.withColumns({"description_text": text[F.col("id").cast("int")], "yoe_max": F.lit(None).cast("int"), "parse_confidence": F.lit(0.9)})
    skills = spark.createDataFrame([(1, "go", "must_have"), (1, "sql", "must_have"), (2, "rust", "must_have"), (2, "sql", "must_have"), (4, "go", "must_have"), (4, "c", "must_have")], "posting_id long, skill string, requirement string")
    dismissed = spark.createDataFrame([(7, 1), (8, 2)], "user_id long, posting_id long")
    profile = scoring.Profile(skills=("go", "sql"))
    more = {"posting_skills": skills, "dismissed": dismissed, "profile": profile}
    ids = lambda query, **x: [r.id for r in feed.page(full, parse_query(query), NOW.isoformat(), **{**more, **x}).collect()]
    assert ids("q=spark") == [1, 2, 5] and ids("q=spark&sort=relevance") == [2, 5, 1] and ids("sort=relevance") == ids("")
    assert ids("skills=go,sql") == [1] and ids("skills=sql") == [1, 2]
    assert 1 not in ids("", viewer=7) and 1 in ids("dismissed=1", viewer=7) and 1 in ids("")
    best = scoring.ranked(feed.matching(full, FeedFilter(), NOW.isoformat()).join(feed.skill_arrays(skills).withColumnRenamed("posting_id", "id"), "id", "left"), profile, NOW.isoformat(), limit=50).collect()
    assert ids("sort=match") == [r.id for r in best] and best[0].id == 1 and ids("sort=match") != ids("")
    assert ids("band=strong,stretch") == [r.id for r in best if r.band in ("strong", "stretch")] and 0 < len(ids("band=strong")) < len(best)
    for query in ("limit=2&sort=match", "limit=2&q=spark&sort=relevance"):
        f, seen, cursor = parse_query(query), [], ""
        for _ in range(6):
            got = feed.collect_page(full, parse_query(f"{query}&cursor={cursor}"), NOW.isoformat(), **more)
            seen, cursor = seen + [r.id for r in got.rows], got.cursor
            if not cursor:
                break
        assert f.limit == 2 and seen == ids(query.replace("limit=2&", ""))
    for query, without in (("skills=go", {"posting_skills": None}), ("band=strong", {"profile": None}), ("sort=match", {"profile": None}), ("", {"viewer": 7, "dismissed": None})):
        with pytest.raises(FilterError):
            ids(query, **without)
    places = spark.createDataFrame([(5, 0), (99, 1), (2, 2)], "id long, place int")
    assert [r.id for r in feed.rehydrate(places, full).collect()] == [5, 2]


def test_upsert_keeps_markup_and_gives_ids(spark):
    schema = "id long, source_id long, external_id string, description_text string, description_html string, posted_at timestamp_ntz, posted_at_is_estimate boolean, parse_confidence double, status string"
    old = spark.createDataFrame([(5, 1, "a", "text", "<p>text</p>", DAYS(3), False, 0.8, "closed")], schema)
    seen = spark.createDataFrame([(1, "a", "", "", DAYS(1), False, 0.2), (1, "b", "new", "<b>new</b>", DAYS(1), True, 0.5)], "source_id long, external_id string, description_text string, description_html string, posted_at timestamp_ntz, posted_at_is_estimate boolean, parse_confidence double")
    out = {r.external_id: r for r in maintenance.upsert_postings(old, seen, NOW.isoformat()).collect()}
    assert (out["a"].id, out["a"].description_text, out["a"].description_html, out["a"].status, out["a"].parse_confidence, out["a"].posted_at) == (5, "text", "<p>text</p>", "live", 0.8, DAYS(3))
    again = {r.external_id: r for r in maintenance.upsert_postings(old, seen, NOW.isoformat()).collect()}
    assert out["b"].id is not None and out["b"].id == again["b"].id and out["b"].description_html == "<b>new</b>"


def test_lists_and_profiles(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([([" Go", "go ", "", "SQL", "Go", "sql"],), ([],), (None,)], "x array<string>").select(account.ordered_distinct(F.col("x")).alias("x")).collect()
    assert [r.x for r in row] == [["Go", "SQL"], [], None]
    skills = spark.createDataFrame([(1, "sql", None, "manual"), (1, "go", 3.0, "resume"), (1, "go", 1.0, "resume")], "user_id long, skill string, years double, origin string")
    r = account.profile_skills(skills).first()
    assert (r.years, r.manual, r.resume) == ({"go": 3.0, "sql": 0.0}, ["sql"], ["go"])


def test_due_polls_withdrawals_and_blanking(spark):
    now = NOW.isoformat()
    sources = spark.createDataFrame([(1, "a", DAYS(1), None, 3, DAYS(9)), (2, "paused", DAYS(1), None, 0, DAYS(9)), (3, "b", DAYS(2), DAYS(-1), 0, DAYS(9)), (4, "c", DAYS(-1), None, 0, DAYS(9)), (5, "b", DAYS(3), DAYS(1), 0, DAYS(9))],
                                    "id long, tier string, next_poll_at timestamp_ntz, disabled_until timestamp_ntz, consecutive_errors int, last_changed_at timestamp_ntz")
    due = maintenance.claim_due(sources, now, 5).collect()
    assert [r.id for r in sorted(due, key=lambda r: -r.id)] == [5, 1]
    assert all(0 <= (r.next_poll_at - NOW - dt.timedelta(hours={"a": 2, "b": 6}[r.tier])).total_seconds() < 300 for r in due)
    after = {r.id: r for r in maintenance.poll_succeeded(sources, spark.createDataFrame([(1, True), (3, False)], "id long, changed boolean"), now).collect()}
    assert after[1].consecutive_errors == 0 and after[1].last_changed_at == NOW and after[3].last_changed_at == DAYS(9) and after[3].disabled_until == DAYS(-1)
    resumes = spark.createDataFrame([(1, DAYS(1), "t", "f"), (2, DAYS(-1), "t", "f"), (3, None, "t", "f")], "id long, retain_until timestamp_ntz, parsed_text string, file_name string")
    assert {r.id: r.parsed_text for r in maintenance.blank_expired(resumes, now).collect()} == {1: None, 2: "t", 3: "t"}
    consents = spark.createDataFrame([(1, 7, "mail", DAYS(3), None), (2, 7, "mail", DAYS(2), None), (3, 8, "mail", DAYS(2), None)], "id long, user_id long, purpose string, granted_at timestamp_ntz, withdrawn_at timestamp_ntz")
    out = {r.id: r.withdrawn_at for r in account.withdraw(consents, spark.createDataFrame([(7, "mail")], "user_id long, purpose string"), now).collect()}
    assert out == {1: None, 2: NOW, 3: None}
    rows = spark.createDataFrame([(1, 1, "superseded", 2), (2, 1, "live", None), (3, 2, "superseded", 2)], "id long, source_id long, status string, canonical_id long")
    assert {(r.id, r.status, r.canonical_id) for r in maintenance.undo_in_source(rows).collect()} == {(1, "live", None), (2, "live", None), (3, "superseded", 2)}


def test_display_names(spark):
    from jobloom.functions.text import display_name
    from jobloom.functions.vocabulary import DISPLAY

    names = {"postgresql": "PostgreSQL", "node.js": "Node.js", "docker": "Docker", "distributed systems": "Distributed Systems", " big  data": "Big Data", "éclair": "Éclair", "": "", "SQL": "SQL"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", display_name(F.col("n"), DISPLAY).alias("d")).collect()
    assert {r.n: r.d for r in rows} == names


def test_dismissals_keep_a_reason_that_is_not_given_again(spark):
    old = spark.createDataFrame([(1, 1, "far"), (1, 2, None), (2, 1, "old")], "user_id int, posting_id int, reason string")
    new = spark.createDataFrame([(1, 1, None), (1, 2, "pay"), (2, 1, "new"), (3, 9, None)], "user_id int, posting_id int, reason string")
    assert {tuple(r) for r in account.dismiss(old, new).collect()} == {(1, 1, "far"), (1, 2, "pay"), (2, 1, "new"), (3, 9, None)}


def test_items_of_rows_that_lack_columns(spark):
    rows = spark.createDataFrame([(1, "t"), (2, None)], "id long, title string")
    skills = spark.createDataFrame([(1, "sql", "must_have"), (1, "aws", "must_have"), (1, "go", "mentioned"), (2, "go", "mentioned"), (3, "go", "must_have")], "posting_id long, skill string, requirement string")
    got = {r.id: r for r in feed.items(rows, skills, spark.createDataFrame([(7, 2)], "user_id long, posting_id long"), 7).collect()}
    assert (got[1].must_have, got[1].must_canon, got[1].nice_canon, got[1].saved) == (["AWS", "SQL"], ["aws", "sql"], [], False)
    assert (got[2].must_have, got[2].nice_canon, got[2].saved, got[2].location_raw, got[2].yoe_confidence, got[2].comp_min) == ([], ["go"], True, "", 0.0, None)
