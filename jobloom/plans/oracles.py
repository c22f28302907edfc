"""The queries in plain SQL, for an engine that shares nothing with Spark.

Every text names the bound tables through ``with_tables``. ``STRING`` is a type name that
both engines know.
"""

from __future__ import annotations

from ..bindings import AS_OF, EVENTS_AS_OF, with_tables
from ..functions import extract, places, resume, stemming
from ..functions.text import NOT_SOFTWARE, OTHER_ENGINEERING, PAY, PAY_WORD, SOFTWARE
from ..operators.feed import USD_RATES
from . import polling
from .feeds import SOURCE_SQL
from .queries import EXCLUDING, FIRST_DAY, LAST_DAY, PROFILE, SEARCH, VIEWER

ORACLES: dict[str, str] = {}


def _sql(name: str, tables: tuple[str, ...], body: str, more: str = "") -> None:
    ctes = ",\n".join(x for x in (with_tables(*tables), more.strip().rstrip(",")) if x)
    ORACLES[name] = f"WITH {ctes}\n{body}"


FEED = ("job_postings", "sources", "companies")
LIVE = """feed AS (
  SELECT p.*, c.name AS company, c.slug, s.vendor, s.tier, coalesce(p.posted_at, p.first_seen_at) AS fresh_at
  FROM job_postings p JOIN companies c ON p.company_id = c.id JOIN sources s ON p.source_id = s.id)"""
_USD = "coalesce(comp_min, 0) / CASE comp_currency " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in USD_RATES.items()) + " ELSE 1.0::DOUBLE END"
_NOW = f"TIMESTAMP '{AS_OF}'"

for _name, _where in {
    "feed_countries": "(country IN ('N1','N3') OR country IS NULL)",
    "feed_modes": "mode IN ('remote','hybrid') AND field <> 'other'",
    "feed_yoe_bands": "(yoe_confidence < 0.5 OR yoe_min IS NULL OR yoe_min BETWEEN 3 AND 5 OR yoe_min >= 9)",
    "feed_comp_floor": f"({_USD} >= 150000 OR comp_min IS NULL)",
    "feed_comp_floor_disclosed": f"{_USD} >= 150000 AND comp_min IS NOT NULL AND field <> 'other'",
    "feed_disclosed": "comp_min IS NOT NULL AND field = 'software'",
    "feed_field_default": "field <> 'other'",
    "feed_posted_within": f"fresh_at >= {_NOW} - INTERVAL '336' HOUR",
    "feed_posted_after": "fresh_at > TIMESTAMP '2001-06-01 00:00:00'",
    "feed_vendor": "vendor IN ('ashby','workday')",
}.items():
    _sql(_name, FEED, f"SELECT id, company, vendor, title FROM feed WHERE status = 'live' AND {_where}", LIVE)

_sql("feed_newest", FEED, f"""SELECT id, company, vendor, title, fresh_at AS sort_key FROM feed
WHERE status = 'live' AND field <> 'other' AND fresh_at >= {_NOW} - INTERVAL '336' HOUR ORDER BY fresh_at DESC, id DESC LIMIT 26""", LIVE)
_sql("feed_comp_usd", FEED, f"SELECT id, comp_currency, round(u, 2) AS usd FROM (SELECT *, {_USD} AS u FROM feed WHERE status = 'live') ORDER BY u DESC, id DESC LIMIT 26", LIVE)
_sql("feed_keyset_page2", FEED, """SELECT id, fresh_at AS sort_key FROM feed WHERE status = 'live'
AND (fresh_at < TIMESTAMP '2001-07-01 00:00:00' OR (fresh_at = TIMESTAMP '2001-07-01 00:00:00' AND id < 1000)) ORDER BY fresh_at DESC, id DESC LIMIT 26""", LIVE)
_sql("feed_not_dismissed", (*FEED, "dismissed_postings"), f"""SELECT id FROM feed WHERE status = 'live' AND field <> 'other'
AND NOT EXISTS (SELECT 1 FROM dismissed_postings d WHERE d.user_id = {VIEWER} AND d.posting_id = feed.id)""", LIVE)
_sql("feed_saved_flag", (*FEED, "applications"), f"""SELECT id, id IN (SELECT posting_id FROM applications WHERE user_id = {VIEWER}) AS saved FROM feed WHERE status = 'live'""", LIVE)
_sql("feed_skills_all", (*FEED, "posting_skills"), """SELECT id FROM feed WHERE id IN (
  SELECT posting_id FROM posting_skills WHERE skill IN (SELECT skill FROM top) GROUP BY posting_id HAVING count(DISTINCT skill) = 2)""",
     LIVE + ", top AS (SELECT skill FROM posting_skills GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 2)")

SKILLS = """lists AS (
  SELECT posting_id, coalesce(list(skill ORDER BY skill) FILTER (requirement = 'must_have'), []) AS must,
    CASE WHEN bool_or(requirement IN ('must_have', 'nice_to_have')) THEN coalesce(list(skill ORDER BY skill) FILTER (requirement = 'nice_to_have'), [])
      ELSE coalesce(list(skill ORDER BY skill) FILTER (requirement = 'mentioned'), []) END AS nice
  FROM posting_skills GROUP BY posting_id)"""
_sql("posting_skill_arrays", ("posting_skills",), "SELECT posting_id, array_to_string(must, ',') AS must, array_to_string(nice, ',') AS nice FROM lists", SKILLS)

_own = "[" + ", ".join(f"'{s}'" for s in PROFILE.skills) + "]"
_near = "[" + ", ".join(f"'{k}'" for k, v in PROFILE.adjacent.items() if set(v) & set(PROFILE.skills)) + "]"
_points = lambda x: f"(len(list_filter({x}, lambda s: list_contains({_own}, lower(s)))) + 0.5 * len(list_filter({x}, lambda s: NOT list_contains({_own}, lower(s)) AND list_contains({_near}, lower(s)))))"
_hits = lambda x: f"len(list_filter({x}, lambda s: list_contains({_own}, lower(s)) OR list_contains({_near}, lower(s))))"
_places = "(" + ", ".join(f"'{c}'" for c in PROFILE.countries) + ")"
_modes = "(" + ", ".join(f"'{c}'" for c in (*PROFILE.modes, "unknown")) + ")"
SCORED = f"""{SKILLS}, rows0 AS (
  SELECT f.*, coalesce(must, []) AS mu, coalesce(nice, []) AS ni FROM feed f LEFT JOIN lists ON f.id = posting_id),
parts AS (
  SELECT *, parse_confidence >= 0.4 AS readable, len(mu) + len(ni) > 0 AS stated,
    CASE WHEN len(mu) + len(ni) > 0 THEN least(1.0, (len(mu) + 0.5 * len(ni)) / 2.0) ELSE 0.0 END::DOUBLE AS evidence,
    CASE WHEN len(mu) = 0 THEN 0.0 WHEN len(ni) = 0 THEN 1.0 ELSE 0.75 END::DOUBLE AS ratio,
    CASE WHEN len(mu) = 0 THEN 1.0 ELSE {_points('mu')}::DOUBLE / len(mu) END AS cover_must,
    CASE WHEN len(ni) = 0 THEN 1.0 ELSE {_points('ni')}::DOUBLE / len(ni) END AS cover_nice,
    list_sort(list_filter(mu, lambda s: NOT list_contains({_own}, lower(s)) AND NOT list_contains({_near}, lower(s)))) AS gaps,
    CASE WHEN coalesce(yoe_confidence, 0) >= 0.5 AND yoe_min IS NOT NULL THEN
      greatest(0.0, 20.0 - greatest(0.0, yoe_min - {PROFILE.total_yoe}) * 4 - coalesce(greatest(0.0, {PROFILE.total_yoe} - yoe_max), 0) * 8) END::DOUBLE AS experience,
    CASE WHEN mode = 'remote' THEN 15.0 WHEN (country IS NULL OR country IN {_places}) AND mode IN {_modes} THEN 15.0 WHEN country IS NULL OR country IN {_places} THEN 7.5 ELSE 0.0 END::DOUBLE AS place,
    CASE WHEN comp_min IS NOT NULL AND comp_currency = '{PROFILE.currency}' THEN CASE WHEN coalesce(comp_max, comp_min) >= {PROFILE.comp_min} * 1.2 THEN 15.0
      WHEN coalesce(comp_max, comp_min) >= {PROFILE.comp_min} THEN 12.0 WHEN coalesce(comp_max, comp_min) >= {PROFILE.comp_min} * 0.85 THEN 6.0 ELSE 0.0 END END::DOUBLE AS pay,
    CASE WHEN posted_at IS NOT NULL THEN 10.0 * pow(0.5, greatest(0.0, (epoch_us({_NOW}) - epoch_us(posted_at)) / 86400e6) / 7.0) END::DOUBLE AS fresh
  FROM rows0),
summed AS (
  SELECT *, CASE WHEN stated THEN 40.0 * ((ratio * cover_must + (1 - ratio) * cover_nice) * evidence + 0.25 * (1 - evidence)) END AS skill FROM parts),
totals AS (
  SELECT *, coalesce(skill, 0) + coalesce(experience, 0) + place + coalesce(pay, 0) + coalesce(fresh, 0) + CASE WHEN evidence = 0 THEN 10.0 ELSE 0.0 END AS earned,
    CASE WHEN skill IS NULL THEN 0.0 ELSE 40.0 END + CASE WHEN experience IS NULL THEN 0.0 ELSE 20.0 END + 15.0 + CASE WHEN pay IS NULL THEN 0.0 ELSE 15.0 END
      + CASE WHEN fresh IS NULL THEN 0.0 ELSE 10.0 END + CASE WHEN evidence = 0 THEN 40.0 ELSE 0.0 END AS available FROM summed),
scored0 AS (SELECT *, CASE WHEN readable THEN round(earned / available::DOUBLE * 1000) / 10 ELSE 0.0 END AS score FROM totals),
scored AS (
  SELECT *, CASE WHEN NOT readable THEN 'unlikely' WHEN score >= 70 AND evidence >= 1 THEN 'strong' WHEN score >= 50 THEN 'plausible' WHEN score >= 30 THEN 'stretch' ELSE 'unlikely' END AS band,
    CASE WHEN NOT readable THEN 0.0 WHEN evidence >= 1 THEN least({PROFILE.parse_confidence}, parse_confidence) ELSE least({PROFILE.parse_confidence}, parse_confidence) * (0.5 + 0.5 * evidence) END AS confidence,
    concat(CASE WHEN len(mu) > 0 THEN concat({_hits('mu')}, ' of ', len(mu), ' must-haves') ELSE concat({_hits('ni')}, ' of ', len(ni), ' preferred skills') END,
      CASE WHEN evidence < 1 THEN ' (few requirements stated)' ELSE '' END) AS detail
  FROM scored0)"""
_sql("feed_scored", (*FEED, "posting_skills"), """SELECT id, round(CASE WHEN readable THEN skill END, 4) AS skills_score, round(CASE WHEN readable THEN experience END, 4) AS experience_score,
  round(CASE WHEN readable THEN place END, 4) AS location_score, round(CASE WHEN readable THEN pay END, 4) AS compensation_score, round(CASE WHEN readable THEN fresh END, 4) AS freshness_score,
  score, band, round(confidence, 4) AS confidence, array_to_string(gaps, ',') AS missing,
  CASE WHEN NOT readable THEN 'Unscored: too little could be read' WHEN NOT stated THEN 'No skills named; scored on the other parts'
    WHEN len(gaps) > 0 THEN concat(detail, '; lacks ', array_to_string(gaps[1:3], ', '), CASE WHEN len(gaps) > 3 THEN concat(' +', len(gaps) - 3, ' more') ELSE '' END)
    ELSE concat(detail, '; nothing is missing') END AS headline
FROM scored WHERE status = 'live'""", f"{LIVE}, {SCORED}")
_sql("feed_ranked", (*FEED, "posting_skills"), """SELECT id, score, band FROM (SELECT * FROM scored WHERE status = 'live' AND field <> 'other' ORDER BY fresh_at DESC, id DESC LIMIT 2000)
ORDER BY score DESC, posted_at DESC NULLS LAST, fresh_at DESC, id DESC LIMIT 25""", f"{LIVE}, {SCORED}")
_sql("band_counts", (*FEED, "posting_skills"), """SELECT count(*) FILTER (band = 'strong') AS strong, count(*) FILTER (band = 'plausible') AS plausible, count(*) AS considered FROM scored WHERE status = 'live'""", f"{LIVE}, {SCORED}")

_sql("facets", FEED, """
SELECT 'mode' AS kind, mode AS value, count(*) AS n FROM live GROUP BY mode
UNION ALL SELECT 'country', coalesce(country, 'unknown'), count(*) FROM live GROUP BY 2
UNION ALL SELECT 'vendor', vendor, count(*) FROM live GROUP BY 2
UNION ALL SELECT 'field', field, count(*) FROM live GROUP BY 2
UNION ALL SELECT 'yoe', CASE WHEN yoe_min IS NULL THEN 'unstated' WHEN yoe_min <= 2 THEN '0-2' WHEN yoe_min <= 5 THEN '3-5' WHEN yoe_min <= 8 THEN '6-8' ELSE '9+' END, count(*) FROM live GROUP BY 2
UNION ALL SELECT 'comp', floor, count(*) FROM live, (VALUES ('100000'), ('150000'), ('200000')) f(floor) WHERE comp_max >= floor::DOUBLE GROUP BY 2
UNION ALL SELECT 'comp_undisclosed', 'n', count(*) FROM live WHERE comp_max IS NULL HAVING count(*) > 0""", LIVE + ", live AS (SELECT * FROM feed WHERE status = 'live')")
_sql("market_summary", ("job_postings",), f"""SELECT count(*) AS n_live, count(DISTINCT company_id) AS n_companies, count(*) FILTER (first_seen_at > {_NOW} - INTERVAL '7' DAY) AS n_new,
round(coalesce(avg((mode = 'remote')::INT), 0), 6) AS remote_share, round(coalesce(avg((field = 'software')::INT), 0), 6) AS software_share, round(coalesce(avg((field = 'unknown')::INT), 0), 6) AS unknown_share
FROM job_postings WHERE status = 'live'""")

DAILY_TABLES = ("job_postings", "sources", "posting_skills")
DAILY = f"""daily AS (
  SELECT s.id AS source_id, d.day::DATE AS day, count(*) FILTER (p.first_seen_at::DATE = d.day::DATE) AS postings_new, count(*) FILTER (p.closed_at::DATE = d.day::DATE) AS postings_closed,
    count(*) FILTER (ok) AS postings_live, count(*) FILTER (ok AND comp_min IS NOT NULL) AS known_comp, count(*) FILTER (ok AND (yoe_min IS NOT NULL OR yoe_max IS NOT NULL)) AS known_yoe,
    count(*) FILTER (ok AND mode IS NOT NULL AND mode <> 'unknown') AS known_mode, count(*) FILTER (ok AND p.id IN (SELECT posting_id FROM posting_skills)) AS known_skills
  FROM sources s CROSS JOIN generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL '1' DAY) d(day)
  LEFT JOIN (SELECT * FROM job_postings) p ON p.source_id = s.id
  LEFT JOIN LATERAL (SELECT p.status <> 'superseded' AND p.first_seen_at::DATE <= d.day::DATE AND (p.closed_at IS NULL OR p.closed_at::DATE > d.day::DATE) AS ok) l ON true
  GROUP BY s.id, d.day)"""
_sql("source_daily", DAILY_TABLES, "SELECT * FROM daily", DAILY)
_sql("coverage", DAILY_TABLES, """SELECT max(day) AS day, sum(postings_live)::BIGINT AS postings_live, sum(known_comp)::BIGINT AS known_comp, sum(known_yoe)::BIGINT AS known_yoe,
sum(known_mode)::BIGINT AS known_mode, sum(known_skills)::BIGINT AS known_skills FROM daily WHERE day = (SELECT max(day) FROM daily)""", DAILY)
_sql("ingest_series", DAILY_TABLES, """SELECT day, vendor, sum(postings_new)::BIGINT AS postings_new, sum(postings_closed)::BIGINT AS postings_closed, sum(postings_live)::BIGINT AS postings_live
FROM daily JOIN sources ON source_id = sources.id GROUP BY day, vendor""", DAILY)
_sql("activity_weeks", ("application_events",), f"""SELECT occurred_at::DATE AS day, count(*) AS n FROM application_events
WHERE occurred_at >= date_trunc('week', TIMESTAMP '{EVENTS_AS_OF}') - INTERVAL '14' DAY AND occurred_at <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1""")
OUT = """gaps AS (SELECT hr AS ends, lag(hr) OVER (ORDER BY hr) AS starts FROM (SELECT DISTINCT date_trunc('hour', first_seen_at)::TIMESTAMP AS hr FROM job_postings)),
outages AS (SELECT starts, ends FROM gaps WHERE ends - starts > INTERVAL '3' HOUR)"""
_sql("outages", ("job_postings",), "SELECT starts, ends FROM outages", OUT)
_LATENCY = """SELECT tier, vendor, count(*) AS postings, round(quantile_cont(m, 0.5), 1) AS p50_min, round(quantile_cont(m, 0.9), 1) AS p90_min, round(quantile_cont(m, 0.99), 1) AS p99_min,
CASE WHEN count(*) < 100 THEN 'no verdict: not enough rows' WHEN tier <> 'a' THEN 'no budget for this tier' WHEN quantile_cont(m, 0.5) > 90 THEN 'late: median over 90 minutes' ELSE 'on time' END AS verdict
FROM measured GROUP BY tier, vendor"""
_measured = lambda extra: f"""{OUT}, watch AS (SELECT source_id, min(first_seen_at) AS started FROM job_postings GROUP BY source_id),
measured AS (SELECT s.vendor, s.tier, (epoch_us(first_seen_at) - epoch_us(posted_at)) / 60e6 AS m FROM job_postings p JOIN sources s ON s.id = p.source_id JOIN watch w ON w.source_id = p.source_id
WHERE posted_at IS NOT NULL AND posted_at > started AND date_trunc('day', posted_at) <> posted_at AND first_seen_at >= posted_at {extra})"""  # noqa: E731
_sql("latency_pct", ("job_postings", "sources"), _LATENCY, _measured(""))
_sql("latency_without_outages", ("job_postings", "sources"), _LATENCY, _measured("AND NOT EXISTS (SELECT 1 FROM outages o WHERE o.starts < p.first_seen_at AND o.ends > p.posted_at)"))

_sql("pipeline_counts", ("applications",), f"""SELECT stage, place::INTEGER AS place, count(user_id) AS n FROM (VALUES ('saved', 0), ('applied', 1), ('screening', 2), ('interviewing', 3), ('offer', 4), ('rejected', 5)) s(stage, place)
LEFT JOIN applications ON status = stage AND user_id = {VIEWER} GROUP BY stage, place""")
_sql("needs_reply", ("applications",), f"""SELECT id, status, next_action_at FROM applications WHERE status IN ('applied', 'screening', 'interviewing')
AND (last_activity_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL '7' DAY OR next_action_at IS NOT NULL) ORDER BY next_action_at NULLS LAST, last_activity_at, id LIMIT 5""")
_sql("application_transitions", ("application_events",), """SELECT application_id, id, from_status, to_status FROM (
SELECT *, lag(to_status) OVER (PARTITION BY application_id ORDER BY occurred_at, id) AS from_status FROM application_events) WHERE from_status IS DISTINCT FROM to_status""")
_sql("application_replay", ("application_events",), """SELECT application_id, last(to_status ORDER BY occurred_at, id) AS status, count(*) AS n_events, max(occurred_at) AS last_activity_at FROM application_events GROUP BY application_id""")
_sql("high_water", ("job_postings",), "SELECT max(coalesce(posted_at, first_seen_at)) AS high_water FROM job_postings WHERE status = 'live'")
_sql("new_since", ("saved_searches", "job_postings"), """SELECT s.id, count(p.id) AS new_since FROM saved_searches s
LEFT JOIN job_postings p ON p.status = 'live' AND coalesce(p.posted_at, p.first_seen_at) > s.last_seen_max_posted_at GROUP BY s.id""")
_sql("consent_latest", ("user_consents",), """SELECT id, user_id, purpose, granted_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, purpose ORDER BY granted_at DESC, id DESC) AS n
FROM user_consents WHERE withdrawn_at IS NULL) WHERE n = 1""")
_sql("digest_candidates", ("saved_searches", "users", "user_consents"), """SELECT u.id AS user_id, u.email, s.id AS search_id, s.name, greatest(coalesce(s.last_seen_max_posted_at, s.created_at), s.last_digest_at) AS since
FROM saved_searches s JOIN users u ON u.id = s.user_id WHERE u.deleted_at IS NULL
AND EXISTS (SELECT 1 FROM user_consents c WHERE c.user_id = u.id AND c.purpose = 'digest_email' AND c.withdrawn_at IS NULL)
AND (s.last_digest_at IS NULL OR s.last_digest_at < TIMESTAMP '2024-01-20 00:00:00') ORDER BY u.id, s.id LIMIT 500""")
ORACLES["visit_sessions"] = """WITH marked AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6' HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opened FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts) AS visit FROM marked)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL '6' HOUR AS ended, count(*) AS n FROM numbered GROUP BY user_id, visit"""
_sql("merged_spans", ("job_postings",), """SELECT company_id, min(a) AS a, max(b) AS b FROM (
  SELECT *, sum(opened) OVER (PARTITION BY company_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY company_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opened FROM spans))
GROUP BY company_id, island""", "spans AS (SELECT company_id, first_seen_at::DATE AS a, first_seen_at::DATE + (id % 200)::INT AS b FROM job_postings)")

_words = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
_grams = lambda x: f"list_distinct(flatten(list_transform(list_transform({_words(x)}, lambda w: concat('  ', w, ' ')), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))))"
_similar = lambda a, b: f"(len(list_intersect({_grams(a)}, {_grams(b)}))::DOUBLE / greatest(1, len(list_distinct(list_concat({_grams(a)}, {_grams(b)})))))"
PAIRS = f"""close AS (
  SELECT a.id AS loser_id, b.id AS keeper_id, {_similar('a.title', 'b.title')} AS sim FROM job_postings a JOIN job_postings b ON a.company_id = b.company_id AND a.source_id <> b.source_id
  WHERE a.status = 'live' AND b.status = 'live' AND (a.city IS NOT DISTINCT FROM b.city OR a.city IS NULL OR b.city IS NULL) AND (a.mode = b.mode OR a.mode = 'unknown' OR b.mode = 'unknown')
    AND (b.parse_confidence > a.parse_confidence OR (b.parse_confidence = a.parse_confidence AND (length(b.description_text) > length(a.description_text)
      OR (length(b.description_text) = length(a.description_text) AND (b.first_seen_at < a.first_seen_at OR (b.first_seen_at = a.first_seen_at AND b.id < a.id))))))),
pairs AS (SELECT loser_id, keeper_id FROM (SELECT *, row_number() OVER (PARTITION BY loser_id ORDER BY sim DESC, keeper_id) AS n FROM close WHERE sim >= 0.9) WHERE n = 1)"""
_sql("dedupe_pairs", ("job_postings",), "SELECT loser_id, keeper_id FROM pairs", PAIRS)
_sql("dedupe_after", ("job_postings",), "SELECT id, CASE WHEN loser_id IS NULL THEN status ELSE 'superseded' END AS status, keeper_id AS canonical_id FROM job_postings LEFT JOIN pairs ON id = loser_id", PAIRS)
_sql("upsert_after", ("job_postings",), f"""SELECT coalesce(o.id, ('0x' || substr(md5(n.source_id || '/' || n.external_id), 1, 15))::BIGINT) AS id, coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.external_id, n.external_id) AS external_id,
  CASE WHEN n.source_id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.source_id IS NULL OR (n.body = '' AND o.source_id IS NOT NULL) THEN o.description_text ELSE n.body END AS description_text,
  CASE WHEN n.source_id IS NULL OR (n.body = '' AND o.source_id IS NOT NULL) THEN concat('<p>', o.description_text, '</p>') WHEN n.body = '' THEN '' ELSE concat('<p>', n.body, '</p>') END AS description_html,
  CASE WHEN n.source_id IS NULL THEN o.posted_at WHEN o.source_id IS NULL OR o.posted_at_is_estimate OR o.posted_at IS NULL THEN n.posted_at ELSE o.posted_at END AS posted_at,
  CASE WHEN n.source_id IS NULL THEN o.posted_at_is_estimate ELSE false END AS posted_at_is_estimate,
  round(CASE WHEN n.source_id IS NULL THEN o.parse_confidence WHEN n.body <> '' OR o.source_id IS NULL THEN n.conf ELSE greatest(o.parse_confidence, n.conf) END, 4) AS parse_confidence,
  CASE WHEN n.source_id IS NULL THEN o.status ELSE 'live' END AS status, CASE WHEN n.source_id IS NULL THEN o.closed_at END AS closed_at, CASE WHEN n.source_id IS NULL THEN o.missing_count ELSE 0 END AS missing_count
FROM job_postings o FULL JOIN seen n ON o.source_id = n.source_id AND o.external_id = n.external_id""", """seen AS (
  SELECT source_id, external_id, upper(title) AS title, CASE WHEN field = 'software' THEN 'new body' ELSE '' END AS body, posted_at + INTERVAL '1' DAY AS posted_at, parse_confidence / 2 + 0.3::DOUBLE AS conf FROM job_postings WHERE comp_max IS NOT NULL
  UNION ALL SELECT source_id, concat('n', external_id), upper(title), '', posted_at + INTERVAL '1' DAY, parse_confidence / 2 + 0.3::DOUBLE FROM job_postings WHERE mode = 'hybrid')""")
_sql("reconcile_after", ("job_postings", "sources"), f"""SELECT id, CASE WHEN gone AND missing_count + 1 >= 2 THEN 'closed' ELSE status END AS status, CASE WHEN gone THEN missing_count + 1 ELSE missing_count END AS missing_count,
  CASE WHEN gone AND missing_count + 1 >= 2 THEN {_NOW} ELSE closed_at END AS closed_at FROM (SELECT *, status = 'live' AND source_id IN (SELECT id FROM sources WHERE vendor <> 'ashby') AND comp_max IS NULL AS gone FROM job_postings)""")
_sql("retier_after", ("sources", "watched_companies"), f"""SELECT id, CASE WHEN tier = 'paused' THEN tier WHEN EXISTS (SELECT 1 FROM watched_companies w WHERE w.company_id = s.company_id) THEN 'a'
  WHEN last_changed_at > {_NOW} - INTERVAL '7' DAY THEN 'a' WHEN last_changed_at > {_NOW} - INTERVAL '30' DAY THEN 'b' ELSE 'c' END AS tier FROM sources s""")
_sql("poll_failed_after", ("sources",), f"""SELECT id, CASE WHEN tier IN ('a', 'b') THEN consecutive_errors + 1 ELSE consecutive_errors END AS consecutive_errors,
  CASE WHEN tier IN ('a', 'b') AND vendor = 'ashby' THEN {_NOW} + INTERVAL '1' HOUR WHEN tier IN ('a', 'b') AND consecutive_errors + 1 >= 5 THEN {_NOW} + INTERVAL '6' HOUR END AS disabled_until FROM sources""")
ORACLES["changed_boards"] = "SELECT page_id AS source_id, sha256(coalesce(html, '')) AS content_hash FROM pages WHERE contains(url, '7')"
_sql("retention_after", ("users",), """SELECT id, CASE WHEN due THEN concat('deleted-', id::STRING, '@invalid') ELSE email END AS email, CASE WHEN due THEN TIMESTAMP '2024-02-10 00:00:00' ELSE deleted_at END AS deleted_at
FROM (SELECT *, coalesce(deleted_at IS NULL AND deletion_requested_at < TIMESTAMP '2024-02-10 00:00:00' - INTERVAL '7' DAY, false) AS due FROM users)""")
_sql("prune_after", ("job_postings", "applications"), """SELECT a.id, CASE WHEN p.id IS NULL THEN a.posting_id END AS posting_id FROM applications a LEFT JOIN job_postings p ON p.id = a.posting_id AND p.status = 'closed' AND p.comp_max IS NULL""")
_sql("backfill_yoe_confidence", ("job_postings",), "SELECT id, CASE WHEN yoe_confidence IS NOT NULL THEN yoe_confidence WHEN yoe_min IS NOT NULL THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS yoe_confidence FROM job_postings")

_html = "html"
for _pattern, _to in ((r"(?i)</(?:p|div|li|ul|ol|h[1-6]|br|tr)>|<br\s*/?>", "chr(10)"), ("<[^>]*>", "' '")):
    _html = f"regexp_replace({_html}, '{_pattern}', {_to}, 'g')"
for _entity, _to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&rsquo;", "''"), ("&ndash;", "-"), ("&mdash;", "-"), ("&amp;", "&")):
    _html = f"replace({_html}, '{_entity}', '{_to}')"
for _pattern, _to in ((r"[ \t]+", "' '"), (r"[ \t]*\n[ \t]*", "chr(10)"), (r"\n{3,}", "chr(10)||chr(10)"), (r"\A\s+|\s+\z", "''")):
    _html = f"regexp_replace({_html}, '{_pattern}', {_to}, 'g')"
ORACLES["strip_html"] = f"SELECT page_id, md5({_html}) AS text_md5 FROM pages"

_TO, _YEARS = "[-–—to]+", "(?:years?|yrs?)"
_get = lambda p, g=1: f"try_cast(nullif(regexp_extract(description_text, '{p}', {g}), '') AS INT)"
_range = rf"(?i)\b(\d{{1,2}})\s*{_TO}\s*(\d{{1,2}})\b\s*\+?\s*{_YEARS}"
_least = (rf"(?i)\b(\d{{1,2}})\s*\+\s*{_YEARS}", rf"(?i)(?:at least|minimum(?: of)?|min\.?)\s*\b(\d{{1,2}})\b\s*{_YEARS}", rf"(?i)\b(\d{{1,2}})\b\s*{_YEARS}\s+(?:of\s+)?(?:relevant\s+|professional\s+|industry\s+)?experience")
_sql("yoe_extract", ("job_postings",), f"""SELECT id, CASE WHEN lo <= hi AND hi <= 40 THEN lo ELSE n END AS min, CASE WHEN lo <= hi AND hi <= 40 THEN hi END AS max,
  CASE WHEN (lo <= hi AND hi <= 40) OR n IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT id, {_get(_range)} AS lo, {_get(_range, 2)} AS hi,
  CASE {" ".join(f"WHEN {_get(p)} BETWEEN 1 AND 30 THEN {_get(p)}" for p in _least)} END AS n FROM job_postings)""")
_sql("mode_classify", ("job_postings",), r"""SELECT id, CASE WHEN hybrid THEN 'hybrid' WHEN onsite AND mode = 'remote' THEN 'hybrid' WHEN onsite THEN 'onsite' WHEN mode = 'remote' THEN 'remote' WHEN remote THEN 'remote' ELSE mode END AS work_mode
FROM (SELECT id, mode, regexp_matches(h, '\bhybrid\b|\b\d\s*days?\s+(?:a\s+week\s+)?(?:in|at)\s+(?:the\s+)?office\b|\bin[- ]office\s+\d\s*days?') AS hybrid,
  regexp_matches(h, '\b(?:fully\s+)?remote\b|\bwork\s+from\s+home\b|\bdistributed\s+team\b|\bwfh\b') AS remote, regexp_matches(h, '\bon[- ]?site\b|\bin[- ]person\b|\bno\s+remote\b') AS onsite
  FROM (SELECT id, mode, lower(concat(coalesce(city, ''), chr(10), description_text)) AS h FROM job_postings))""")


def _first(needles: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{n}'" for n in needles)
    return f"list_filter([{listed}], lambda n: contains(t, n))[1]"


_sql("field_classify", ("job_postings", "posting_skills"), f"""SELECT id, CASE WHEN t = '' THEN 'unknown' WHEN other IS NOT NULL THEN 'other' WHEN soft IS NOT NULL THEN 'software' WHEN eng AND dom IS NOT NULL THEN 'other' WHEN n >= 6 THEN 'software' ELSE 'unknown' END AS guess,
  CASE WHEN t = '' THEN 0.0 WHEN other IS NOT NULL OR soft IS NOT NULL THEN 0.9 WHEN eng AND dom IS NOT NULL THEN 0.85 WHEN eng AND n >= 6 THEN 0.55 WHEN eng THEN 0.2 WHEN n >= 6 THEN 0.45 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN t = '' THEN 'no title to read' WHEN other IS NOT NULL THEN concat('the title says ', other) WHEN soft IS NOT NULL THEN concat('the title says ', soft) WHEN eng AND dom IS NOT NULL THEN concat('a ', dom, ' engineer')
    WHEN n >= 6 THEN concat(n, ' known skills in the description') WHEN eng THEN 'an engineer, but of what we cannot tell' ELSE 'nothing in the title or body we recognise' END AS because
FROM (SELECT *, {_first(NOT_SOFTWARE)} AS other, {_first(SOFTWARE)} AS soft, {_first(OTHER_ENGINEERING)} AS dom, contains(t, 'engineer') AS eng FROM (
  SELECT id, lower(trim(title)) AS t, coalesce((SELECT count(*) FROM posting_skills s WHERE s.posting_id = p.id), 0) AS n FROM job_postings p))""")
_sql("parse_confidence", ("job_postings", "posting_skills"), """SELECT id, ((title <> '')::INT + (octet_length(encode(description_text)) > 200)::INT + (country IS NOT NULL OR mode = 'remote')::INT + (coalesce(yoe_confidence, 0) >= 0.5)::INT
  + (id IN (SELECT posting_id FROM posting_skills))::INT) / 5.0::DOUBLE AS parsed FROM job_postings""")
ORACLES["vocab_fold"] = "SELECT p_partkey, '' AS employment, CASE WHEN p_size % 2 = 0 THEN 'year' ELSE 'hour' END AS period FROM part"
ORACLES["title_similarity"] = f"WITH names AS (SELECT DISTINCT p_name AS n FROM part) SELECT x.n AS a, y.n AS b, round({_similar('x.n', 'y.n')}, 6) AS sim FROM names x JOIN names y ON x.n < y.n WHERE len(list_intersect({_grams('x.n')}, {_grams('y.n')})) > 0"
ORACLES["quality_precision"] = """SELECT count(*) AS n, round(count(*) FILTER (n_chars > 500 AND quality = 1)::DOUBLE / count(*) FILTER (n_chars > 500), 6) AS precision,
round(count(*) FILTER (n_chars > 500 AND quality = 1)::DOUBLE / count(*) FILTER (quality = 1), 6) AS recall FROM documents JOIN labels USING (doc_id)"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(pairs) -> str:
    return ", ".join(f"({', '.join(_literal(x) if isinstance(x, str) else str(x) for x in pair)})" for pair in pairs)


def _ending(x: str, changes: dict[str, str], region: str, only: dict[str, str]) -> str:
    """CASE over endings, longest first; one that matches but may not change ends the search."""
    cases = []
    for e in sorted(changes, key=lambda e: (-len(e), e)):
        ok = " AND ".join([f"length({x}) - {len(e)} >= {region}", *([f"substr({x}, length({x}) - {len(e)}, 1) IN ({', '.join(repr(c) for c in stemming.BEFORE[e])})"] if e in stemming.BEFORE else []), *([only[e]] if e in only else [])])
        cases.append(f"WHEN ends_with({x}, '{e}') THEN CASE WHEN {ok} THEN left({x}, length({x}) - {len(e)}) || '{changes[e]}' ELSE {x} END")
    return f"CASE {' '.join(cases)} ELSE {x} END"


_stop = ", ".join(f"'{w}'" for w in stemming.STOP)
_drop = lambda x, n: f"left({x}, greatest(0, length({x}) - {n}))"
_region = f"'{stemming.REGION}'"
#: (word, term) from ``vocabulary`` (word), one step for each common table expression.
STEMS = f"""marked AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS m FROM vocabulary),
r1 AS (SELECT *, CASE WHEN regexp_matches(m, '^({'|'.join(stemming.BEGINNINGS)})') THEN length(regexp_extract(m, '^({'|'.join(stemming.BEGINNINGS)})')) WHEN regexp_matches(m, {_region}) THEN length(regexp_extract(m, {_region})) ELSE length(m) END AS r1 FROM marked),
r2 AS (SELECT *, CASE WHEN regexp_matches(substr(m, r1 + 1), {_region}) THEN r1 + length(regexp_extract(substr(m, r1 + 1), {_region})) ELSE length(m) END AS r2 FROM r1),
s1 AS (SELECT word, r1, r2, CASE WHEN m LIKE '%sses' THEN {_drop('m', 2)} WHEN m LIKE '%ied' OR m LIKE '%ies' THEN CASE WHEN length(m) > 4 THEN {_drop('m', 2)} ELSE {_drop('m', 1)} END
  WHEN m LIKE '%us' OR m LIKE '%ss' THEN m WHEN regexp_matches(m, '[aeiouy].+s$') THEN {_drop('m', 1)} ELSE m END AS a FROM r2),
s2 AS (SELECT *, CASE WHEN a LIKE '%eedly' OR a LIKE '%eed' THEN NULL WHEN a LIKE '%ingly' THEN {_drop('a', 5)} WHEN a LIKE '%edly' THEN {_drop('a', 4)} WHEN a LIKE '%ing' THEN {_drop('a', 3)} WHEN a LIKE '%ed' THEN {_drop('a', 2)} END AS base FROM s1),
s3 AS (SELECT *, CASE WHEN a LIKE '%eedly' THEN CASE WHEN length(a) - 5 >= r1 THEN {_drop('a', 3)} ELSE a END WHEN a LIKE '%eed' THEN CASE WHEN length(a) - 3 >= r1 THEN {_drop('a', 1)} ELSE a END
  WHEN regexp_matches(base, '[aeiouy]') THEN CASE WHEN right(base, 2) IN ('at', 'bl', 'iz') THEN base || 'e' WHEN right(base, 2) IN ({', '.join(repr(d) for d in stemming.DOUBLES)}) THEN {_drop('base', 1)}
    WHEN r1 >= length(base) AND regexp_matches(base, '{stemming.SHORT}') THEN base || 'e' ELSE base END ELSE a END AS b FROM s2),
s4 AS (SELECT *, CASE WHEN regexp_matches(b, '^.+[^aeiouy][yY]$') THEN {_drop('b', 1)} || 'i' ELSE b END AS c FROM s3),
s5 AS (SELECT *, {_ending('c', stemming.SECOND, 'r1', {})} AS d FROM s4),
s6 AS (SELECT *, {_ending('d', stemming.THIRD, 'r1', {'ative': 'length(d) - 5 >= r2'})} AS e FROM s5),
s7 AS (SELECT *, {_ending('e', dict.fromkeys(stemming.FOURTH, ''), 'r2', {})} AS f FROM s6),
s8 AS (SELECT *, CASE WHEN f LIKE '%e' AND (length(f) - 1 >= r2 OR (length(f) - 1 >= r1 AND NOT regexp_matches({_drop('f', 1)}, '{stemming.SHORT}'))) THEN {_drop('f', 1)} WHEN f LIKE '%ll' AND length(f) - 1 >= r2 THEN {_drop('f', 1)} ELSE f END AS g FROM s7),
stems AS (SELECT word, CASE {' '.join(f"WHEN word = '{w}' THEN '{s or w}'" for w, s in stemming.IRREGULAR.items())} WHEN length(word) <= 2 THEN word WHEN a IN ({', '.join(repr(w) for w in stemming.FINAL)}) THEN a ELSE replace(g, 'Y', 'y') END AS term FROM s8)"""
_cut_words = lambda x: rf"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _places(source: str) -> str:
    """``hits`` (id, term, p, w): every place of every term of ``source``, body places after the title's last one."""
    return f"""cut AS (SELECT id, {_cut_words('title')} AS tt, {_cut_words('description_text')} AS bb FROM {source}),
titles AS (SELECT id, unnest(tt) AS word, generate_subscripts(tt, 1) AS p, 1.0 AS w FROM cut), bodies AS (SELECT id, unnest(bb) AS word, generate_subscripts(bb, 1) AS p, 0.4 AS w FROM cut),
ends AS (SELECT id, max(p) AS last FROM titles WHERE word NOT IN ({_stop}) GROUP BY id),
placed AS (SELECT * FROM titles UNION ALL SELECT b.id, word, p + coalesce(last, 0), w FROM bodies b LEFT JOIN ends ON ends.id = b.id),
vocabulary AS (SELECT DISTINCT word FROM placed WHERE word NOT IN ({_stop})), {STEMS},
hits AS (SELECT id, term, p, w FROM placed JOIN stems USING (word))"""


def _count_sql(terms: list[str]) -> str:
    """``counted`` (id, rank) by the number of hits."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""counted AS (SELECT id, sum(w / (k * k)) / 1.64493406685 / {len(terms)} AS rank FROM (SELECT id, w, row_number() OVER (PARTITION BY id, term ORDER BY p) AS k FROM hits WHERE term IN ({listed})) GROUP BY id)"""


def _having(*terms: str) -> str:
    return f"id IN (SELECT id FROM hits WHERE term IN ({', '.join(repr(t) for t in terms)}) GROUP BY id HAVING count(DISTINCT term) = {len(terms)})"


_following = lambda a, b, gap: f"id IN (SELECT x.id FROM hits x JOIN hits y ON x.id = y.id AND y.p = x.p + {gap} WHERE x.term = '{a}' AND y.term = '{b}')"
_SEARCHED = f"({_having('engin', 'remot')} AND NOT {_following('year', 'experi', 2)}) OR {_having('backend')}"
_TERMS = ["backend", "engin", "experi", "remot", "year"]
_found = lambda source: f"{_places(source)}, {_count_sql(_TERMS)}"
_sql("search_relevance", ("job_postings",), f"SELECT id, round(rank, 6) AS rank FROM counted WHERE {_SEARCHED}", "live AS (SELECT * FROM job_postings WHERE status = 'live'), " + _found("live"))
_sql("feed_query", FEED, f"""SELECT id, title, fresh_at AS sort_key, round(rank, 6) AS rank FROM feed JOIN counted USING (id) WHERE status = 'live' AND ({_having('backend')} OR ({_following('data', 'engin', 1)} AND NOT {_having('hybrid')}))
ORDER BY fresh_at DESC, id DESC LIMIT 51""", f"{LIVE}, {_places('feed')}, {_count_sql(['backend', 'data', 'engin', 'hybrid'])}")
_NEARNESS = """near AS (SELECT x.id, 1 - exp(sum(ln(1 - sqrt(x.w * y.w / (1.005 + 0.05 * exp(abs(x.p - y.p) / 1.5 - 2)))))) AS rank FROM asked x JOIN asked y ON x.id = y.id AND x.term < y.term AND x.p <> y.p AND abs(x.p - y.p) <= 100 GROUP BY x.id)"""
_sql("feed_sort_relevance", FEED, f"""SELECT id, round(coalesce(rank, 1e-20::DOUBLE), 6) AS rank FROM feed LEFT JOIN near USING (id) WHERE status = 'live' AND field <> 'other' AND {_having('engin', 'remot')} ORDER BY coalesce(rank, 1e-20::DOUBLE) DESC, id DESC LIMIT 26""",
     f"{LIVE}, {_places('feed')}, asked AS (SELECT * FROM hits WHERE term IN ('engin', 'remot')), {_NEARNESS}")
_sql("search_nearness", ("job_postings",), f"""SELECT id, round(coalesce(rank, 1e-20::DOUBLE), 6) AS rank FROM job_postings LEFT JOIN near USING (id) WHERE {_having('engin', 'm', 'f', 'd', 'work', 'experienc')}
AND id IN (SELECT a.id FROM hits a JOIN hits b ON a.id = b.id AND b.p = a.p + 1 JOIN hits c ON a.id = c.id AND c.p = a.p + 2 JOIN hits d ON a.id = d.id AND d.p = a.p + 3 WHERE a.term = 'engin' AND b.term = 'm' AND c.term = 'f' AND d.term = 'd')""",
     f"{_places('job_postings')}, asked AS (SELECT * FROM hits WHERE term IN ('engin', 'm', 'f', 'd', 'work', 'experienc')), {_NEARNESS}")
_sql("search_after_changes", ("job_postings",), f"""SELECT '{EXCLUDING}' AS asked, id, round(coalesce(nullif(rank, 0), 1e-20::DOUBLE), 6) AS rank FROM now LEFT JOIN (SELECT id, 0.0::DOUBLE AS rank FROM hits WHERE false) USING (id) WHERE NOT {_having('engin')} AND NOT {_having('hybrid')}
UNION ALL SELECT '{SEARCH}', id, round(rank, 6) FROM counted WHERE {_SEARCHED}""", f"""now AS (SELECT id, title, CASE WHEN comp_min IS NULL THEN concat('Hybrid work, no engineering. ', description_text) ELSE description_text END AS description_text FROM job_postings WHERE status = 'live' AND field <> 'unknown'), {_found('now')}""")
_sql("word_stems", ("job_postings",), "SELECT word, term FROM stems", f"""vocabulary AS (SELECT DISTINCT unnest({_cut_words('x')}) AS word FROM (SELECT concat(title, ' ', description_text) AS x FROM job_postings UNION ALL SELECT text FROM documents)), {STEMS}""")

_BEST = "ORDER BY score DESC, posted_at DESC NULLS LAST, fresh_at DESC, id DESC"


def _best(where: str) -> str:
    """The most recent live rows, which a ranked page orders."""
    return f"{LIVE}, {SCORED}, best AS (SELECT * FROM scored WHERE status = 'live' AND {where} ORDER BY fresh_at DESC, id DESC LIMIT 2000)"


RANKED = (*FEED, "posting_skills")
_sql("feed_sort_match", RANKED, f"SELECT id, score, band FROM best {_BEST} LIMIT 26", _best("field = 'software' AND mode IN ('remote', 'hybrid')"))
_sql("feed_bands", RANKED, f"SELECT id, score, band FROM best WHERE band IN ('plausible', 'stretch') {_BEST} LIMIT 51", _best("true"))
_sql("feed_rehydrated", RANKED, "SELECT p.id, place::INTEGER AS place, p.company, p.title FROM page JOIN feed p USING (id) WHERE p.mode <> 'onsite'",
     _best("field <> 'other'") + f", page AS (SELECT id, row_number() OVER ({_BEST}) - 1 AS place FROM best {_BEST} LIMIT 26)")


def _pay() -> str:
    read, choose = [], {x: [] for x in ("min", "max", "currency", "period")}
    for i, (pattern, times, period, currency, numbers) in enumerate(PAY):
        p = pattern.replace("(?![A-Za-z0-9_])", r"\b")
        first = 1 if currency else 2
        number = lambda g: f"try_cast(replace(regexp_extract(w, '{p}', {g}), ',', '') AS DOUBLE) * {times}::DOUBLE"  # noqa: B023, E731
        read += [f"{number(first)} AS lo{i}", f"{number(first + 1) if numbers == 2 else 'NULL::DOUBLE'} AS hi{i}", f"regexp_extract(w, '{p}', 1) AS sign{i}"]
        fits = f"lo{i} BETWEEN 5 AND 2000" if period == "hour" else f"lo{i} BETWEEN 1e5 AND 2e8" if currency == "INR" else f"lo{i} BETWEEN 1e4 AND 5e6"
        money = f"'{currency}'" if currency else f"CASE sign{i} WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' ELSE 'GBP' END"
        for name, value in (("min", f"lo{i}"), ("max", f"hi{i}"), ("currency", money), ("period", f"'{period}'")):
            choose[name].append(f"WHEN lo{i} > 0 AND coalesce(hi{i}, lo{i}) >= lo{i} AND coalesce(hi{i}, lo{i}) / lo{i} <= 10 AND {fits} THEN {value}")
    at = lambda pattern: f"strpos(description_text, nullif(regexp_extract(description_text, '{pattern}'), ''))"
    around = lambda a, r: f"substr(description_text, greatest({a} - {r // 3}, 1), least({a} - 1, {r // 3}) + {r})"
    window = f"CASE WHEN word > 0 THEN {around('word', 300)} WHEN sign > 0 THEN {around('sign', 200)} END"
    # The bound texts are ASCII, so characters are bytes.
    return f"""SELECT id, {", ".join(f"CASE {' '.join(whens)} END AS {name}" for name, whens in choose.items())} FROM (
  SELECT id, {", ".join(read)} FROM (SELECT id, {window} AS w FROM (SELECT *, {at(PAY_WORD)} AS word, {at('[₹$€£]')} AS sign FROM job_postings)))"""


_sql("comp_parse", ("job_postings",), _pay())

_start = "lower(trim(title))"
for _from, _to in extract.SHORT.items():
    _start = f"replace({_start}, '{_from}', '{_to}')"
_sql("title_normalise", ("job_postings", "raw_titles"), r"""SELECT kind, id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x.title, '[^a-z0-9\s]+', ' ', 'g'), '\b(?:i{1,3}|iv|v|[1-5])\s*$', ''), '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS title_normalised, x.rank AS seniority
FROM (SELECT kind, id, list_reduce(list_transform(RANKS, lambda r: {'title': '', 'rank': r}),
  lambda a, r: CASE WHEN strpos(a.title, r.rank) > 0 AND NOT regexp_matches(concat(CASE WHEN strpos(a.title, r.rank) > 1 THEN substr(a.title, strpos(a.title, r.rank) - 1, 1) ELSE '' END, substr(a.title, strpos(a.title, r.rank) + length(r.rank), 1)), '[a-z0-9]')
    THEN {'title': replace(a.title, r.rank, ' '), 'rank': r.rank} ELSE a END, {'title': START, 'rank': ''}) AS x
  FROM (SELECT 'posting' AS kind, id, title FROM job_postings UNION ALL SELECT 'document', id, title FROM raw_titles))""".replace("RANKS", f"[{', '.join(_literal(r) for r in extract.RANKS)}]").replace("START", _start))

_sql("location_parse", ("raw_places",), "SELECT w.id, coalesce(f.country, '') AS country, coalesce(f.region, '') AS region, coalesce(f.city, '') AS city FROM raw_places w LEFT JOIN first_part f USING (id)", rf"""
codes(name, code) AS (VALUES {_values({**places.STATES, **places.COUNTRIES}.items())}), nations(code) AS (VALUES {_values((c,) for c in sorted(set(places.COUNTRIES.values())))}), cities(name, city) AS (VALUES {_values(places.CITIES.items())}),
of_city(city, code) AS (VALUES {_values(places.CITY_COUNTRY.items())}), city_region(city, region) AS (VALUES {_values(places.CITY_REGION.items())}), namesakes(city, code) AS (VALUES {_values(places.NAMESAKES.items())}),
regions(region, code) AS (VALUES {_values(places.REGIONS.items())}),
cut AS (SELECT id, generate_subscripts(x, 1) AS part, unnest(x) AS raw FROM (SELECT id, string_split_regex(trim(location_raw), '{extract.PLACE_PARTS}') AS x FROM raw_places)),
clean AS (SELECT id, part, trim(trim(regexp_replace(regexp_replace(raw, '(?i)\b(?:remote|hybrid|on-?site|in-?office|flexible|anywhere|multiple locations|various)\b', ' ', 'g'), '[()\[\]]', ' ', 'g')), '{extract.EDGES}') AS x FROM cut),
parts AS (SELECT *, regexp_extract(x, '{extract.CODED}', 1) AS c1, regexp_extract(x, '{extract.CODED}', 2) AS c2, lower(trim(regexp_extract(x, '{extract.CODED}', 3))) AS c3 FROM clean WHERE x <> ''),
segments AS (SELECT id, part, generate_subscripts(y, 1) - 1 AS s, lower(trim(unnest(y))) AS name FROM (SELECT *, string_split(x, ',') AS y FROM parts WHERE c1 NOT IN (SELECT code FROM nations))),
known AS (SELECT g.*, code, city, max(s) FILTER (code IS NOT NULL) OVER (PARTITION BY id, part) AS cs FROM segments g LEFT JOIN codes USING (name) LEFT JOIN cities USING (name)),
with_city AS (SELECT *, max(s) FILTER (city IS NOT NULL AND s IS DISTINCT FROM cs) OVER (PARTITION BY id, part) AS ts FROM known),
with_region AS (SELECT *, max(s) FILTER (s > 0 AND octet_length(encode(name)) = 2 AND s IS DISTINCT FROM cs AND s IS DISTINCT FROM ts) OVER (PARTITION BY id, part) AS rs FROM with_city),
read AS (SELECT id, part, coalesce(max(code) FILTER (s = cs), '') AS country, coalesce(max(upper(name)) FILTER (s = rs), '') AS region, coalesce(max(city) FILTER (s = ts), '') AS city FROM with_region GROUP BY id, part),
near AS (
  SELECT r.id, r.part, r.city, coalesce(nullif(r.country, ''), o.code, CASE WHEN r.region = '' THEN n.code END, '') AS country, r.region, c.region AS own
  FROM read r LEFT JOIN of_city o ON o.city = r.city LEFT JOIN namesakes n ON n.city = r.city LEFT JOIN city_region c ON c.city = r.city),
placed AS (SELECT id, part, country, city, CASE WHEN own IS NOT NULL AND (region = '' OR country = 'IN') THEN own ELSE region END AS region FROM near),
both_kinds AS (
  SELECT p.id, p.part, coalesce(nullif(p.country, ''), g.code, '') AS country, p.region, p.city FROM placed p LEFT JOIN regions g ON g.region = p.region
  UNION ALL SELECT id, part, c1, c2, coalesce(city, '') FROM parts LEFT JOIN cities ON name = c3 WHERE c1 IN (SELECT code FROM nations)),
first_part AS (SELECT DISTINCT ON (id) * FROM both_kinds WHERE country <> '' OR city <> '' ORDER BY id, part)""")

_context = " ".join(
    f"WHEN '{k}' THEN (terse OR regexp_matches(low, '(?i){p}'))" + (f" AND NOT regexp_matches(low, '(?i){extract.NOT_IN_CONTEXT[k]}')" if k in extract.NOT_IN_CONTEXT else "") for k, p in extract.IN_CONTEXT.items()
)
_kinds = " ".join(f"WHEN regexp_matches(line, {_literal('(?i)^' + p)}) THEN {extract.STRENGTH[k]}" for k, p in extract.HEADINGS)
def _skill_ctes(bodies: str) -> str:
    """``named`` (kind, id, skill, section, low, terse): names in the lines of ``bodies`` (kind, id, description_text)."""
    return rf"""names(name, pattern, skill) AS (VALUES {_values((n, extract.name_pattern(n), k) for n, k in extract.NAMES.items())}),
bodies AS ({bodies}),
lined AS (SELECT kind, id, generate_subscripts(x, 1) AS pos, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS line FROM (SELECT kind, id, string_split(description_text, chr(10)) AS x FROM bodies)),
headed AS (SELECT *, CASE {_kinds} END AS heading FROM lined),
sectioned AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY kind, id ORDER BY pos), 1) AS section, lower(line) AS low FROM headed),
named AS (SELECT s.*, skill, section > 1 AND len(string_split_regex(low, '\s+')) <= {extract.TERSE} AS terse FROM sectioned s JOIN names n ON contains(low, n.name) AND regexp_matches(low, n.pattern) WHERE heading IS NULL AND low <> '')"""


_sql("skill_sections", ("job_postings", "raw_bodies"), f"""SELECT kind, id, skill, CASE max(section) WHEN 3 THEN 'must_have' WHEN 2 THEN 'nice_to_have' ELSE 'mentioned' END AS requirement, CASE max(section) WHEN 1 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence
FROM named WHERE CASE skill {_context} ELSE true END GROUP BY kind, id, skill""", _skill_ctes("SELECT 'posting' AS kind, id, description_text FROM job_postings UNION ALL SELECT 'document', id, description_text FROM raw_bodies"))

_clean_heading = f"regexp_replace(line, '[{resume.HEADING_TAIL}]+$', '')"
_section_of = "CASE WHEN len(string_split_regex(line, '\\s+')) > 6 THEN NULL " + " ".join(f"WHEN regexp_matches({_clean_heading}, {_literal(f'(?i)^(?:{p})$')}) THEN '{k}'" for k, p in resume.HEADINGS) + " END"
_months = "[" + ", ".join(f"'{m}'" for m in resume.MONTHS) + "]"
_fraction = lambda g: f"CASE WHEN regexp_extract(m, {_literal(resume.RANGE)}, {g}) <> '' THEN (list_position({_months}, lower(left(regexp_extract(m, {_literal(resume.RANGE)}, {g}), 3))) - 1) / 12.0::DOUBLE ELSE 0.0::DOUBLE END"
_of = lambda g: f"regexp_extract(m, {_literal(resume.RANGE)}, {g})"
_sql("resume_parse", ("raw_resumes",), """SELECT r.id, email, phone, links, coalesce(skills, '') AS skills, years AS years_of_experience,
  CASE WHEN n_lines = 0 THEN 0.0 ELSE floor((CASE WHEN email IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN skills IS NOT NULL THEN 0.30 ELSE 0 END + CASE WHEN work IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN years IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN school THEN 0.05 ELSE 0 END + CASE WHEN n_lines >= 15 THEN 0.10 ELSE 0 END) * 100 + 0.5) / 100.0 END::DOUBLE AS confidence,
  array_to_string(list_filter([CASE WHEN work IS NULL THEN 'no_experience_section' END, CASE WHEN skills IS NULL THEN 'no_skills' END, CASE WHEN email IS NULL THEN 'no_contact' END, CASE WHEN work IS NOT NULL AND years IS NULL THEN 'no_dates' END], lambda x: x IS NOT NULL), ',') AS diagnostics, n_lines
FROM (SELECT p.*, s.skills, CASE WHEN work IS NULL THEN stated ELSE worked END AS years FROM people p LEFT JOIN skilled s USING (id) LEFT JOIN dated USING (id)) r""", rf"""
cutl AS (SELECT id, generate_subscripts(x, 1) AS n, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS line FROM (SELECT id, string_split(text, chr(10)) AS x FROM raw_resumes)),
marked AS (SELECT *, {_section_of} AS h FROM cutl WHERE line <> ''),
seen AS (SELECT *, count(h) OVER (PARTITION BY id ORDER BY n) AS before FROM marked),
placed AS (SELECT id, n, line, h, coalesce(last_value(coalesce(h, CASE WHEN before = 0 AND len(string_split_regex(line, '\s+')) > 12 THEN 'summary' END) IGNORE NULLS) OVER (PARTITION BY id ORDER BY n), 'contact') AS part FROM seen),
parts AS (SELECT id, part, string_agg(line || chr(10), '' ORDER BY n) AS body FROM placed WHERE h IS NULL GROUP BY id, part),
heads AS (SELECT id, string_agg(line || chr(10), '' ORDER BY n) AS head FROM placed WHERE h IS NULL AND part IN ('contact', 'summary') GROUP BY id),
people AS (
  SELECT r.id, coalesce(nullif(regexp_extract(coalesce(head, ''), {_literal(resume.EMAIL)}), ''), nullif(regexp_extract(text, {_literal(resume.EMAIL)}), '')) AS email, nullif(trim(regexp_extract(coalesce(head, ''), {_literal(resume.PHONE)})), '') AS phone,
    (SELECT coalesce(string_agg(l, ' ' ORDER BY l), '') FROM (SELECT l FROM (SELECT unnest(list_slice(regexp_extract_all(text, {_literal(resume.LINK)}), 1, 8)) AS l, generate_subscripts(list_slice(regexp_extract_all(text, {_literal(resume.LINK)}), 1, 8), 1) AS i) QUALIFY row_number() OVER (PARTITION BY lower(rtrim(l, '/')) ORDER BY i) = 1)) AS links,
    (SELECT body FROM parts p WHERE p.id = r.id AND part = 'experience') AS work, EXISTS (SELECT 1 FROM parts p WHERE p.id = r.id AND part = 'education') AS school, (SELECT count(*) FROM placed p WHERE p.id = r.id) AS n_lines,
    (SELECT CASE WHEN y > 0 AND y < 60 THEN y END FROM (SELECT try_cast(regexp_extract(body, {_literal(resume.STATED)}, 1) AS DOUBLE) AS y FROM parts p WHERE p.id = r.id AND part = 'summary')) AS stated
  FROM raw_resumes r LEFT JOIN heads USING (id)),
ranges AS (SELECT id, unnest(regexp_extract_all(body, {_literal(resume.RANGE)})) AS m FROM parts WHERE part = 'experience'),
spans AS (SELECT id, {_of(2)}::INT::DOUBLE + {_fraction(1)} AS a, CASE WHEN regexp_matches({_of(4)}, '^[0-9]+$') THEN try_cast({_of(4)} AS INT)::DOUBLE + {_fraction(3)} ELSE year({_NOW}) + (month({_NOW}) - 1) / 12.0::DOUBLE END AS b FROM ranges),
reach AS (SELECT id, b, greatest(a, coalesce(max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS a FROM spans WHERE b >= a AND a >= 1950 AND b <= year({_NOW}) + 1),
dated AS (SELECT id, floor(sum(greatest(b - a, 0)) * 10 + 0.5) / 10 AS worked FROM reach GROUP BY id HAVING sum(greatest(b - a, 0)) > 0),
{_skill_ctes("SELECT part AS kind, id, body AS description_text FROM parts")},
worth(part, r, label) AS (VALUES {_values((s, i, e) for i, (s, e) in enumerate(resume.EVIDENCE))}),
strongest AS (SELECT id, skill, max(r) AS r FROM named JOIN worth ON part = kind WHERE CASE skill {_context} ELSE true END GROUP BY id, skill),
yearly AS (SELECT s.id, s.skill, w.label, (SELECT first(y ORDER BY i) FROM (SELECT i, try_cast(regexp_extract(substr(low, strpos(low, s.skill)), {_literal(resume.SKILL_YEARS)}, 1) AS INT) AS y FROM (SELECT unnest(string_split(lower(p.body), chr(10))) AS low, generate_subscripts(string_split(p.body, chr(10)), 1) AS i) WHERE contains(low, s.skill)) WHERE y > 0 AND y < 60) AS y
  FROM strongest s JOIN worth w USING (r) JOIN parts p ON p.id = s.id AND p.part = w.part),
skilled AS (SELECT id, string_agg(concat(skill, ':', label, coalesce(':' || y::STRING, '')), ',' ORDER BY skill) AS skills FROM yearly GROUP BY id)""")


_sql("profile_map", ("user_skills",), """SELECT user_id, string_agg(concat(skill, '=', coalesce(years, 0)::INT), ',' ORDER BY skill) AS years, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (origin = 'manual'), '') AS manual,
coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (origin = 'resume'), '') AS resume FROM user_skills GROUP BY user_id""")
_FIRST = "first AS (SELECT user_id, posting_id, arg_min(status, id) AS status, min(created_at) AS created_at, min(last_activity_at) AS last_activity_at FROM applications GROUP BY user_id, posting_id)"
_EVENTS_NOW = f"TIMESTAMP '{EVENTS_AS_OF}'"
_sql("application_save", ("applications", "dismissed_postings"), f"""SELECT user_id, posting_id, coalesce(status, 'saved') AS status, coalesce(created_at, {_EVENTS_NOW}) AS created_at, CASE WHEN asked THEN {_EVENTS_NOW} ELSE last_activity_at END AS last_activity_at
FROM first FULL JOIN (SELECT user_id, posting_id, true AS asked FROM dismissed_postings UNION SELECT user_id, posting_id, true FROM first WHERE status = 'applied') USING (user_id, posting_id)""", _FIRST)
_sql("application_unsave", ("applications",), """SELECT id, user_id, posting_id, status FROM applications a
WHERE status <> 'saved' OR NOT EXISTS (SELECT 1 FROM applications b WHERE b.next_action_at IS NULL AND b.user_id = a.user_id AND b.posting_id = a.posting_id)""")
_sql("application_patch", ("applications",), f"""SELECT id, CASE WHEN hit AND status = 'saved' THEN 'applied' ELSE status END AS status, CASE WHEN hit THEN CASE WHEN status = 'screening' THEN 'referral' ELSE 'other' END END AS channel,
CASE WHEN hit THEN {_EVENTS_NOW} END AS applied_at, CASE WHEN hit THEN {_EVENTS_NOW} ELSE last_activity_at END AS last_activity_at, next_action_at FROM (SELECT *, next_action_at IS NOT NULL AS hit FROM applications)""")
_sql("application_patch_events", ("applications",), f"""SELECT id AS application_id, 'saved' AS from_status, 'applied' AS to_status, {_EVENTS_NOW} AS occurred_at FROM applications WHERE next_action_at IS NOT NULL AND status = 'saved'""")
_sql("digest_replay", (*FEED, "saved_searches", "posting_skills", "dismissed_postings"), f"""SELECT user_id, search_id, place::INTEGER AS place, id, most > 8 AS more FROM (
  SELECT *, max(place) OVER (PARTITION BY search_id) AS most FROM (
    SELECT s.user_id, s.id AS search_id, p.id, row_number() OVER (PARTITION BY s.id ORDER BY fresh_at DESC, p.id DESC) AS place
    FROM saved_searches s JOIN feed p ON p.status = 'live' AND fresh_at > s.last_seen_max_posted_at
    WHERE (s.user_id % 3 <> 0 OR p.country IS NULL OR p.country IN ('N1', 'N2')) AND (s.user_id % 4 <> 0 OR p.mode = 'remote') AND (s.user_id % 5 <> 0 OR p.comp_min IS NULL OR {_USD} >= 150000) AND (s.user_id % 10 <> 0 OR p.comp_min IS NOT NULL)
      AND (s.user_id % 2 = 0 OR p.field <> 'other') AND (s.user_id % 7 <> 0 OR yoe_confidence < 0.5 OR yoe_min IS NULL OR yoe_min BETWEEN 3 AND 5 OR yoe_min >= 9) AND (s.user_id % 11 <> 0 OR vendor IN ('ashby', 'workable'))
      AND (s.user_id % 13 <> 1 OR p.id IN (SELECT posting_id FROM posting_skills WHERE skill = 'hot plate')) AND (s.user_id % 6 <> 1 OR (p.{_having('engin')} AND NOT p.{_having('remot')}))
      AND (s.user_id % 9 = 0 OR NOT EXISTS (SELECT 1 FROM dismissed_postings d WHERE d.user_id = s.user_id AND d.posting_id = p.id)))) WHERE place <= 8""", f"{LIVE}, {_places('feed')}")
_SEARCHES = """kept AS (SELECT id, user_id, name, '' AS query, id = min(id) OVER (PARTITION BY user_id) AS is_default, created_at, last_digest_at AS last_run_at, last_seen_max_posted_at FROM saved_searches),
mark AS (SELECT max(coalesce(posted_at, first_seen_at)) AS newest FROM job_postings WHERE status = 'live')"""
_ASKED = f"""{_SEARCHES}, wanted AS (SELECT user_id, event_id AS id, value > 70 AS make_default, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + (SELECT count(*) FROM kept k WHERE k.user_id = e.user_id) AS place FROM events e WHERE event_type = 'signup'),
def AS (SELECT user_id, max(id) AS id FROM wanted WHERE place <= 20 AND make_default GROUP BY user_id)"""
_sql("saved_search_create", ("saved_searches", "job_postings"), f"""SELECT id, user_id, name, query, is_default AND user_id NOT IN (SELECT user_id FROM def) AS is_default, created_at, last_run_at, last_seen_max_posted_at FROM kept
UNION ALL SELECT id, user_id, concat('new ', id), 'q=go', id IN (SELECT id FROM def), {_EVENTS_NOW}, {_EVENTS_NOW}, (SELECT newest FROM mark) FROM wanted WHERE place <= 20""", _ASKED)
_sql("saved_search_refused", ("saved_searches", "job_postings"), "SELECT user_id, id AS request_id FROM wanted WHERE place > 20", _ASKED)
_sql("saved_search_run", ("saved_searches", "job_postings"), f"""SELECT id, user_id, CASE WHEN ran THEN {_EVENTS_NOW} ELSE last_run_at END AS last_run_at, CASE WHEN ran THEN (SELECT newest FROM mark) ELSE last_seen_max_posted_at END AS last_seen_max_posted_at
FROM (SELECT *, is_default AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 60) AS ran FROM kept k WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = k.user_id AND e.event_id + floor(e.value)::BIGINT % 9 = k.id))""", _SEARCHES)
_sql("visit_throttle", ("users",), """SELECT id, active AS last_active_at, previous AS previous_visit_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS last FROM walk) WHERE last = 1""",
     """asked AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
walk AS (SELECT id, 0::BIGINT AS n, CASE WHEN deletion_requested_at IS NULL THEN created_at END AS active, NULL::TIMESTAMP AS previous FROM users
  UNION ALL SELECT w.id, a.n, CASE WHEN active IS NULL OR active < ts - INTERVAL '6' HOUR THEN ts ELSE active END, CASE WHEN active IS NULL THEN ts WHEN active < ts - INTERVAL '6' HOUR AND active < ts - INTERVAL '1' DAY THEN active ELSE previous END
  FROM walk w JOIN asked a ON a.user_id = w.id AND a.n = w.n + 1)""")
ORACLES["visit_throttle"] = ORACLES["visit_throttle"].replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["session_prune"] = "SELECT event_id FROM events WHERE NOT coalesce(value > 5 AND ts + INTERVAL '12' HOUR < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL '30' DAY, false)"

ORACLES |= SOURCE_SQL | polling.SQL
_sql("posting_detail", (*RANKED, "applications"), """SELECT s.id, s.title, s.company, s.vendor, p.country, array_to_string(mu, ',') AS must, array_to_string(ni, ',') AS nice, s.id IN (SELECT posting_id FROM applications WHERE user_id = VIEWER) AS saved, score, band,
  CASE WHEN NOT readable THEN 'Unscored: too little could be read' WHEN NOT stated THEN 'No skills named; scored on the other parts'
    WHEN len(gaps) > 0 THEN concat(detail, '; lacks ', array_to_string(gaps[1:3], ', '), CASE WHEN len(gaps) > 3 THEN concat(' +', len(gaps) - 3, ' more') ELSE '' END)
    ELSE concat(detail, '; nothing is missing') END AS headline
FROM scored s JOIN job_postings p ON p.id = s.id WHERE s.status = 'live'""".replace("VIEWER", str(VIEWER)), f"{LIVE.replace('SELECT p.*', 'SELECT p.* REPLACE (NULL::VARCHAR AS country)')}, {SCORED}")

_sql("backfill_urls", ("job_postings", "sources", "companies"), """SELECT p.id, CASE WHEN ours THEN coalesce(a, url) ELSE a END AS apply_url, CASE WHEN ours THEN coalesce(nullif(b, ''), url) ELSE b END AS posting_url FROM (
  SELECT p.id, CASE WHEN comp_min > 300000 THEN 'https://a.example' END AS a, CASE WHEN comp_max IS NULL THEN '' ELSE 'https://b.example' END AS b, vendor = 'personio' AS ours, concat('https://jobs.smartrecruiters.com/', slug, '/', external_id) AS url
  FROM job_postings p JOIN sources s ON s.id = p.source_id JOIN companies c ON c.id = s.company_id) p""")
_sql("backfill_close_absent", ("job_postings",), f"""SELECT id, CASE WHEN gone THEN 'closed' ELSE status END AS status, CASE WHEN gone THEN {_NOW} ELSE closed_at END AS closed_at
FROM (SELECT *, status = 'live' AND missing_count + (field = 'unknown')::INT >= 2 AS gone FROM job_postings)""")
ORACLES["backfill_fields"] = f"SELECT id, guess AS field, confidence AS field_confidence, because AS field_because FROM ({ORACLES['field_classify']})"
_PLACES = lambda source: ORACLES["location_parse"].replace("raw_places AS (", "raw_places0 AS (", 1).replace("\ncodes(name", f"\nraw_places AS ({source}),\ncodes(name", 1)
_FILLED = "SELECT p.id, {} FROM job_postings p LEFT JOIN parsed x ON x.id = p.company_id".format(", ".join(f"CASE WHEN p.country IS NULL AND x.country <> '' THEN nullif(x.{c}, '') ELSE {'p.' + c if c != 'region' else 'NULL'} END AS {c}" for c in ("country", "region", "city")))
_sql("backfill_locations", ("job_postings",), _FILLED, f"parsed AS ({_PLACES('SELECT * FROM raw_places0')})")
_sql("backfill_locations_again", ("job_postings",), _FILLED, f"parsed AS ({_PLACES(chr(10) + 'SELECT id, CASE WHEN location_raw LIKE ' + _literal('Customer#%') + ' THEN regexp_replace(location_raw, ' + _literal('^Customer#0*') + ', ' + _literal('Berlin, ') + ') ELSE location_raw END AS location_raw FROM raw_places0')})")

_hash_id = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
_sql("registry_after", ("companies", "sources", "job_postings"), """SELECT 'company' AS kind, id, slug AS a, name AS b, NULL::BIGINT AS of FROM new_companies WHERE id IN (SELECT company_id FROM new_sources)
UNION ALL SELECT 'source', id, board_token, concat(vendor, '/', tier), company_id FROM new_sources UNION ALL SELECT 'posting', id, NULL, NULL, source_id FROM job_postings WHERE source_id IN (SELECT id FROM new_sources)""", f"""
stored AS (SELECT s.id, s.vendor, concat(slug, '-', vendor) AS board_token, s.company_id, tier, slug, name FROM sources s JOIN companies c ON c.id = s.company_id),
listed AS (SELECT slug, upper(name) AS name, vendor, board_token FROM stored WHERE tier IN ('a', 'b') UNION ALL SELECT 'supplier#moved', 'Moved', vendor, board_token FROM stored WHERE tier = 'c' AND vendor = 'ashby'
  UNION ALL SELECT lower(s_name), s_name, 'keka', concat('new-', lower(s_name)) FROM supplier),
new_companies AS (SELECT coalesce(c.id, {_hash_id('l.slug')}) AS id, coalesce(l.slug, c.slug) AS slug, coalesce(l.name, c.name) AS name FROM companies c FULL JOIN (SELECT slug, min(name) AS name FROM listed GROUP BY slug) l ON l.slug = c.slug),
new_sources AS (SELECT coalesce(s.id, {_hash_id("l.vendor || '/' || l.board_token")}) AS id, l.vendor, l.board_token, c.id AS company_id, coalesce(s.tier, 'a') AS tier FROM listed l JOIN new_companies c ON c.slug = l.slug LEFT JOIN stored s ON s.vendor = l.vendor AND s.board_token = l.board_token)""")
_sql("replayed_feed", ("sources",), """SELECT s.id AS source_id, s.vendor, payload, CASE WHEN s.tier = 'b' AND payload LIKE 'board%' THEN 304 ELSE 200 END AS status, CASE WHEN s.tier = 'b' AND payload LIKE 'board%' THEN NULL ELSE md5(html) END AS body_md5
FROM (SELECT *, CASE WHEN vendor = 'greenhouse' AND tier = 'c' THEN 'detail-pay-ranges.json' WHEN vendor = 'workday' AND tier <> 'a' THEN 'detail.json' WHEN vendor = 'personio' THEN 'board-full.xml' ELSE 'board-full.json' END AS payload FROM sources) s
JOIN (VALUES (0, 'greenhouse', 'board-full.json'), (1, 'greenhouse', 'detail-pay-ranges.json'), (2, 'ashby', 'board-full.json'), (6, 'workable', 'board-full.json'), (7, 'workday', 'board-full.json'), (8, 'workday', 'detail.json'), (9, 'personio', 'board-full.xml')) k(page, v, name) ON v = s.vendor AND name = payload
JOIN pages ON page_id = page""")

_shown = "list_aggregate(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')".format("skill")
_of_kind = lambda kind, x: f"coalesce(string_agg({x}, ',' ORDER BY {x}) FILTER (requirement = '{kind}'), '')"
_sql("feed_items", (*FEED, "posting_skills", "applications", "raw_places"), f"""SELECT f.id, f.title, f.company, f.slug, coalesce(location_raw, '') AS location_raw, f.city, f.country, f.mode, NULL::VARCHAR AS apply_url, f.vendor, comp_min, comp_max, comp_currency, NULL::VARCHAR AS comp_period, NULL::VARCHAR AS comp_src,
  yoe_min, yoe_max, coalesce(yoe_confidence, 0) AS yoe_confidence, posted_at, posted_at_is_estimate, first_seen_at, NULL::BOOLEAN AS ai_screening_disclosed, NULL::VARCHAR AS ai_opt_out_url, parse_confidence, fresh_at AS sort_key,
  coalesce(must_have, '') AS must_have_, coalesce(nice_to_have, '') AS nice_to_have_, coalesce(must_canon, '') AS must_canon_, coalesce(CASE WHEN must_canon = '' AND nice = '' THEN mentioned ELSE nice END, '') AS nice_canon_,
  f.id IN (SELECT posting_id FROM applications WHERE user_id = {VIEWER}) AS saved
FROM feed f LEFT JOIN raw_places r ON r.id = f.company_id LEFT JOIN chips ON posting_id = f.id WHERE status = 'live' AND field <> 'other'""", f"""{LIVE},
chips AS (SELECT posting_id, {_of_kind('must_have', 'shown')} AS must_have, {_of_kind('nice_to_have', 'shown')} AS nice_to_have, {_of_kind('must_have', 'skill')} AS must_canon, {_of_kind('nice_to_have', 'skill')} AS nice, {_of_kind('mentioned', 'skill')} AS mentioned
  FROM (SELECT *, {_shown} AS shown FROM posting_skills) GROUP BY posting_id)""")
_sql("value_lists", ("job_postings", "sources"), "SELECT kind, string_agg(DISTINCT value, ',' ORDER BY value) AS listed FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS kind, {c} AS value FROM {t}" for t, cs in (("job_postings", ("mode", "status", "field", "comp_currency")), ("sources", ("vendor", "tier"))) for c in cs) + ") WHERE value IS NOT NULL GROUP BY kind")
