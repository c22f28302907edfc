"""Canonical job-market tables derived from the star-schema test tables.

Each table is one SQL text that Spark and other SQL engines read alike: plain arithmetic,
CASE and joins. ``bound`` gives the Spark DataFrames, ``with_tables`` the same texts as
common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "orders", "lineitem", "part", "events", "supplier", "pages", "documents", "labels")
#: Tables that do not grow.
FIXED = ("region", "nation")

#: The instants that stand for "now" over the bound data.
AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

TABLES: dict[str, str] = {
    "companies": """
SELECT c_custkey AS id, lower(c_name) AS slug, c_name AS name, c_nationkey AS nation_id FROM customer""",
    "sources": """
SELECT o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id, o_custkey AS company_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'greenhouse' WHEN '2' THEN 'ashby' WHEN '3' THEN 'workday' WHEN '4' THEN 'personio' ELSE 'workable' END AS vendor,
  CASE o_custkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'paused' ELSE 'c' END AS tier,
  max(o_orderdate) AS last_changed_at, min(o_orderdate) AS first_polled_at, CAST(o_custkey % 7 AS INT) AS consecutive_errors
FROM orders GROUP BY o_custkey, o_orderpriority""",
    "job_postings": """
SELECT o_orderkey AS id, o_custkey AS company_id, o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS source_id,
  CAST(o_orderkey AS STRING) AS external_id,
  concat(CASE o_orderkey % 7 WHEN 0 THEN 'Senior Backend Engineer' WHEN 1 THEN 'Backend Engineer' WHEN 2 THEN 'Account Executive' WHEN 3 THEN 'Data Engineer II'
    WHEN 4 THEN 'Mechanical Engineer' WHEN 5 THEN 'Staff Engineer' ELSE 'Office Lead' END, CASE WHEN o_orderkey % 3 = 0 THEN ' (m/f/d)' ELSE '' END) AS title,
  concat(CASE o_orderkey % 5 WHEN 0 THEN 'We ask for 3-5 years of work.' WHEN 1 THEN 'At least 4 years experience needed.' WHEN 2 THEN 'You bring 6+ years.' WHEN 3 THEN 'Some 2 years of professional experience.' ELSE 'Experience is welcome.' END,
    CASE o_orderkey % 6 WHEN 0 THEN ' This role is fully remote.' WHEN 1 THEN ' Hybrid, 3 days in the office.' WHEN 2 THEN ' On-site only.' WHEN 3 THEN ' There is no remote work.' WHEN 4 THEN ' Work from home.' ELSE '' END,
    CASE o_orderkey % 8 WHEN 0 THEN ' Base salary: $120,000 - $150,000.' WHEN 1 THEN ' Pay is $90k - $130k a year.' WHEN 2 THEN ' CTC 28-42 LPA.' WHEN 3 THEN ' Pay $45 - $60 per hour.' WHEN 4 THEN ' Salary 1.2 - 1.8 Cr.' ELSE '' END) AS description_text,
  CASE WHEN c_nationkey % 10 = 0 THEN NULL ELSE substr(concat('N', CAST(c_nationkey AS STRING)), 1, 2) END AS country,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('City', CAST(c_nationkey % 4 AS STRING)) END AS city,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'remote' WHEN 'BUILDING' THEN 'hybrid' WHEN 'FURNITURE' THEN 'onsite' WHEN 'HOUSEHOLD' THEN 'unknown' ELSE 'remote' END AS mode,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS comp_min,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice * 1.25 END AS comp_max,
  CASE c_nationkey % 9 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CAD' WHEN 3 THEN 'SGD' WHEN 4 THEN 'AUD' WHEN 5 THEN 'JPY' WHEN 6 THEN 'SEK' WHEN 7 THEN 'INR' ELSE 'USD' END AS comp_currency,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 13 AS INT) END AS yoe_min,
  CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 13 + 4 AS INT) END AS yoe_max,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10.0E0 END AS yoe_confidence,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + CAST(o_orderkey % 1441 AS INT) * INTERVAL '1' MINUTE END AS posted_at,
  o_orderkey % 19 = 0 AS posted_at_is_estimate,
  o_orderdate + CAST(o_orderkey % 72 AS INT) * INTERVAL '1' HOUR AS first_seen_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + CAST(o_orderkey % 45 AS INT) * INTERVAL '1' DAY END AS closed_at,
  CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN 'closed' ELSE 'superseded' END AS status,
  CAST(o_orderkey % 2 AS INT) AS missing_count,
  CASE o_orderkey % 3 WHEN 0 THEN 'software' WHEN 1 THEN 'other' ELSE 'unknown' END AS field,
  CAST(o_orderkey % 6 AS DOUBLE) / 5.0E0 AS parse_confidence
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "posting_skills": """
SELECT l_orderkey AS posting_id, p_name AS skill,
  CASE max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) WHEN 3 THEN 'must_have' WHEN 2 THEN 'nice_to_have' ELSE 'mentioned' END AS requirement
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_name""",
    "users": """
SELECT user_id AS id, concat('user', CAST(user_id AS STRING), '@example.org') AS email, min(ts) AS created_at, max(ts) AS last_active_at,
  CASE WHEN user_id % 13 = 0 THEN max(ts) END AS deletion_requested_at, CASE WHEN user_id % 29 = 0 THEN max(ts) END AS deleted_at
FROM events GROUP BY user_id""",
    "applications": """
SELECT event_id AS id, user_id, event_id % (SELECT max(o_orderkey) FROM orders) + 1 AS posting_id, ts AS created_at, ts AS last_activity_at,
  CASE event_type WHEN 'view' THEN 'saved' WHEN 'click' THEN 'applied' WHEN 'signup' THEN 'screening' WHEN 'purchase' THEN 'interviewing' ELSE 'rejected' END AS status,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS next_action_at
FROM events WHERE value > 20""",
    "application_events": """
SELECT event_id AS id, user_id AS application_id, lower(event_type) AS to_status, ts AS occurred_at FROM events""",
    "dismissed_postings": """
SELECT user_id, event_id % (SELECT max(o_orderkey) FROM orders) + 1 AS posting_id, max(ts) AS dismissed_at FROM events WHERE event_type = 'error' GROUP BY user_id, event_id % (SELECT max(o_orderkey) FROM orders) + 1""",
    "user_consents": """
SELECT event_id AS id, user_id, CASE event_id % 3 WHEN 0 THEN 'digest_email' WHEN 1 THEN 'resume_storage' ELSE 'analytics' END AS purpose, ts AS granted_at,
  CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL '1' DAY END AS withdrawn_at
FROM events WHERE event_type = 'signup'""",
    "saved_searches": """
SELECT event_id AS id, user_id, concat('search ', CAST(event_id AS STRING)) AS name, ts AS created_at,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE TIMESTAMP '2001-07-01 00:00:00' + CAST(event_id % 31 AS INT) * INTERVAL '1' DAY END AS last_seen_max_posted_at,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL '12' HOUR END AS last_digest_at
FROM events WHERE event_type = 'purchase'""",
    "raw_titles": """
SELECT p_partkey AS id, concat(CASE p_partkey % 9 WHEN 0 THEN 'Sr. ' WHEN 1 THEN 'Senior Staff SDE, ' WHEN 2 THEN 'Head of ' WHEN 3 THEN 'Entry-Level ' WHEN 4 THEN 'Leadership ' WHEN 5 THEN 'Jr '
  WHEN 6 THEN 'Associate Director: ' WHEN 7 THEN 'Lead Eng. / ' ELSE '' END, p_name, CASE p_partkey % 5 WHEN 0 THEN ' II' WHEN 1 THEN ' (m/f/d)' WHEN 2 THEN ' 3 ' WHEN 3 THEN ' intern' ELSE '' END) AS title
FROM part""",
    "raw_places": """
SELECT c_custkey AS id, CASE c_custkey % 14 WHEN 0 THEN 'Bangalore / Remote' WHEN 1 THEN 'Austin, TX' WHEN 2 THEN concat('Remote - ', n_name) WHEN 3 THEN concat('Paris, ', n_name) WHEN 4 THEN 'US-CA-Menlo Park'
  WHEN 5 THEN concat('Berlin, ', n_name) WHEN 6 THEN 'Springfield, IN' WHEN 7 THEN concat('Hybrid: ', n_name, ' or Berlin') WHEN 8 THEN concat(n_name, ' (Remote)') WHEN 9 THEN 'Vancouver, BC' WHEN 10 THEN c_name
  WHEN 11 THEN concat('München; ', n_name) WHEN 12 THEN concat('*HQ - San Francisco, CA, ', n_name) ELSE NULL END AS location_raw
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "raw_bodies": """
SELECT doc_id AS id, concat('We spark joy with Kafka.', chr(10), coalesce(text, ''), chr(10), CASE doc_id % 4 WHEN 0 THEN 'Requirements' WHEN 1 THEN 'What you have: must-haves' WHEN 2 THEN '  NICE TO HAVE:' ELSE 'About us' END, chr(10),
  CASE doc_id % 7 WHEN 0 THEN 'Strong Go' WHEN 1 THEN '5+ years of Python or C++' WHEN 2 THEN 'Experience with swift payments and spring boot in a large java shop' WHEN 3 THEN 'Rust belt' WHEN 4 THEN 'Docker, k8s (helm charts) and node.js'
    WHEN 5 THEN 'knowledge of go modules, c/c++ and application security is what the whole team here needs' ELSE 'r and c, job security' END, chr(10),
  CASE WHEN doc_id % 3 = 0 THEN 'Bonus points' ELSE 'Benefits' END, chr(10), 'React, Kafka; go to market with all of our partners', chr(10), 'PostgreSQL') AS description_text
FROM documents""",
    "raw_resumes": """
SELECT doc_id AS id, concat('Person ', CAST(doc_id AS STRING), chr(10), CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '+49 (030) 1234 5678' ELSE concat('mail: me', CAST(doc_id AS STRING), '@example.org | 555-1234, github.com/me', CAST(doc_id % 3 AS STRING), '/ https://github.com/ME0') END, chr(10),
  CASE WHEN doc_id % 3 = 0 THEN 'About me' ELSE '' END, chr(10), CASE WHEN doc_id % 7 = 0 THEN '9+ years of it. ' ELSE '' END, coalesce(text, ''), chr(10), CASE doc_id % 4 WHEN 0 THEN '  TECHNICAL SKILLS & Tools: ' WHEN 1 THEN 'Tech  Stack' WHEN 2 THEN 'Proficiencies --' ELSE '' END, chr(10),
  'Python (5+ years), docker, 3 yrs and PostgreSQL; react', chr(10), CASE WHEN doc_id % 6 < 4 THEN concat('Professional Experience', chr(10), CASE doc_id % 6 WHEN 0 THEN 'Jan 2015 - March 2018, then Feb. 2017 to 2019 with kafka - 2 years' WHEN 1 THEN '2010 until 2012; sept 2020 - present' WHEN 2 THEN '1949 - 1951 and 2030 - 2031' ELSE 'no dates, but docker' END) ELSE '' END, chr(10),
  CASE WHEN doc_id % 2 = 0 THEN concat('Education and Training', chr(10), 'BSc 2001 - 2004, react') ELSE 'Hobbies' END, chr(10), 'kafka and kubernetes', chr(10), 'Side projects:', chr(10), 'java spring boot') AS text
FROM documents""",
    "user_skills": """
SELECT user_id, concat(event_type, ' ', CAST(event_id % 6 AS STRING)) AS skill, CASE WHEN max(event_id) % 3 = 0 THEN NULL ELSE CAST(max(event_id) % 9 AS DOUBLE) END AS years,
  CASE WHEN min(event_id) % 2 = 0 THEN 'manual' ELSE 'resume' END AS origin
FROM events GROUP BY user_id, event_type, event_id % 6""",
    "watched_companies": """
SELECT DISTINCT user_id, event_id % (SELECT max(c_custkey) FROM customer) + 1 AS company_id FROM events WHERE event_type = 'view'""",
}


def with_tables(*names: str) -> str:
    """``name AS (...)`` for some tables, for use after WITH."""
    return ",\n".join(f"{name} AS ({TABLES[name]})" for name in names)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One canonical table; only the raw tables that it names are read.

    ``spread`` shuffles the joins of tables that grow. Otherwise Spark broadcasts what it takes for small by the size of
    compressed files, and such a table goes through the driver many times larger.
    """
    sql = TABLES[name]
    used = {t: raw(spark, sf_dir, t) for t in RAW if any(f" {t}{end}" in f"{sql} ".replace("\n", " ") for end in " )")}
    if spread:
        used = {t: df if t in FIXED else df.hint("merge") for t, df in used.items()}
    for t in used:
        for word in ("FROM", "JOIN"):
            for end in (" ", ")"):
                sql = f"{sql} ".replace(f"{word} {t}{end}", f"{word} {{{t}}}{end}")
    return spark.sql(sql, **used)
