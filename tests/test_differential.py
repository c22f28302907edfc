"""Every query against its SQL, run by another engine over the same files."""

from __future__ import annotations

import duckdb
import pytest

from jobloom.plans.oracles import ORACLES
from jobloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other(sf_dir):
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, other, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = other.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in rel.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
