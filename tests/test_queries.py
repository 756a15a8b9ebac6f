"""Every registered photo query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__
from framelake import log_queries, oracles, queries, scene_queries
from framelake.streaming.bursts import burst_sessions

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else str(v)


QUERIES = queries.QUERIES | scene_queries.QUERIES | log_queries.QUERIES
ORACLES = oracles.ORACLES | scene_queries.ORACLES | log_queries.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rel = db.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(repr([plain(x[c]) for c in columns]) for x in df.collect())
    want = sorted(repr([plain(dict(zip(rel.columns, x, strict=True))[c]) for c in columns]) for x in rel.fetchall())
    assert got == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_burst_sessions_follow_the_rule(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    got = burst_sessions(events)
    want = queries.burst_groups(spark, sf_dir)
    assert sorted(x.n for x in got.collect()) == sorted(x["size"] for x in want.collect())
