"""The driver's contract: names, and some queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["src_01_sql_source", "tok_01_tokens", "idx_02_dictionary", "qry_01_match_all", "qry_05_phrase", "qry_08_expand", "qry_14_proximity", "qry_20_disabled", "qry_23_group", "htm_01_links", "src_06_crawl"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = c.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(map(str, r)) for r in cur.fetchall()))
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == want
