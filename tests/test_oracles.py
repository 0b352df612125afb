"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from corvane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents conversations pages benchmark labels events embeddings region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(row):
    return repr(tuple(None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    said = db.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(plain, df.select(*cols).collect())) == sorted(map(plain, said))


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, SF).count() > 0
