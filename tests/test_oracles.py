"""Every registered query with an oracle equals DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as E
from loomkit.session import TABLES
from tests.conftest import SMALL
from tools.oracle_check import digest

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert digest(got) == digest(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 11 and "semantic_type" in df.columns
