"""Queries of the corpus operators against their SQL on the small tables."""

import duckdb
import pytest

from loomkit.llm import queries as Q
from loomkit.session import TABLES
from tests.conftest import MEDIUM
from tools.oracle_check import digest


@pytest.mark.parametrize("sf", [MEDIUM])
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert digest(Q.QUERIES[name](spark, sf).toPandas()) == digest(con.execute(Q.ORACLES[name]).df())
