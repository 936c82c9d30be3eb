"""Each query that has SQL against it, in DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from docloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    answer = duck.execute(queries.oracle_sql()[name])
    places = [[d[0] for d in answer.description].index(c) for c in columns]
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(tuple(r[i] for i in places) for r in answer.fetchall())
