import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "benchmark")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    columns = list(rel.columns)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
