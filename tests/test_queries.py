"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import NAMES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in NAMES.items() if sql))
def test_query_equals_its_oracle(spark, con, name):
    f, sql = NAMES[name]
    df = f(spark, SF)
    rel = con.sql(sql)
    columns = list(rel.columns)
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(norm(v) for v in r) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    assert len(got) == len(want) and got == want


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in NAMES.items() if not sql))
def test_query_without_oracle_runs(spark, name):
    assert NAMES[name][0](spark, SF).count() > 0
