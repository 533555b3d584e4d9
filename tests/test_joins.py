import duckdb

from tidemark.operators import joins
from tidemark.plans import NAMES

SF = "/root/testdata/sf0.001"


def test_every_row_has_its_siblings(spark):
    rows = [(1, 7, True), (2, 7, True), (3, 7, False), (4, None, True), (5, None, True), (6, 7, None), (7, 7, True)]
    got = {r.id: list(r.siblings) for r in joins.siblings(spark.createDataFrame(rows, "id long, place int, rich boolean"), ["place", "rich"], "id").collect()}
    assert got == {1: [2, 7], 2: [1, 7], 3: [], 4: [], 5: [], 6: [], 7: [1, 2]}


def test_cluster_siblings_has_a_row_a_supplier(spark):
    f, sql = NAMES["cluster_siblings"]
    want = duckdb.sql(f"with supplier as (select * from '{SF}/supplier.parquet') select * from ({sql})").fetchall()
    got = [(r.s_suppkey, r.siblings) for r in f(spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/supplier.parquet").count() and sorted(got) == sorted(want)
