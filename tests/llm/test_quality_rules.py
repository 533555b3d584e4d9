import duckdb

from tests.llm import brute
from tidemark.llm import quality_rules as op

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, _host string, kept string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.quality([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert sorted((x[:7] for x in rows_of(op.digest(docs))), key=repr) == sorted(want, key=repr)


def test_edge_cases(spark):
    data = [(1, None), (2, ""), (3, "a b c a b c"), (4, "x\n\nx\n \nx\n\t\n#$é"), (5, "w " * 4000), (5, "w " * 4000), (None, "é|è\x0bü")]
    docs = spark.createDataFrame([(i, t, None if i == 2 else "h", "z", "z") for i, t in data], SCHEMA)
    want = brute.quality([(i, "h", t) for i, t in data])
    assert sorted((x[:7] for x in rows_of(op.digest(docs))), key=repr) == sorted(want, key=repr)
    assert op.digest(docs.limit(0)).count() == 0


def test_a_bad_host_takes_its_documents_along_and_small_ones_shrink(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    data = [(f"a{i}", good) for i in range(20) for _ in range(30)] + [("bad", bad)] * 80 + [("bad", good)] * 5 + [("tiny", bad), ("tiny", good)]
    docs = spark.createDataFrame([(j, t, s, "", "") for j, (s, t) in enumerate(data)], SCHEMA)
    kept = {(r._host, r.base_failed): r.kept for r in op.judged(docs).collect()}
    assert kept[("a0", False)] and not kept[("bad", False)] and kept[("tiny", False)] and not kept[("tiny", True)]


def test_sql_oracle(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = rows_of(op.digest(spark.read.parquet(f"{SF}/documents.parquet")))
    assert got == sorted(con.sql(op.ORACLE).fetchall(), key=repr)
