import zlib

import duckdb
import pytest

from tidemark.llm import warc as op

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sql_oracle(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet' union all select page_id + 1000, url, html from '{SF}/pages.parquet' where page_id < 9")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = pages.filter("page_id < 9").selectExpr("page_id + 1000 as page_id", "url", "html")
    got = rows_of(op.digest(pages.unionByName(more)))
    assert got == sorted(con.sql(op.ORACLE).fetchall(), key=repr)
    assert sum(x[3] == "revisit" for x in got) == con.sql("select count(*) from pages where page_id < 9 and octet_length(encode(html)) >= 1000").fetchall()[0][0] > 0


def test_edge_cases(spark):
    big, small = "é" * 500, "x" * 999
    data = [(1, "http://a b/\n", big), (2, None, big), (2, "u", big), (None, "n", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 100)]
    pages = spark.createDataFrame([(*x, 1) for x in data], "page_id long, url string, html string, records int")
    got = rows_of(op.digest(pages))
    assert sorted(((x[0], x[1], x[3], x[4]) for x in got), key=repr) == sorted([(1, 1000, "revisit", 2), (2, 1000, "response", None), (2, 1000, "response", None), (None, 1000, "revisit", 2), (3, 999, "response", None), (4, 999, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, 1500, "response", None)], key=repr)
    assert op.digest(pages.limit(0)).count() == 0


def test_members_open_alone_and_payloads_come_back(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    members = op.normalise(op.write_archives(pages))
    back = {r.page_id: r for r in op.read_archives(members).collect()}
    assert all(back[r.page_id].payload in (r.html, None) for r in pages.collect()) and len(back) == pages.count()
    path = members.first().archive
    store, name = op._store(path)
    with store.open_input_stream(name, compression=None) as f:
        first = zlib.decompressobj(31).decompress(f.read())
    assert first.startswith(b"WARC/1.1\r\n") and first.count(b"WARC-Type") == 1


@pytest.mark.parametrize("cut", [10, 60])
def test_a_cut_archive_is_an_error(cut):
    raw = op.record(1, "u", b"payload", "0" * 40, None)
    assert [r for _, r in op.records([raw, raw[:7], raw[7:]])] == [raw, raw]
    with pytest.raises(ValueError):
        list(op.records([raw, raw[:cut]]))
