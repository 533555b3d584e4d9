import uuid

from pyspark.sql import functions as F

from tidemark.functions import keys, numeric, text
from tidemark.operators import joins, windows
from tidemark.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_csv_round(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿id,name,n,ok\n1,"a ""b""\nc", 7 ,yes\n2,,x,no\n3,z,,\n', encoding="utf-8")
    df = files.read_csv(spark, str(path))
    assert df.columns == ["id", "name", "n", "ok"] and df.filter("id = 1").first().name == 'a "b"\nc'
    good, bad = files.typed(df, {"id": "int", "name": "string", "n": "int", "ok": "boolean"})
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, 'a "b"\nc', 7, True), (3, "z", None, None)]
    assert [r.problems for r in bad.collect()] == [["n"]]
    files.write_csv(good.withColumn("l", F.array("n")), str(tmp_path / "out"), ["id", "l"])
    assert sorted(r.l for r in files.read_csv(spark, str(tmp_path / "out")).collect()) == ["[7]", "[null]"]
    assert files.manifest(spark, str(path)).first().bytes == path.stat().st_size
    assert files.renamed(spark.createDataFrame([(1, 2, 3)], ["unitId", "unit-id", "A"])).columns == ["unit_id", "unit_id_2", "a"]


def test_upsert_and_partitions(spark, tmp_path):
    target = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(target)
    files.upsert(target, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"], str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    parts = str(tmp_path / "p")
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), parts, ["k"])
    files.replace_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), parts, ["k"])
    assert sorted((r.v, r.k) for r in spark.read.parquet(parts).collect()) == [(1, "a"), (9, "b")]


def test_html_tables_expand_spans(spark):
    markup = "<p>x</p><table><tr><th rowspan=2>A</th><th colspan='2'>B &amp; C</th></tr><tr><td>1</td><td><b>2</b></td></tr></table><table><tr><td>z</table>"
    got = {(r.table, r.row, r.column): r.text for r in files.html_tables(spark.createDataFrame([(1, markup), (2, None)], "id long, html string"), "id", "html").collect()}
    assert got == {(0, 0, 0): "A", (0, 0, 1): "B & C", (0, 0, 2): "B & C", (0, 1, 0): "A", (0, 1, 1): "1", (0, 1, 2): "2", (1, 0, 0): "z"}


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, numeric.round2(lit(-0.125))) == -0.12 and one(spark, numeric.int_prefix(lit(" 7칸"))) == 7
    assert one(spark, numeric.float_prefix(lit("64.9%"))) == 64.9 and one(spark, numeric.number_tokens(lit("3.5 : 2"))) == [1.75]
    assert one(spark, numeric.less_than_score(lit("42 미만"), "미만")).asDict() == {"value": 42.0, "operator": "lt"}
    assert abs(one(spark, numeric.normal_cdf(numeric.probit(lit(0.975)))) - 0.975) < 1e-6
    assert abs(one(spark, numeric.composite_percentile([(lit(93.0), 1.0), (lit(None).cast("double"), 1.0)])) - 93) < 1e-4
    assert one(spark, text.initial(lit("나라"))) == "ㄴ" and one(spark, text.initial(lit("abc"))) == "A"
    assert one(spark, text.search_rank(lit("서울 대"), F.array(lit("(국) 서울대학교"), lit("서울대")))) == 0
    assert one(spark, text.canonical_url(lit("HTTP://A.com/x/?b=2&a=1#f"))) == "http://a.com/x/?b=2&a=1" and one(spark, text.canonical_url(lit("HTTP://A.com?b=2&a=1#f"), sort_query=True)) == "http://a.com/?a=1&b=2"
    assert one(spark, text.plain_text(lit("<p>a&amp;b<script>x</script> c</p>"))) == "a&b c" and one(spark, text.quotas(lit("10명, 600 명 10 명 5명"))) == [10, 5]
    assert one(spark, text.dates(lit("2026.01.02 ~ 01.05"))) == ["2026.01.02", "01.05"] and one(spark, text.label_path([lit("a"), lit(""), lit("a"), lit("b")])) == "a > b"
    assert one(spark, text.listed(lit("a, ,b\nc"))) == ["a", "b", "c"] and one(spark, text.first_filled(lit(" "), lit("x "))) == "x"
    assert one(spark, text.excerpt(lit("0123456789term"), ["none", "term"], 3, 5)) == "789term"
    assert one(spark, keys.uuid5(lit("가/1"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "가/1")) and one(spark, keys.stable_json(lit('{"b":1,"a":{"d":2,"c":3}}'))) == '{"a":{"c":3,"d":2},"b":1}'


def test_greedy_spans_islands_and_edits(spark):
    spans = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(a).alias("start"), F.lit(b).alias("end")) for r, a, b in [("x", 1, 5), ("x", 4, 8), ("y", 4, 8), ("x", 9, 9), ("x", 20, 21)]))
    assert [tuple(x) for x in one(spark, windows.greedy_spans(spans, 2, 9))] == [("x", 1, 5), ("y", 4, 8), ("x", 9, 9)]
    assert one(spark, windows.folded_score(F.array(F.lit(3), F.lit(9), F.lit(1)))) == 11
    fresh = spark.createDataFrame([(1, "new"), (2, "n2")], "id int, note string")
    old = spark.createDataFrame([(1, "mine"), (2, " ")], "id int, note string")
    assert sorted(map(tuple, joins.kept_edits(fresh, old, "id", ["note"]).collect())) == [(1, "mine"), (2, "n2")]
    probes = spark.createDataFrame([(1, ["q", "b", "a"])], "t int, ids array<string>")
    assert joins.first_listed(probes, "ids", spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), "id", "t").first().v == 2


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.events import tumbling

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = tumbling(spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parque*"))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, tumbling(events).collect()))
