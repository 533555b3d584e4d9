import random
import zlib

from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import toxicity as op

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = op.digest(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    apart = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in apart) / len(apart) > 0.97
    toxic = [r for r in apart if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8


def test_edge_cases(spark):
    rng = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "Ünder", "über"]
    text = lambda bad: " ".join([*rng.choices(words, k=30), *(["vilest"] if bad else [])])
    rows = [(i, text(i % 3 == 0), "z") for i in range(120)] + [(500, None, "z"), (501, "", "z"), (None, "vilest", "z"), (502, text(True) * 500, "z"), (502, text(True) * 500, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(3, 1, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = op.digest(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 120)
    assert {r.predicted for r in got if r.doc_id == 502} == {1} and all(0 <= r.score <= 1 for r in got)
    assert {r.score < 0.1 for r in op.digest(docs, labels.filter("toxic = 0")).collect()} == {True}
    assert op.digest(docs.limit(0), labels).count() == 0
    assert op.digest(docs, labels.limit(0)).count() == len(rows)


def test_scores_equal_a_plain_recomputation(spark):
    rng = random.Random(2)
    mild, bad = ["ab", "cde", "fé"], ["xyz", "vw"]
    rows = [(" ".join(rng.choices(mild + bad * (i % 2), k=4)) + "!", i % 2 if i < 16 else None) for i in range(24)]
    rows += [rows[0], rows[0], rows[1]]  # repeated rows count
    docs = spark.createDataFrame([(i if i < 24 else (0, 0, 1)[i - 24], t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows[:24]) if y is not None], "doc_id long, toxic int")
    model = op.train(docs, labels, penalty=0.05, certainty=0.5, steps=4000)
    got = [r.s for r in docs.select(op.score(F.col("text"), model).alias("s")).collect()]
    want = brute.toxic_scores(rows, 0.05, op.SMOOTH, 0.5)
    assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 1e-3 and max(want) - min(want) > 0.3


def test_the_sample_is_bounded_and_holds_different_rows(spark):
    rows = spark.createDataFrame([(i % 40 if i < 900 else i, f"t{i % 40 if i < 900 else i}", int(i % 40 < 20 if i < 900 else i % 2)) for i in range(1000)], "_i long, _t string, _y int")
    n1 = rows.filter("_y = 1").count()
    got = op.drawn(rows, 1000 - n1, n1, 15).collect()
    assert len(got) == 30 == len({r._t for r in got}) and sum(r._y for r in got) == 15
    assert got and all(r.weight == rows.filter(F.col("_t") == r._t).count() for r in got[:4])
    assert sorted(got) == sorted(op.drawn(rows.repartition(7), 1000 - n1, n1, 15).collect())
    every = op.drawn(rows, 1000 - n1, n1, 10**6)
    assert every.count() == rows.distinct().count() and every.agg(F.sum("weight")).first()[0] == 1000
