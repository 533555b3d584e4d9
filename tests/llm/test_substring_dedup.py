import random

from tests.llm import brute
from tidemark.llm import substring_dedup as op
from tidemark.llm.superkmer import keyed, repeated_spans, Units

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_brute_force_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.substring_dedup([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], op.WINDOW_WORDS)
    assert sum(x[2] for x in want) > 0
    assert rows_of(op.digest(docs)) == sorted(want, key=repr)


def test_edge_cases(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    data = [(1, None), (2, ""), (3, passage), (4, f"a  b\n{passage}\tc"), (5, passage), (5, passage), (None, passage), (6, "x " * 3000), (7, " ".join(rng.choices(words, k=5000))), (8, " \n\t ")]
    rows = [(i, t, "en", "s", None) for i, t in data]
    got = op.digest(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(got) == sorted(brute.substring_dedup(data, op.WINDOW_WORDS), key=repr)


def test_empty_table_and_extra_columns(spark):
    assert op.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(str(i) for i in range(50))
    docs = spark.createDataFrame([(1, text, "spans"), (2, text + " end", "s"), (3, None, None)], "doc_id long, text string, spans string")
    docs = docs.withColumnRenamed("spans", "stop")
    got = {r.doc_id: (r.text, r.stop) for r in op.remove_repeats(docs).collect()}
    assert got == {1: ("", "spans"), 2: ("end", "s"), 3: (None, None)}


def test_heavy_minimisers_split_and_lose_nothing(spark):
    passage = [f"p{i}" for i in range(45)]
    data = [(i, " ".join([*(f"a{i}.{j}" for j in range(20)), *passage, *(f"b{i}.{j}" for j in range(20))])) for i in range(60)]
    docs = keyed(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text")
    for heavy in (5, 10**9):
        spans = repeated_spans(docs, Units("words", 35, 8), op.resolve_words, heavy=heavy)
        got = {x["id"]: op._own([x.asDict() for x in r.spans], x["id"]) for r in spans.collect() for x in r.spans}
        assert got == {i: [(20, 65)] for i, _ in data}
