"""The stages, each on its own input, against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import brute
from tests.llm.test_packing import checked
from tidemark.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_whole_rows(stages):
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == before.columns == list(cp.COLUMNS)
        assert set(rows(after)) <= set(rows(before))


def test_toxicity_follows_the_scores(spark, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    fine = {r.doc_id for r in stages[0].filter(toxicity.score(F.col("text"), model) < 0.5).collect()}
    assert set(rows(stages[1])) == fine and 0 < len(fine) < stages[0].count()


def test_near_dedup_keeps_one_of_each_class(stages):
    classes = brute.near_classes([(r.doc_id, r.text) for r in stages[1].collect()])
    assert set(rows(stages[2])) == set(classes.values())


def test_substring_dedup_cuts_what_brute_force_cuts(stages):
    want = {x[0]: x for x in brute.substring_dedup([(r.doc_id, r.text) for r in stages[2].collect()], 35)}
    for i, r in rows(stages[3]).items():
        words = r.text.encode().split()
        assert (len(words), hashlib.sha256(b" ".join(words)).hexdigest()) == (want[i][1] - want[i][2], want[i][3])
        assert r.n_chars == len(r.text)


def test_decontamination_drops_documents_with_a_passage(spark, stages):
    plain = lambda t: f" {' '.join(''.join(c.lower() if c.isalnum() else ' ' for c in t).split())} "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, r in rows(stages[3]).items() if any(x in plain(r.text) for x in items)}
    assert set(rows(stages[4])) == set(rows(stages[3])) - leaked


def test_packing_holds_every_token(stages):
    checked(stages[5].collect(), [(r.doc_id, r.text) for r in stages[4].collect()])


def test_run_is_the_chain_of_stages(spark, stages):
    assert cp.run(spark, SF).select("doc_id").distinct().count() == stages[4].count()
