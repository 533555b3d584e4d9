import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import quality_classifier as op

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = op.digest(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    apart = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in apart) / len(apart) > 0.98
    for lang in {r.lang for r in docs.select("lang").distinct().collect()}:
        own = [r for r in spark.createDataFrame(apart).join(docs.filter(F.col("lang") == lang).select("doc_id"), "doc_id").collect()]
        assert sum(r.predicted == r.quality for r in own) / len(own) > 0.95
        assert sum(r.predicted for r in own if r.quality == 0) <= 0.2 * sum(r.quality == 0 for r in own)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("ab é\n", max_size=400), st.just("é" * 3000)), max_size=6))
def test_passages_are_all_bytes_of_their_document_once(texts):
    raws = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raws)])
    raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
    first, end, owner = op.passages(raw, offsets)
    assert owner.tolist() == sorted(owner.tolist()) and set(owner.tolist()) == set(range(len(texts)))
    for d, t in enumerate(raws):
        own = [raw[a:b].tobytes() for a, b in zip(first[owner == d], end[owner == d], strict=True)]
        assert b"".join(own) == t and all(len(p) <= op.PASSAGE_BYTES + 400 for p in own) and (len(own) == 1 or all(own))
        assert all(p.decode("utf-8") is not None for p in own)


def test_features_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    texts = ["", "One two two!", "%%% A | b | c", "é" * 50, "x"] * 3
    raws = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raws)])
    raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
    together = op.features(raw, at[:-1], at[1:])
    alone = [op.features(np.frombuffer(r, dtype=np.uint8), np.array([0]), np.array([len(r)])) for r in raws]
    assert np.allclose(together, np.concatenate(alone)) and together.shape == (15, op.WIDTH) and rng is not None


def test_attention_finds_the_passage_that_decides():
    """Bags of random rows; label 0 has one row that is different. Without attention the mean would drown it."""
    rng = np.random.default_rng(5)
    size = rng.integers(5, 40, 300)
    start, y = np.cumsum(size) - size, np.arange(300) % 2
    x = rng.normal(0, 0.3, (size.sum(), 12)).astype(np.float32)
    bad = start[y == 0] + rng.integers(0, size[y == 0])
    x[bad, 0] += 2.5
    model = op.fit(x, start, y.astype(float), np.ones(300), epochs=60)
    e, v = op.attended(model, x)
    p = op._sigmoid(op.pooled(e, v, start) + model.bias)
    assert ((p >= 0.5) == y).mean() > 0.97
    weights = np.exp(e - e.max())
    share = np.array([weights[b] / weights[s : s + n].sum() for b, s, n in zip(bad, start[y == 0], size[y == 0], strict=True)])
    assert share.mean() > 5 * (1 / size[y == 0]).mean()


def test_edge_cases(spark):
    rng = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "über"]
    text = lambda bad: " ".join(w + "%%%" * bad for w in rng.choices(words, k=70))
    rows = [(i, text(i % 3 == 0), 1.0) for i in range(240)] + [(500, None, 1.0), (501, "", 1.0), (None, text(True), 1.0), (502, text(True) * 900, 1.0), (502, text(True) * 900, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(3, 0, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = op.digest(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 240)
    assert {r.predicted for r in got if r.doc_id == 502} == {0}
    assert {r.score > 0.9 for r in op.digest(docs, labels.filter("quality = 1")).collect()} == {True}
    assert op.digest(docs.limit(0), labels).count() == 0 and op.digest(docs, labels.limit(0)).count() == len(rows)


def test_the_sample_is_bounded_and_holds_different_rows(spark):
    rows = spark.createDataFrame([(i % 50, "word " * (i % 50 * 8), int(i % 2)) for i in range(400)], "_i long, _t string, _y int")
    got = op.drawn(rows, {0: 200, 1: 200}, 20, 60, 8).collect()
    for y in (0, 1):
        own = [r for r in got if r._y == y]
        assert 5 < len(own) <= 20 and sum(r.many for r in own) <= 60 and max(r.many for r in own) <= 8 and {r.weight for r in own} == {8}
    assert len(got) == len({r._t for r in got})
