import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing as op

SF = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(0, 80))
def test_the_closest_multiset_is_the_best_one(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * j for s in sums for j in range(c + 1)}
    pick = op.closest_multiset(counts, room)
    assert all(0 < c <= counts[n] for n, c in pick.items())
    assert sum(n * c for n, c in pick.items()) == max(s for s in sums if s <= room)


def checked(rows, texts, window=op.WINDOW):
    tokenizer = Tokenizer.from_file(op.default_vocabulary())
    want = sorted((i, [*e.ids, 1]) for (i, _), e in zip(texts, tokenizer.encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in want:
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            own = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(own.tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return sum(n for s in sequences.values() for _, n in s) / (len(sequences) * window)


def test_pieces_and_sequences_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = checked(op.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert full > 0.995


def test_edge_cases(spark):
    data = [(1, None), (2, ""), (3, "<|endoftext|> a<|startoftext|>b  "), (4, "É ﬁ x é ́y İΣ ΑΣ. don't I'LL 12345"), (5, "word " * 9000), (6, "x" * 9000), (7, "z"), (9, "A.B,c;d:e!f?g... <|ENDOFTEXT|> <|endoftext|>. x~y ~ ~~ It's. E\u0301, é. ….'' O'NEIL'S, 3.5,a"), (8, "日本語 テキスト \x0b\x0c ﻿")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in data], "doc_id long, text string, start string")
    checked(op.pack(docs).collect(), data)
    assert op.pack(docs.limit(0)).count() == 0
    twice = docs.filter("doc_id = 7").unionAll(docs.filter("doc_id = 7"))
    assert len({(r.sequence_id, r.offset) for r in op.pack(twice).collect()}) == 2
    ids = op.pack(docs, with_ids=True).filter("doc_id = 5").orderBy("start").collect()
    assert all(len(r.ids) == r.length for r in ids)


@pytest.mark.parametrize("seed", range(3))
def test_little_slack(seed):
    lengths = np.random.default_rng(seed).integers(1, op.WINDOW, 2000).tolist()
    out = op.minimum_slack(lengths, op.WINDOW)
    assert sorted(i for s in out for i in s) == list(range(2000))
    assert all(sum(lengths[i] for i in s) <= op.WINDOW for s in out)
    assert len(out) <= -(-sum(lengths) // op.WINDOW) + 60


def test_equal_rows_are_dealt_to_several_shards(spark):
    docs = spark.createDataFrame([(None, None)] * 4000, "doc_id long, text string").repartition(16)
    got = op.pack(docs, docs_per_shard=250).groupBy((F.col("sequence_id") / 2**32).cast("long")).count().collect()
    assert len(got) >= 8 and sum(r["count"] for r in got) == 4000 and max(r["count"] for r in got) <= 1000


def test_the_table_is_small_between_tasks(monkeypatch):
    encoder = op.Encoder(op.default_vocabulary(), 1)
    texts = [" ".join(f"Word{i}, näher {i * 7}." for i in range(a, a + 40)) for a in (0, 20, 40)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    run = lambda: [x.tolist() for x in encoder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)]
    before = run()
    encoder.rest()
    assert encoder.known
    monkeypatch.setattr(op, "KEPT_BETWEEN_TASKS", 10)
    encoder.rest()
    assert not encoder.known and run() == before
