import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidemark.llm import suffix_dedup as op
from tidemark.llm.superkmer import Units, keyed, repeated_spans

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, spans string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 4))
def test_two_stage_order_is_the_order_of_suffixes(symbols, last):
    text = [*symbols, last, 0]
    got = op.suffix_order(np.array(text, dtype=np.int64), 1000).tolist()
    assert got == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.randoms(use_true_random=False), st.sampled_from([5, 8, 12, 20, 33, 40, 61]))
def test_spans_equal_brute_force(rng, k):
    base = bytes(rng.choices(b"ab c\0", k=300))
    strings = []
    for _ in range(6):
        s = bytearray(base[rng.randint(0, 100) : rng.randint(150, 300)])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice(b"abcz")
        strings.append(bytes(s))
    got = op.resolve_bytes(strings, np.zeros(len(strings), dtype=bool), k)
    seen = Counter(s[i : i + k] for s in strings for i in range(len(s) - k + 1))
    for j, s in enumerate(strings):
        want = brute.cover(len(s), [i for i in range(len(s) - k + 1) if seen[s[i : i + k]] > 1], k)
        assert brute.cover(len(s), [x for a, b in got.get(j, []) for x in range(a, b)], 1) == want


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=2, max_size=60), st.data())
def test_common_prefixes_are_whole(raw, data):
    raw = raw + raw
    places = st.lists(st.integers(0, len(raw) - 1), min_size=3, max_size=3)
    a, b = (np.array(data.draw(places)) for _ in "ab")
    same = lambda x, y: next((i for i in range(20) if i >= len(raw) - max(x, y) or raw[x + i] != raw[y + i]), 20)
    got = np.minimum(op.common_prefixes(np.frombuffer(raw, dtype=np.uint8), a, b, 20), len(raw) - np.maximum(a, b))
    assert got.tolist() == [same(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_equals_brute_force_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.suffix_dedup([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], op.WINDOW_BYTES)
    assert sum(x[2] for x in want) > 0
    assert rows_of(op.digest(docs)) == sorted(want, key=repr)


def test_edge_cases(spark):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdé fgh\n", k=900))
    data = [(1, None), (2, ""), (3, passage), (4, "x" + passage + "y"), (5, "a" * 2000), (6, "ab" * 700), (7, passage[:399]), (8, passage), (8, passage), (None, passage[100:600])]
    docs = spark.createDataFrame([(i, t, "z") for i, t in data], SCHEMA)
    assert rows_of(op.digest(docs)) == sorted(brute.suffix_dedup(data, op.WINDOW_BYTES), key=repr)
    assert op.digest(docs.limit(0)).count() == 0


def test_windows_of_heavy_minimisers_travel_as_hashes(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefgh ijkl", k=n))
    passage, short = text(700), text(300)
    data = [(i, text(rng.randint(0, 300)) + (passage if i % 3 else short) + text(rng.randint(0, 300))) for i in range(60)]
    data += [(100 + i, passage + text(50)) for i in range(5)] + [(200, passage), (200, passage), (201, "ab" * 900)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want = brute.suffix_dedup(data, op.WINDOW_BYTES)
    units = Units("bytes", op.WINDOW_BYTES, op.GRAM_BYTES)
    rows = keyed(docs, "doc_id", "text")
    for heavy in (1, 3, 40):
        spans = repeated_spans(rows, units, op.resolve_bytes, heavy=heavy, bucket_strings=7)
        got = rows.join(spans, "_k", "left").mapInArrow(op._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        assert rows_of(got) == sorted(want, key=repr)
