import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidemark.llm import order_minhash as op

SF = "/root/testdata/sf0.01"
SYMBOLS = st.lists(st.integers(0, 3), max_size=14)


@settings(max_examples=400, deadline=None)
@given(SYMBOLS, SYMBOLS, st.integers(0, 16))
def test_banded_distance_is_the_edit_distance(a, b, band):
    want, got = brute.distance(a, b), op.banded_distance(a, b, band)
    assert got == want if want <= band else got > band


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=30), st.data())
def test_similar_agrees_with_the_distance(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 6))):
        b[data.draw(st.integers(0, len(b) - 1))] = data.draw(st.integers(0, 30))
    b += data.draw(st.lists(st.integers(0, 30), max_size=4))
    want = brute.distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
    assert op.similar(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 0.8) == want


def test_classes_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sure, want = brute.near_classes(rows, unit="shingles"), brute.near_classes(rows)
    got = {r.doc_id: r.class_id for r in op.digest(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    # every pair of a shingle similarity of 0.8 is linked, and no pair that has no word similarity of 0.8
    assert len(set(sure.values())) < len(rows)
    assert all(got[i] == got[c] for i, c in sure.items())
    assert all(want[i] == want[c] for i, c in got.items())
    linked = [i for i, c in want.items() if i != c]
    assert sum(got[i] == got[want[i]] for i in linked) >= 0.95 * len(linked)


def test_recall_by_the_share_of_substituted_words(spark):
    rng = random.Random(12)
    for every, least in ((20, 0.995), (10, 0.97)):
        data = []
        for i in range(300):
            text = [f"w{rng.randrange(20000)}" for _ in range(rng.randint(60, 400))]
            data.append((2 * i, " ".join(text)))
            for at in rng.sample(range(len(text)), len(text) // every):
                text[at] = f"n{rng.randrange(20000)}"
            data.append((2 * i + 1, " ".join(text)))
        got = {r.doc_id: r.class_id for r in op.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()}
        assert all(got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(300))
        assert sum(got[2 * i + 1] == 2 * i for i in range(300)) >= least * 300


def test_very_long_texts_align_in_linear_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 32, 200_000, dtype=np.uint32)
    b = np.delete(a, [40, 90_000, 150_000])
    b[[7, 60_000, 120_000, 180_000]] = 5
    tracemalloc.start()
    assert op.similar(a, b, 0.8)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_rows_of_one_id_with_different_texts(spark):
    data = [(1, "one two three four five six", "x"), (1, "seven eight nine ten eleven twelve", "y"), (2, "one two three four five six", "z"), (1, None, None), (3, "alone", "q")]
    docs = spark.createDataFrame(data, "doc_id long, text string, id string")
    left = [(r.doc_id, r.text) for r in op.one_of_each(docs).collect()]
    assert len(left) == 4 and {t for _, t in left} == {t for _, t, _ in data}
    got = op.digest(docs).collect()
    assert len(got) == 5 and sum(r.is_kept for r in got) == 4


def test_a_chain_and_edge_cases(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=200)
    data = [(1, None), (2, None), (3, ""), (4, ""), (5, "!!"), (6, "a b"), (7, "A b."), (8, "a c"), (None, "alone in the world it is"), (9, "same"), (9, "same")]
    for i in range(40):  # each copy drifts from the one before
        base[5 * i % 200] = f"n{i}"
        data.append((100 + i, " ".join(base)))
    docs = spark.createDataFrame([(*x, "z") for x in data], "doc_id long, text string, class string")
    got = {}
    for r in op.digest(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert {got[100 + i].pop() for i in range(40)} == {100}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [{1}, {2}, {3}, {3}, {5}, {6}, {6}, {8}, {9}]
    left = op.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.filter("doc_id is not null").collect()) == [1, 2, 3, 5, 6, 8, 9, 100]
    assert op.digest(docs.limit(0)).count() == 0 == op.one_of_each(docs.limit(0)).count()


def test_pairs_of_a_bucket_that_are_like_none_of_its_hubs(spark, monkeypatch):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(250)]
    data = []
    for i in range(40):  # 40 pairs of near copies; only the passage, 71 % of each text, is shared by all
        text = passage + [f"d{i}x{j}" for j in range(100)]
        data.append((2 * i, " ".join(text)))
        text[rng.randrange(250, 350)] = "other"
        data.append((2 * i + 1, " ".join(text)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = brute.near_classes(data)
    assert want == {i: i - i % 2 for i in range(80)}
    for most in (op.BROADCAST_SHINGLES, 0):
        monkeypatch.setattr(op, "BROADCAST_SHINGLES", most)
        assert {r.id: r["class"] for r in op.classes(docs, sketches=6, sampled=1).collect()} == want


def test_a_pair_that_shares_only_what_its_large_bucket_shares(spark):
    passage = [f"p{i}" for i in range(100)]
    data = [(i, " ".join(passage + [f"d{i}x{j}" for j in range(60)])) for i in range(200) if i not in (77, 140)]
    # 0.8 of each of the two is the passage, 0.63 of any other text
    data += [(i, " ".join(passage + [f"e{i}x{j}" for j in range(25)])) for i in (77, 140)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = brute.near_classes(data)
    assert sum(i != c for i, c in want.items()) == 1
    assert {r.id: r["class"] for r in op.classes(docs, sketches=4, sampled=1).collect()} == want


def joined(n, links):
    """The least member of each one's component."""
    of = list(range(n))
    while any(of[a] != of[b] for a, b in links):
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_tiles_link_the_classes_of_all_pairs():
    rng = random.Random(9)
    base = [rng.choices(range(300), k=40) for _ in range(12)]
    texts = []
    for i in range(160):
        words = list(base[i % 12])
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.randrange(300)
        texts.append(np.array(words[: rng.randint(34, 40)], dtype=np.int64))
    ids = np.arange(160)
    near = lambda a, b: brute.distance(list(a), list(b)) <= 0.2 * max(len(a), len(b)) + 1e-9
    want = joined(160, [(i, j) for i in range(160) for j in range(i) if near(texts[i], texts[j])])
    tile = lambda lo, hi: (ids[lo:hi], ids[lo:hi], texts[lo:hi])
    links = [*op.tile_links(tile(0, 90), tile(0, 90), True, 0.8), *op.tile_links(tile(90, 160), tile(90, 160), True, 0.8), *op.tile_links(tile(0, 90), tile(90, 160), False, 0.8)]
    assert joined(160, links) == want
    assert len(links) < 480 and 1 < len(set(want)) < 120


@pytest.mark.parametrize("limit", [None, 0])
def test_components_equal_those_of_a_plain_search_and_small_ones_shuffle_little(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(op, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    edges = [(a, a + 1) for a in range(100, 130)] + [(200, b) for b in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7), (9, 5), (5, 9)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    plans, real = [], op.written

    def spy(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(op, "written", spy)
    got = sorted(map(tuple, op.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == sorted((x, find(x)) for x in {x for a, b in edges if a != b for x in (a, b)})
    # of a round: two minima (one stands twice in the text of the plan) and the different edges
    assert limit == 0 or all(p.count("Exchange hashpartitioning") <= 4 for p in plans)
