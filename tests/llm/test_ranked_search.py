import random

import pytest

from tests.llm import brute
from tidemark.llm import ranked_search as op

DOCS, ITEMS = "doc_id long, text string, s string, q int", "item_id long, text string, row int"


def rows(seed, docs, items, words=400):
    rng = random.Random(seed)
    names = [f"w{i}" if i % 5 else f"Ü{i}" for i in range(words)]
    often = [1 / (i + 1) for i in range(words)]
    text = lambda n: " ".join(rng.choices(names, often, k=n)).replace("w7 ", "W7--")
    return [(i, text(rng.choice((0, 1, 5, 40, 300))), "a", 1) for i in range(docs)], [(i, text(rng.randint(1, 30)), 1) for i in range(items)]


@pytest.mark.parametrize("k, block, asked", [(20, 200_000, 200_000), (3, 500, 40), (1, 200, 10**6)])
def test_search_equals_brute_force(spark, monkeypatch, k, block, asked):
    docs, items = rows(k, 400, 25)
    docs += docs[5:25]  # rows of equal id and text
    docs += [(1000 + i, docs[30][1], "a", 1) for i in range(30)]  # ties
    monkeypatch.setattr(op, "BLOCK_ROWS", block)
    monkeypatch.setattr(op, "ASKED_ROWS", asked)
    monkeypatch.setattr(op, "SUMS_AT_ONCE", 300 if block < 1000 else 10**6)
    got = op.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS).repartition(2), k=k).collect()
    assert sorted(map(tuple, got)) == sorted(brute.ranked([d[:2] for d in docs], [i[:2] for i in items], k))


def test_nulls_empties_and_repeated_items(spark):
    docs, items = rows(3, 60, 4)
    docs += [(None, items[0][1], "a", 1), (None, None, "a", 1), (70, "", "a", 1), (71, "... !!", "a", 1), (72, "w1 " * 60_000, "a", 1)]
    items += [(90, None, 1), (91, "", 1), (92, "nowhere", 1), (93, "w1 w1 w1", 1), (None, "w2 w3", 1), (0, items[0][1], 1)]
    got = op.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute.ranked([d[:2] for d in docs], [i[:2] for i in items]), key=key)
    assert {r.item_id for r in got} == {0, 1, 2, 3, 93, None}


def test_empty_tables(spark):
    docs, items = rows(1, 10, 2)
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert op.search(docs.limit(0), items).count() == 0 and op.search(docs, items.limit(0)).count() == 0
    assert dict(op.search(docs, items).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
