import random
from itertools import combinations

from tidemark.llm import decontaminate as op

SF = "/root/testdata/sf0.1"


def test_finds_every_benchmark_passage_and_no_other(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())
    held = [(r.item_id, f" {words(r.text)} ") for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for text in [f" {words(r.text)} "] for i, x in held if x in text}
    got = op.overlaps(docs, items).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.overlap_words == r.matched_words for r in got)
    for how in ("BROADCAST_BYTES", "MOST_BITS", "FEWEST_BITS", "BLOCK_WORDS"):  # other joins, a full table, smaller blocks
        monkeypatch.setattr(op, how, {"BROADCAST_BYTES": 0, "MOST_BITS": 15, "FEWEST_BITS": 15, "BLOCK_WORDS": 64}[how])
    assert sorted(op.overlaps(docs, items).collect()) == sorted(got)
    left = op.without_leaks(docs, items)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.select("doc_id").collect()} == {i for i, _ in want}


def test_substitutions_and_edge_cases(spark):
    item = [f"q{i}" for i in range(40)]
    filler = [f"f{i}" for i in range(3000)]
    hit = list(item)
    for i in (5, 12, 18, 26, 33):
        hit[i] = "zzz"
    miss = [w if i % 2 else "zzz" for i, w in enumerate(item)]
    part = item[10:26]
    at = lambda ws: " ".join([*filler[:50], *ws, *filler[50:60]])
    data = [(1, at(hit)), (2, at(miss)), (3, at(part)), (4, at(item[:10])), (5, None), (6, ""), (7, " ".join([*filler, *item, *filler]).upper()), (7, at(item)), (None, at(item)), (8, "tiny one here"), (9, "one tiny here")]
    docs = spark.createDataFrame([(*x, "z") for x in data], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "", 0), (4, "Tiny one", 0), (4, "Tiny one", 0)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.overlap_words, r.matched_words) for r in op.overlaps(docs, items).collect()}
    assert got == {(1, 1): (40, 35), (3, 1): (16, 16), (7, 1): (40, 40), (None, 1): (40, 40), (8, 4): (2, 2)}
    assert sorted(r.doc_id for r in op.without_leaks(docs, items).collect()) == [2, 4, 5, 6, 9]
    assert op.overlaps(docs, items.limit(0)).count() == 0 == op.overlaps(docs.limit(0), items).count()
    assert op.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_substitutions_in_the_middle_and_spread_over_an_item(spark):
    a, b, c = ([f"{x}{i}" for i in range(n)] for x, n in (("a", 16), ("b", 15), ("c", 38)))
    laid = lambda ws, *out: " ".join(["f", "g", *("zzz" if i in out else w for i, w in enumerate(ws)), "h"])
    data = [(1, laid(a, 7, 8)), (2, laid(b, 7, 8)), (3, laid(c, 4, 9, 14, 19, 24, 29, 34)), (4, laid(a, 5, 6, 7, 8)), (5, laid(c, *range(1, 38, 4)))]
    items = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((a, b, c), 1)], "item_id long, text string")
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.overlap_words, r.matched_words) for r in op.overlaps(docs, items).collect()}
    assert got == {(1, 1): (16, 14), (2, 2): (15, 13), (3, 3): (38, 31)}
    assert sorted(r.doc_id for r in op.without_leaks(docs, items).collect()) == [4, 5]


def test_masks_meet_every_pattern_of_substitutions():
    def hit(masks, n, out):
        return any(all(at + j not in out for j, bit in enumerate(m) if bit == "1") for m in masks for at in range(n - len(m) + 1))

    for n, most in ((5, 1), (6, 1), (7, 1), (8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (13, 2), (14, 2), (15, 3), (16, 3), (17, 3), (18, 3), (19, 3), (20, 4)):
        assert all(hit(op.masks_of(n), n, set(out)) for out in combinations(range(n), most))


def test_recall_by_length_and_substitutions(spark):
    rng = random.Random(3)
    items, docs, want = [], [], set()
    for n, most in ((3, 0), (5, 1), (6, 1), (8, 1), (13, 1), (13, 2), (20, 2), (20, 3), (20, 4), (40, 8), (70, 14)):
        for _ in range(30):
            i = len(items)
            words = [f"w{rng.randrange(5000)}x{i}" for _ in range(n)]
            items.append((i, " ".join(words)))
            for at in rng.sample(range(n), most):
                words[at] = "zzz"
            docs.append((i, " ".join([*(f"f{rng.randrange(900)}" for _ in range(rng.randrange(80))), *words, "end"])))
            want.add((i, i))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op.overlaps(*frames).collect()} == want


def test_a_preamble_of_many_items_and_a_passage_of_many_texts(spark):
    preamble = "which of the following answers is the right one"
    items = spark.createDataFrame([(i, f"{preamble} " + " ".join(f"i{i}w{j}" for j in range(20))) for i in range(2000)], "item_id long, text string")
    docs = [(i, f"start {preamble} " + " ".join(f"d{i}w{j}" for j in range(300))) for i in range(200)]
    docs += [(1000 + i, "x " + " ".join(f"i7w{j}" for j in range(20))) for i in range(300)]
    got = op.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1000 + i, 7) for i in range(300)}
