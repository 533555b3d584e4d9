import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import spelling as op
from tidemark.llm.checksums import crc32s


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.binary(max_size=9), st.binary(min_size=60, max_size=70))), min_size=1, max_size=9))
def test_checksums_go_on_from_what_precedes(rows):
    raw = np.frombuffer(b"".join(w for _, w in rows), dtype=np.uint8)
    ends = np.cumsum([len(w) for _, w in rows])
    starts = ends - [len(w) for _, w in rows]
    got = crc32s(raw, starts, ends, np.array([zlib.crc32(b) for b, _ in rows], dtype=np.uint32))
    assert got.tolist() == [zlib.crc32(b + w) for b, w in rows]


def vocabulary(rng, alphabet, n):
    """Words of which many are one or two edits apart."""
    out = {"".join(rng.choices(alphabet, k=rng.randint(5, 9))) for _ in range(n)}
    for w in sorted(out):
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w = w[:i] + (rng.choice(alphabet) if kind < 2 else "") + w[i + (kind > 0) :]
        if len(w) >= 4:
            out.add(w)
    return sorted(out)


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    for alphabet, n in (("ab", 120), ("abcdeé", 200), ("ab𝄞ÿ", 150)):
        words = vocabulary(rng, alphabet, n)
        rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").repartition(3)
        got = [(r.a, r.b) for r in op.near_pairs(rows).collect()]
        want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) < 2 and brute.distance(a, b) == 1}
        assert len(want) > 20 and len(got) == len(set(map(frozenset, got))) and set(map(frozenset, got)) == want


def test_digest_equals_plain_python(spark):
    rng = random.Random(8)
    words = [w.capitalize() if i % 3 else w for i, w in enumerate(vocabulary(rng, "abé", 60))]
    often = [rng.choice((1, 4, 16, 64)) for _ in words]
    text = lambda: ", ".join(rng.choices(words, often, k=rng.randint(0, 80))) + "×1÷Ā" + rng.choice(words)
    rows = [(i, text(), "x") for i in range(150)] + [(900, None, "x"), (901, "", "x"), (None, text(), "x")]
    rows += [rows[3]] * 4  # repeated rows count
    rows.append((950, "zzzza " * 5 + "Zzzzb " * 12 + "zzzbb " * 30, "x"))  # a chain of two forms
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(4)
    got = sorted(map(tuple, op.digest(docs).collect()))
    want = brute.spelling([r[:2] for r in rows])
    assert got == want and sum(r[1] is not None for r in want) > 10 and any(r[2] != (r[1] or r[0]) for r in want)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.digest(empty).count() == 0 and op.digest(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0
    long = "q" * 20_000
    rows = [(i, f"{long} {long}x {'word ' * 3}") for i in range(3)]
    got = {r.word: r for r in op.groups(op.words(spark.createDataFrame(rows, "doc_id long, text string"), spoilt=0, least_chars=4)).collect()}
    assert {w: (r.n, r.n_near) for w, r in got.items()} == {long: (3, 1), long + "x": (3, 1), "word": (9, 0)}
    try:
        op.words(empty, least_chars=3)
        raise AssertionError("too short words were taken")
    except ValueError:
        pass


def test_roots_follow_whole_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(16)] + [("v", "w9")], "word string, form string")
    assert {r.word: r.root for r in op.roots(links, 4).collect()} == {f"w{i}": "w16" for i in range(16)} | {"v": "w16"}


def test_a_form_is_the_most_frequent_near_word(spark):
    rows = [("aaaaa", 3), ("aaaab", 6), ("aaaac", 6), ("aaaad", 5), ("bbbbb", 3), ("bbbbc", 5)]
    got = {r.word: (r.form, r.form_n, r.n_near, r.root) for r in op.groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["aaaaa"] == ("aaaab", 6, 3, "aaaab") and got["bbbbb"] == (None, None, 1, "bbbbb")
    assert Counter(v[0] for v in got.values()) == {None: 5, "aaaab": 1}
    assert spark.createDataFrame(rows, "word string, n long").filter(F.col("n") > 9).count() == 0
