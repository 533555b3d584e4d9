import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.operators import clusters, matrix


def test_matrix_equals_plain_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, 9, None]), rng.choice([2020, 2021, 2022, None]), rng.choice("xyz"), rng.randint(0, 9)) for _ in range(400)]
    spans = [(rng.choice([1, 2, 3]), [rng.choice([2019, 2020, 2021]) for _ in range(rng.randint(0, 3))]) for _ in range(50)]
    a = spark.createDataFrame(rows, "e int, y int, m string, v int").repartition(3)
    b = spark.createDataFrame(spans, "e int, ys array<int>")
    cells = spark.createDataFrame([(e, y, e * 10) for e in (1, 2, 4) for y in (2020, 2021)], "entity int, year int, extra int")
    sources = [
        matrix.Source(a, F.col("e"), F.col("y"), {"rows": None, "high": F.col("v") > 6}, {"marks": (F.col("m"), ("z", "x", "y"))}, {"top": (-F.col("v"), F.col("m"))}),
        matrix.Source(b, F.col("e"), F.col("ys"), {"spans": None, "rows": F.col("e") == 2}),
    ]
    df = matrix.matrix(cells, "entity", "year", sources)
    got = {(r.entity, r.year): r.asDict() for r in df.collect()}
    assert set(got) == {(e, y) for e in (1, 2, 4) for y in (2020, 2021)}
    for (e, y), r in got.items():
        own = [x for x in rows if x[0] == e and x[1] == y]
        held = [s for s in spans if s[0] == e and y in s[1]]
        marks = Counter(x[2] for x in own)
        assert (r["extra"], r["rows"], r["high"], r["spans"]) == (e * 10, len(own) + (len(held) if e == 2 else 0), sum(x[3] > 6 for x in own), len(held))
        assert r["marks"] == sorted(marks, key=lambda m: (-marks[m], "zxy".index(m))) and r["top"] == min(((-x[3], x[2]) for x in own), default=(0, None))[1]
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_filled_cells(spark):
    cells = spark.createDataFrame([(1, 2020, 0), (1, 2021, 0), (2, 2021, 3)], "e int, y int, n int")
    got = {(r.e, r.y): (r.n, r.added) for r in matrix.filled(cells, "y", "n", spark.createDataFrame([(2021,), (2021,)], "y int"), "added").collect()}
    assert got == {(1, 2020): (0, 0), (1, 2021): (1, 1), (2, 2021): (3, 0)}


def brute_lists(rows):
    """rows: (key, ordinal, name, tags, place) -> {key: (first 3 names, 2 most frequent tags, 2 names by place)}."""
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]].append(r)
    done = {}
    for key, own in out.items():
        names = list(dict.fromkeys(r[2] for r in own if r[2] and r[2].strip()))
        tags = Counter(t for r in own for t in r[3] or [] if t and t.strip())
        place = {n: min((r[4], r[1]) for r in own if r[2] == n) for n in names}
        done[key] = (names[:3], len(names), [(t, n) for t, n in tags.most_common(2)], len(tags), sorted(names, key=lambda n: place[n])[:2])
    return done


def test_limited_lists_equal_plain_python(spark):
    rng = random.Random(2)
    rows = [(rng.choice("AB"), i, rng.choice([None, "", " ", *"pqrstu"]), [rng.choice(["", *"uvwx"]) for _ in range(rng.randint(0, 3))], str(rng.randint(10, 99))) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, o int, name string, tags array<string>, place string").repartition(4)
    lists = {"names": clusters.Limited(F.col("name"), 3), "tags_often": clusters.Limited(F.col("tags"), 2, "often"), "placed": clusters.Limited(F.col("name"), 2, F.col("place"))}
    got = {r.key: ([x.value for x in r.names], r.names_size, [(x.value, x.n) for x in r.tags_often], r.tags_often_size, [x.value for x in r.placed]) for r in clusters.limited_lists(df, ["key"], lists, F.col("o")).collect()}
    want = brute_lists(rows)
    # Counter.most_common keeps the order of first occurrence on ties, as the operator does
    assert got == want


def test_clustered_counts_are_not_multiplied_and_units_without_outcomes_stay(spark):
    units = spark.createDataFrame([("k", 1, "a", 0), ("k", 2, "b", 1), ("k", 2, "b", 2), ("z", 3, "c", 3)], "key string, unit int, name string, o int")
    outcomes = spark.createDataFrame([(1, 5, "u"), (2, 7, "v"), (2, 8, "u"), (99, 1, "x")], "unit int, m int, url string")
    got = {r.key: r for r in clusters.clustered(units, outcomes, ["key"], "unit", {"rows": F.lit(1)}, {"names": clusters.Limited(F.col("name"), 5)}, {"n": F.lit(1), "m": F.col("m")}, {"urls": clusters.Limited(F.col("url"), 1)}, ordinal="o", outcome_ordinal=F.col("m")).collect()}
    assert (got["k"].rows, got["k"].n, got["k"].m, [x.value for x in got["k"].urls], got["k"].urls_size) == (3, 5, 35, ["u"], 2)
    assert (got["z"].rows, got["z"].n, got["z"].urls) == (1, 0, None)


def test_the_last_cluster_that_lists_a_unit_has_it(spark):
    found = spark.createDataFrame([("c1", [1, 2], 1), ("c2", [2, 3], 2)], "cluster string, ids array<int>, o int")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "unit int, v string")
    assert {(r.unit, r.v, r.cluster) for r in clusters.assigned(found, "ids", "cluster", ["o"], rows, "unit").collect()} == {(1, "a", "c1"), (2, "b", "c2")}
