import random
import re

from pyspark.sql import functions as F

from tidemark.operators import containment as op


def test_contained_equals_a_nested_loop(spark):
    rng = random.Random(3)
    letters = "abcé\n한"
    texts = [(i, "".join(rng.choices(letters, k=rng.choice((0, 1, 2, 5, 40, 300))))) for i in range(120)] + [(500, None), (501, "ab" * 5000)]
    needles = ["".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(150)] + [t[3:14] for _, t in texts[:60] if t] + [None, "", "(.)", "zz", "ab"]
    got = op.contained(spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame([(n,) for n in needles], "needle string"), key="id").collect()
    want = {(i, n) for i, t in texts if t for n in set(needles) if n and n in t}
    assert len(got) == len(want) > 100 and {(r.id, r.needle) for r in got} == want


def test_empty_sides(spark):
    texts, needles = spark.createDataFrame([(1, "abc")], "id int, text string"), spark.createDataFrame([("b",)], "needle string")
    assert op.contained(texts.limit(0), needles, key="id").count() == 0 and op.contained(texts, needles.limit(0), key="id").count() == 0
    assert [tuple(r) for r in op.contained(texts, needles, key="id").collect()] == [(1, "b")]


def test_no_nested_loop_and_no_cross_join(spark):
    texts, needles = spark.createDataFrame([(1, "abc def")], "id int, text string"), spark.createDataFrame([("c d",)], "needle string")
    plan = op.contained(texts, needles, key="id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


ROWS = ["컴퓨터공학과 가군 30 4.52 1,234.5", "컴퓨터 공학과 나군 30 4.99", "국어교육과 가군 12 3.1", "경영학과 다군 100 7.25", "경영학과 다군 100 7.25", "경영학과 다군 99 7.25", None, ""]
OUTCOMES = [
    (1, "컴퓨터공학과", "가군", 30.0, 4.5), (2, "컴퓨터공학과", "다군", 30.0, 4.5), (3, "없는과", None, 1.0, None), (4, "", None, 1.0, None), (5, None, "가군", 1.0, None), (6, "경영학과", None, None, None), (7, "경영학과", None, 100.0, 7.27), (8, "경영학과", "다군", 50.0, 7.25), (9, "컴퓨터공학과", None, 1234.5, None), (10, "컴퓨터공학과", None, 31.0, 9.0), (11, "교육과", None, 12.0, 3.1),
]


def brute(outcome):
    _, name, group, quota, rate = outcome
    name = re.sub(r"\s+", "", name or "")
    if not name:
        return "missing_unit_name", None, None
    rows = [t for t in ROWS if t and name in re.sub(r"\s+", "", t)]
    if not rows:
        return "unit_not_in_source_row", None, None
    rows = [t for t in rows if not group or group in t]
    if not rows:
        return "group_not_in_source_row", None, None
    needed = [(n, v, e) for n, v, e in (("quota", quota, 0.001), ("rate", rate, 0.03)) if v is not None]
    if not needed:
        return "missing_required_values", None, None
    lacks = ["|".join(n for n, v, e in needed if not any(abs(float(x) - v) <= e for x in re.findall(op.NUMBER, t.replace(",", "")))) for t in rows]
    if "" in lacks:
        return "matched", lacks.count(""), None
    return "source_row_values_missing", None, min(set(lacks), key=lambda x: (-lacks.count(x), x))


def test_verified_equals_plain_python(spark):
    needed = op.required({"quota": (F.col("quota"), 0.001), "rate": (F.col("rate"), F.lit(0.03))})
    outcomes = spark.createDataFrame(OUTCOMES, "id int, name string, group string, quota double, rate double").withColumn("needed", needed)
    rows = spark.createDataFrame([(t,) for t in ROWS], "row_text string")
    got = {r.id: (r.status, r.matched_rows, r.lacking) for r in op.verified(outcomes, rows, key="id").collect()}
    assert got == {o[0]: brute(o) for o in OUTCOMES} and len({v[0] for v in got.values()}) == 6


def test_texts_and_outcomes_of_a_name_never_meet(spark, monkeypatch):
    rng = random.Random(8)
    texts = [f"{name}과 {group} {rng.randint(1, 4)} {rng.randint(1, 4) / 2}{rng.choice(('', ' 7 2.0'))}" for name in ("갑", "을") for group in ("가", "나") for _ in range(20)]
    wanted = [(i, f"{rng.choice('갑을병')}과", rng.choice((None, "가", "다")), rng.choice((None, 1.0, 2.0, 9.0)), rng.choice((None, 0.5, 1.0, 1.5))) for i in range(120)]
    monkeypatch.setattr("tests.test_containment.ROWS", texts)
    needed = op.required({"quota": (F.col("quota"), 0.001), "rate": (F.col("rate"), F.lit(0.03))})
    outcomes = spark.createDataFrame(wanted, "id int, name string, group string, quota double, rate double").withColumn("needed", needed)
    df = op.verified(outcomes, spark.createDataFrame([(t,) for t in texts], "row_text string"), key="id")
    assert {r.id: (r.status, r.matched_rows, r.lacking) for r in df.collect()} == {o[0]: brute(o) for o in wanted}

    def outputs(node):
        yield {node.output().apply(i).name() for i in range(node.output().size())}
        for i in range(node.children().size()):
            yield from outputs(node.children().apply(i))

    assert not any({"_needed", "_numbers"} <= names for names in outputs(df._jdf.queryExecution().analyzed()))


def test_texts_of_few_needles_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choices("ab é한\v", k=rng.choice((3, 30, op.PLACES // 40))))) for i in range(60)] + [(60, "x" * op.PLACES + "needle over the edge")]
    needles = [t[a : a + k] for _, t in texts for a, k in ((0, 1), (1, 2), (2, 9), (5, 20))] + ["needle over", "xneedle ove", "absent"]
    t, n = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in needles], "needle string")
    want = sorted((i, x) for i, t in texts for x in set(needles) if x and x in t)
    df = op.contained(t, n, key="id")
    assert sorted(map(tuple, df.collect())) == want
    nodes, shuffled = [df._jdf.queryExecution().executedPlan().executedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())] + ([node.plan()] if node.nodeName().endswith("QueryStage") else [])
        if node.nodeName() == "Exchange":
            shuffled.append({node.output().apply(i).name() for i in range(node.output().size())})
    assert shuffled and not any("t" in names for names in shuffled) and "regexp_extract_all" not in df._jdf.queryExecution().toString()
    # beyond the size of a broadcast, with a table of bits that has most of them set
    monkeypatch.setattr(op, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(op, "LEAST_BITS", 8)
    monkeypatch.setattr(op, "MOST_BITS", 8)
    assert sorted(map(tuple, op.contained(t, n, key="id").collect())) == want


def test_compact_leaves_out_ascii_white_space_only(spark):
    text = "a \t\n\v\f\rb\x1c\x85\xa0　c  "
    assert spark.createDataFrame([(text,), (None,)], "t string").select(op.compact(F.col("t")).alias("t"), F.regexp_replace("t", r"\s+", "").alias("r")).collect() == [("ab\x1c\x85\xa0　c",) * 2, (None, None)]


def test_requirements_meet_different_numbers_and_not_texts(spark):
    rng = random.Random(13)
    number = lambda: rng.choice((str(rng.randint(0, 60)), f"{rng.randint(0, 9)}.{rng.randint(0, 99):02}", f"-{rng.randint(1, 5)}.5", "1,234.5", "9" * 25))
    texts = [f"{rng.choice('갑을')}과 {rng.choice(('가', '나'))} {number()} {number()} " + rng.choice(("", number())) for _ in range(150)]
    fields = [("a", 0.001), ("b", 0.03), ("c", 2.5), ("d", None)]
    wanted = []
    for i in range(200):
        own = [(f, rng.choice((30.0, 1234.5, 0.0, -2.5, 1e25, rng.randint(0, 60) + rng.choice((0.0, 0.001, 0.03, -0.03, 0.02)))), rng.choice((e, 0.0, 7.0)) if e else 40.0) for f, e in fields if rng.random() < 0.6]
        wanted.append((i, f"{rng.choice('갑을병')}과", rng.choice((None, "가", "다")), own))
    outcomes = spark.createDataFrame(wanted, "id int, name string, group string, needed array<struct<field:string,value:double,tolerance:double>>")
    df = op.verified(outcomes, spark.createDataFrame([(t,) for t in texts], "row_text string"), key="id")
    want = {}
    for i, name, group, own in wanted:
        rows = [t for t in texts if name in t]
        if there := bool(rows):
            rows = [t for t in rows if not group or group in t]
        lacks = [(tuple(f for f, v, e in own if not any(abs(float(x) - v) <= e for x in re.findall(op.NUMBER, t.replace(",", ""))))) for t in rows]
        if not rows:
            want[i] = ("group_not_in_source_row" if there else "unit_not_in_source_row", None, None)
        elif not own:
            want[i] = ("missing_required_values", None, None)
        elif () in lacks:
            want[i] = ("matched", lacks.count(()), None)
        else:
            want[i] = ("source_row_values_missing", None, min({"|".join(x) for x in lacks}, key=lambda x: (-lacks.count(tuple(x.split("|"))), x)))
    assert {r.id: (r.status, r.matched_rows, r.lacking) for r in df.collect()} == want and len({v[0] for v in want.values()}) == 5

    def outputs(node):
        yield {node.output().apply(i).name() for i in range(node.output().size())}
        for i in range(node.children().size()):
            yield from outputs(node.children().apply(i))

    # a name's requirements are held against each different list of numbers once, however many texts have it
    assert not any("_text" in names and names & {"_wanted", "_steps", "_needed"} for names in outputs(df._jdf.queryExecution().analyzed()))
