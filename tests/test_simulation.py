from pyspark.sql import functions as F

from tests.test_scoring import PERCENTILE, SCORES, STANDARD
from tidemark.plans import scoring as sc
from tidemark.plans import simulation as sim

PEOPLE = [(1, SCORES), (2, [(s, sel, st and st - 9, p and p - 12, g and g + 1) for s, sel, st, p, g in SCORES]), (3, SCORES[:2] + SCORES[3:]), (4, SCORES)]
CHANGES = {
    1: {"korean": {"standard_delta": -20.0, "percentile_delta": -9.0}, "english": {"grade_delta": 3}, "math": {"standard_delta": 8.0, "percentile": 99.0}},
    2: {"inquiry1": {"percentile_delta": 10.0, "standard_delta": 6.0}, "english": {"grade": 1}, "math": {"standard_delta": 10.0}, "korean": {"standard_delta": 10.0}},
    3: {"english": {"grade": 2}},
    4: {},
}


def candidates(spark):
    rows = [(i, *s) for i, scores in PEOPLE for s in scores]
    people = sc.subjects_of(spark.createDataFrame(rows, "exam_id int, subject string, selection string, standard double, percentile double, grade int"))
    changes = spark.createDataFrame(list(CHANGES.items()), f"exam_id int, changes map<string,{sim.CHANGE}>")
    units = [(u, {**(STANDARD if u % 2 else PERCENTILE), "verified_status": "draft" if u == 5 else "verified", "inquiry_policy": {"count": 2, "mode": "average", "conversion_risk": u == 4}}, (cut, cut / 10 + 30, 3), 20, 20) for u, cut in enumerate((55.0, 565.0, 93.4, 570.0, 92.0, 620.0, 91.0, 555.0))]
    rules = spark.createDataFrame([(u, r, (c / (10 if u % 2 == 0 and c > 100 else 1), p, a), q, v) for u, r, (c, p, a), q, v in units], f"unit int, rule {sc.RULE}, history struct<cut_score:double,percentile_cut:double,additional_pass:int>, quota int, prev_quota int")
    return people.join(changes, "exam_id").crossJoin(rules).withColumn("exam_type", F.lit("csat"))


def bands(df, changes):
    """The bands and warnings of one plain run after some of the changes."""
    moved = df.withColumn("subjects", sc.simulated(F.col("subjects"), changes))
    return {(r.exam_id, r.unit): r for r in sc.analyzed(moved).select("exam_id", "unit", "band", "warnings", "subjects").collect()}


def test_results_equal_a_run_for_each_scenario(spark):
    df = candidates(spark).cache()
    got = {r.exam_id: r for r in sim.results(sim.compared(df, ["exam_id"], "unit", target=F.col("unit") % 3 == 0), ["exam_id"]).collect()}
    none = bands(df, F.map_filter("changes", lambda k, v: F.lit(False)))
    full = bands(df, F.col("changes"))
    only = lambda s: F.map_filter("changes", lambda k, v: k == s)
    alone = {s: bands(df, only(s)) for s in sc.SUBJECTS}
    place = lambda b: sc.BANDS.index(b) if b else 99
    assert set(got) == set(CHANGES)
    for i, changes in CHANGES.items():
        keys = [k for k in none if k[0] == i]
        r = got[i]
        for name, run in (("baseline", none), ("simulated", full)):
            assert {b: sum(run[k].band == b for k in keys) for b in sc.BANDS} == {b: r[f"{name}_{b}"] for b in sc.BANDS}
        assert r.changed == sum(none[k].band != full[k].band for k in keys)
        assert r.moved_to_match_or_better == sum(place(full[k].band) <= 1 < place(none[k].band) for k in keys)
        up = {s: sum(place(alone[s][k].band) < place(none[k].band) for k in keys) for s in sc.SUBJECTS if s in changes}
        best = max(up, key=lambda s: (up[s], -sc.SUBJECTS.index(s)), default=None)
        assert r.most_efficient_subject == best and r.units_improved == (up[best] if len(up) > 1 else None)
        weak = {s for k in keys for c, names in sim.WEAKNESS.items() if c in (full[k].warnings or []) for s in names if s in full[k].subjects}
        assert r.caution_subjects == "|".join(s for s in sc.SUBJECTS if s in weak)
        for name, run in (("approach_before", none), ("approach_after", full)):
            own = [place(run[k].band) for k in keys if k[1] % 3 == 0 and run[k].band] or [place(run[k].band) for k in keys if run[k].band]
            assert r[name] == (sc.BANDS[min(own)] if own else "limited")
    assert got[1].changed > 0 and got[4].changed == 0 and got[4].most_efficient_subject is None and any(r.caution_subjects for r in got.values())


def test_one_engine_run_and_no_join_of_runs(spark):
    plan = sim.results(sim.compared(candidates(spark), ["exam_id"], "unit"), ["exam_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FullOuter") == 0 and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3


def test_units_of_one_rule_share_its_run(spark):
    """Each different rule meets an examinee once, and results equal those of a row a unit."""
    plain = candidates(spark).filter("exam_id < 4").withColumn("unit", F.explode(F.array("unit", F.col("unit") + 8))).cache()
    # rules without any field and missing ones differ too
    plain = plain.withColumn("rule", F.when(F.col("unit") != 9, F.when(F.col("unit") == 11, sc.rule_struct()).otherwise(F.col("rule"))))
    units = plain.filter("exam_id = 1").select("unit", "rule", "history", "quota", "prev_quota")
    people = plain.filter("unit = 0").select("exam_id", "subjects", "changes", "exam_type")
    lists = sc.by_rule(plain.select("exam_id", "unit"), units, "exam_id", "unit").join(people, "exam_id")
    kinds = units.select(F.to_json("rule").alias("j")).distinct().count()
    sizes = lists.select("exam_id", F.size("units").alias("n")).collect()
    assert kinds < 16 and len(sizes) == 3 * kinds and sum(r.n for r in sizes) == 3 * 16
    columns = ["exam_id", "unit", "kind", "converted_score", "reference_score", "score_gap", "band", "confidence", "reason_codes", "warnings"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert rows(sc.analyzed(lists)) == rows(sc.analyzed(plain)) and len(rows(sc.analyzed(lists))) == 48
    pairs = lambda df: sorted((tuple(r) for r in sim.compared(df, ["exam_id"], "unit", target=F.col("unit") % 3 == 0).collect()), key=repr)
    assert pairs(lists) == pairs(plain) and len({r[3] for r in pairs(lists)}) > 2


def test_people_of_equal_scores_and_changes_share_a_row(spark, monkeypatch):
    monkeypatch.setattr(sc, "ALIKE", 3)
    value = "struct<standard:double,percentile:double,grade:int>"
    people = [(None, {"math": (1.0, None, 2)}, {}), *((i, dict(sorted({"math": (1.0, None, i % 2), "korean": (None, 3.0, 1)}.items(), reverse=i % 3 == 0)), {"math": (1.0, None, 1)} if i % 5 == 0 else {}) for i in range(40)), (90, None, {}), (91, None, {}), (92, {}, None)]
    df = spark.createDataFrame(people, f"id int, subjects map<string,{value}>, changes map<string,{value}>")
    like = {r.id: r.like for r in sc.alike(df, "id", ["subjects", "changes"]).collect()}
    told = {i: (s, c) for i, s, c in people}
    assert set(like) == set(told) and all(told[i] == told[j] for i, j in like.items())
    sizes = {j: sum(x == j for x in like.values()) for j in like.values()}
    # 16, 16, 4 and 4 equal ones by threes, the two without subjects, and two alone
    assert sorted(sizes.values()) == sorted([3, 3, 3, 3, 3, 1] * 2 + [3, 1] * 2 + [2, 1, 1])


def test_bands_are_not_made_inside_a_lambda(spark):
    plan = sim.compared(candidates(spark), ["exam_id"], "unit")._jdf.queryExecution().optimizedPlan()
    top = plan.expressions().mkString(" ")
    # the topmost select reads the bands of each scenario as columns
    assert "_band_korean" in top and "_gap_korean" not in top and "_run_korean" not in top
