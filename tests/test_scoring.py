import pytest
from pyspark.sql import functions as F

from tidemark.plans import scoring as sc

SCORES = [("korean", None, 131.0, 93.0, None), ("math", "미적분", 135.0, 96.0, None), ("english", None, None, None, 2), ("history", None, None, None, 3), ("inquiry1", "물리학Ⅰ", 67.0, 94.0, None), ("inquiry2", "지구과학Ⅰ", 65.0, 90.0, None)]
W = {"korean": 0.3, "math": 0.4, "inquiry": 0.3}
STANDARD = {
    "score_type": "standard", "verified_status": "verified", "total_scale": 1000.0, "weights": W, "eligibility": {},
    "english_policy": {"mode": "deduction", "by_grade": {1: 0.0, 2: 2.0, 3: 6.0, 4: 12.0, 5: 20.0}},
    "history_policy": {"by_grade": {1: 0.0, 2: 0.0, 3: 0.0, 4: 2.0, 5: 4.0}},
    "inquiry_policy": {"count": 2, "mode": "average"},
}
PERCENTILE = {**STANDARD, "score_type": "percentile", "total_scale": 100.0, "english_policy": {"mode": "deduction", "by_grade": {1: 0.0, 2: 0.5, 3: 1.5, 4: 3.0}}, "history_policy": {"by_grade": {1: 0.0, 2: 0.0, 3: 0.2, 4: 0.5}}}
RATIO = {**STANDARD, "score_type": "percentile", "weights": {"korean": 30.0, "math": 30.0, "inquiry": 20.0}, "english_policy": {"mode": "ratio", "weight": 20.0, "score_max": 100.0, "by_grade": {1: 100.0, 2: 95.0, 3: 88.0, 4: 80.0}}, "history_policy": {"by_grade": {1: 0.0, 2: 0.0, 3: 0.0}}}
BEST_ONE = {**STANDARD, "inquiry_policy": {"count": 1, "mode": "best_one"}}


def change(rows, **grades):
    return [(s, sel, st, p, grades.get(s, g)) for s, sel, st, p, g in rows]


def convert(spark, cases):
    """[(scores, rule)] -> [(score, scale, method)]."""
    long = [(i, *row) for i, (scores, _) in enumerate(cases) for row in scores]
    people = sc.subjects_of(spark.createDataFrame(long, "exam_id int, subject string, selection string, standard double, percentile double, grade int"))
    rules = spark.createDataFrame([(i, rule) for i, (_, rule) in enumerate(cases)], f"exam_id int, rule {sc.RULE}")
    got = people.join(rules, "exam_id").select("exam_id", sc.converted(F.col("rule"), F.col("subjects")).alias("c")).collect()
    return {r.exam_id: (r.c.score, r.c.scale, r.c.method, r.c.stand_in) for r in got}


GOLDEN = [
    (SCORES, STANDARD, (563.5, 1000.0, "exact")),
    (SCORES, PERCENTILE, (93.2, 100.0, "exact")),
    (change(SCORES, english=1), STANDARD, (565.5, 1000.0, "exact")),
    (change(SCORES, history=4), STANDARD, (561.5, 1000.0, "exact")),
    (SCORES, BEST_ONE, (565.0, 1000.0, "exact")),
    (SCORES, {**STANDARD, "score_type": "mixed"}, (740.5, 1000.0, "exact")),
    (SCORES, RATIO, (941.0, 1000.0, "exact")),
    (change(SCORES, english=1), RATIO, (951.0, 1000.0, "exact")),
    (SCORES, {**RATIO, "verified_status": "draft"}, (94.1, 100.0, "approx")),
    (SCORES, {**STANDARD, "verified_status": "draft"}, (93.9, 100.0, "approx")),
    (SCORES, {**STANDARD, "required_inputs": ["national maximum"]}, (93.9, 100.0, "relative")),
    (SCORES, {**STANDARD, "external_components": ["interview"]}, (93.9, 100.0, "relative")),
    (SCORES, {**STANDARD, "score_type": "custom"}, (None, None, "unsupported")),
    (SCORES[1:], STANDARD, (None, None, "unsupported")),
    # 131 * 1 + 135 * 1 + 66 * 0 - 2 = 264 against 131 * .5 + 135 * 1.5 = 268 - 2 of the same scale
    (SCORES, {**STANDARD, "alternatives": [{"calculation_mode": "weighted_sum", "weights": {"korean": 1.0, "math": 1.0, "inquiry": 0.0}}, {"calculation_mode": "weighted_sum", "weights": {"korean": 0.5, "math": 1.5, "inquiry": 0.0}}]}, (266.0, 1000.0, "exact")),
    # bases 10 + 131 / 200 * 100, no others
    (SCORES, {**STANDARD, "calculation_mode": "normalized_sum", "weights": {"korean": 100.0, "math": 0.0, "inquiry": 0.0}, "subject_base_scores": {"korean": 10.0}}, (73.5, 1000.0, "exact")),
    # the two best of three percentiles: 96 and 93 at 60 and 40
    (SCORES, {**PERCENTILE, "total_scale": 1000.0, "selection_policy": {"count": 2, "subjects": ["korean", "math", "inquiry"], "rank_weights": [60.0, 40.0]}}, (947.8, 1000.0, "exact")),
    # inquiry must be in: 96 and 92, mean 94
    (SCORES, {**PERCENTILE, "selection_policy": {"count": 2, "subjects": ["korean", "math", "inquiry"], "required_subjects": ["inquiry"]}}, (93.8, 100.0, "exact")),
    # table: 68 and 66 of 70; adjustment: math plus 10 % for this selection, capped
    (SCORES, {**STANDARD, "inquiry_policy": {"count": 2, "mode": "sum", "table_from": "percentile", "table_max": 70.0, "table": {94: 68.0, 90: 66.0}}, "weights": {"korean": 0.0, "math": 0.0, "inquiry": 1.0}}, (955.14, 1000.0, "exact")),
    (SCORES, {**STANDARD, "inquiry_policy": {"count": 2, "mode": "sum", "table_from": "percentile", "table": {94: 68.0}}}, (None, None, "unsupported")),
    (SCORES, {**STANDARD, "weights": {"korean": 0.0, "math": 1.0, "inquiry": 0.0}, "subject_adjustments": [{"subject": "math", "required_selections": ["미적분"], "multiplier": 2.0, "cap_at_max": True}]}, (998.0, 1000.0, "exact")),
    (SCORES, {**STANDARD, "final_adjustments": [{"subject": "math", "points_from": "standardScore", "multiplier": 0.1, "max_points": 10.0}, {"subject": "inquiry", "points_from": "percentile", "multiplier": 0.01, "required_category": "science", "required_category_count": 2}]}, (575.34, 1000.0, "exact")),
]


def test_golden_conversions(spark):
    got = convert(spark, [(s, r) for s, r, _ in GOLDEN])
    assert {i: got[i][:3] for i in got} == {i: w for i, (_, _, w) in enumerate(GOLDEN)}
    assert got[5][3] and not got[0][3]


def test_pipeline_of_candidates(spark):
    people = sc.subjects_of(spark.createDataFrame([(1, *r) for r in SCORES], "exam_id int, subject string, selection string, standard double, percentile double, grade int"))
    past = (560.0, 92.0, 12)
    units = [
        ("u-ok", STANDARD, past), ("u-no-rule", None, past), ("u-ineligible", {**STANDARD, "eligibility": {"required_math_selections": ["확률과 통계"]}}, past),
        ("u-no-historical", STANDARD, None), ("u-approx", {**STANDARD, "verified_status": "draft"}, past), ("u-required", {**STANDARD, "required_inputs": ["x"]}, past),
    ]
    df = spark.createDataFrame([(1, u, r, h, 30, None, "june_mock") for u, r, h in units], f"exam_id int, unit_id string, rule {sc.RULE}, history struct<cut_score:double,percentile_cut:double,additional_pass:int>, quota int, prev_quota int, exam_type string")
    got = {r.unit_id: r for r in sc.analyzed(df.join(people, "exam_id")).collect()}
    assert {u: r.kind for u, r in got.items()} == {"u-ok": "ok", "u-no-rule": "unsupported", "u-ineligible": "ineligible", "u-no-historical": "insufficientData", "u-approx": "ok", "u-required": "ok"}
    ok = got["u-ok"]
    assert (ok.score_gap, ok.band, ok.confidence, ok.converted_score) == (3.5, "match", "high", 563.5)
    assert "standard_score_fit" in ok.reason_codes and got["u-approx"].confidence == "low" and got["u-approx"].band == "match"
    assert "low_data_confidence" in got["u-required"].warnings


@pytest.mark.parametrize(("gap", "want"), [(20, "stable"), (5, "match"), (-8, "reach"), (-25, "challenge"), (-40, "risk")])
def test_bands(spark, gap, want):
    row = spark.range(1).select(sc.band(F.lit(float(gap)), F.lit(1000.0), F.lit(0.0), F.lit("high")).alias("b"), sc.band(F.lit(float(gap)), F.lit(1000.0), F.lit(0.0), F.lit("low")).alias("l")).first()
    assert row.b == want and row.l == ("match" if want == "stable" else want)


def test_simulation_signals_and_plans(spark):
    people = sc.subjects_of(spark.createDataFrame([(1, "math", None, 135.0, 95.0, 2), (1, "english", None, None, None, 2)], "exam_id int, subject string, selection string, standard double, percentile double, grade int"))
    kind = "map<string,struct<standard:double,percentile:double,grade:int,standard_delta:double,percentile_delta:double,grade_delta:double>>"
    changes = spark.createDataFrame([(1, {"math": (None, None, None, 100.0, 1.0, None), "english": (None, None, None, None, None, -3.0)})], f"exam_id int, changes {kind}")
    s = people.join(changes, "exam_id").select(sc.simulated(F.col("subjects"), F.col("changes")).alias("s")).first().s
    assert (s["math"].standard, s["math"].percentile, s["math"].grade, s["english"].grade) == (200.0, 96.0, 1, 1)
    data = [("kansu", "7칸"), ("kansu", "x"), ("colour", " Red "), ("probability", "64.9%"), ("probability", "85"), ("memo", "1")]
    got = [r.b for r in spark.createDataFrame(data, "p string, v string").select(sc.signal_band(F.col("p"), F.col("v")).alias("b")).collect()]
    assert got == ["stable", None, "stable", "reach", "stable", None]
    results = spark.createDataFrame([(1, "ga", "a", "match", 1.0), (1, "ga", "b", "stable", 2.0), (1, "na", "c", "risk", 3.0), (1, "na", "d", "risk", 3.0), (1, "none", "e", "match", 9.0)], "plan_id int, recruitment_group string, unit_id string, band string, score_gap double")
    picks = sc.application_plan(results, "balanced")
    assert sorted(tuple(r)[1:] for r in picks.collect()) == [("ga", "a", "match", 1.0, "match", False), ("na", "c", "risk", 3.0, "match", True)]
    assert tuple(sc.plan_risk(picks).first()) == (1, "high", "na", "ga")
