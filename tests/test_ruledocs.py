import copy
import json

from pyspark.sql import functions as F

from tidemark.plans import ruledocs, scoring

W = {"korean": 0.3, "math": 0.4, "inquiry": 0.3}
FORMULA = {
    "totalScale": 1000, "weights": W, "subjectScoreTypes": {"korean": "percentile"}, "scoreMaxes": {"math": 150}, "subjectBaseScores": {"korean": 0},
    "selectionPolicy": {"mode": "best_n_subjects", "count": 2, "subjects": ["korean", "math", "english"], "requiredSubjects": ["math"], "rankWeights": [6, 4], "groups": [{"count": 1, "subjects": ["inquiry"], "rankWeights": [1]}]},
    "subjectAdjustments": [{"subject": "math", "requiredSelections": ["미적분"], "multiplier": 1.1}, {"subject": "inquiry", "requiredInquiryCategory": "science", "requiredInquiryCategoryCount": 2, "points": 3}],
    "finalAdjustments": [{"subject": "math", "pointsFrom": "percentile", "multiplier": 0.1, "maxPoints": 5}], "requiredInputs": [{"kind": "other", "label": "x"}], "externalComponents": [{"kind": "essay", "weight": 10}],
    "alternatives": [{"weights": W, "totalScale": 500, "englishPolicy": {"mode": "addition", "byGrade": {"1": 5}}}], "note": {"anything": [None]},
}
GOOD = {"formula": FORMULA, "english": {"mode": "ratio", "weight": 20, "scoreMax": 100, "byGrade": {"1": 100, "2": 95.5}}, "history": {"byGrade": {}}, "inquiry": {"count": 2, "mode": "sum", "conversionTable": {"from": "percentile", "byPercentile": {"100": 70, "0": 1}}, "conversionRisk": True}, "eligibility": {"requiredMathSelections": ["미적분"], "maxHistoryGrade": 4}}
#: (document, path, value or "-" to leave out): each alone makes its document not fit.
BAD = [
    ("formula", "totalScale", "1000"), ("formula", "totalScale", 0), ("formula", "totalScale", None), ("formula", "totalScale", "-"), ("formula", "totalScale", True), ("formula", "weights.math", "-"), ("formula", "weights.math", -0.1), ("formula", "weights", [1]),
    ("formula", "csatWeight", None), ("formula", "calculationMode", "median"), ("formula", "subjectScoreTypes.korean", "raw"), ("formula", "scoreMaxes.math", 0), ("formula", "subjectBaseScores.korean", -1),
    ("formula", "selectionPolicy.mode", "all"), ("formula", "selectionPolicy.count", 5), ("formula", "selectionPolicy.count", 3), ("formula", "selectionPolicy.subjects", []), ("formula", "selectionPolicy.requiredSubjects", ["inquiry"]), ("formula", "selectionPolicy.requiredSubjects", ["math", "korean", "english"]),
    ("formula", "selectionPolicy.rankWeights", [6, 0]), ("formula", "selectionPolicy.groups", []), ("formula", "selectionPolicy.groups.0.rankWeights", [1, 2]), ("formula", "selectionPolicy.groups.0.rankWeights", "-"),
    ("formula", "subjectAdjustments.0.multiplier", "-"), ("formula", "subjectAdjustments.0.requiredSelections", []), ("formula", "subjectAdjustments.0.requiredSelections", [1]), ("formula", "subjectAdjustments.1.requiredInquiryCategory", "-"), ("formula", "subjectAdjustments.0.capAtMax", 1), ("formula", "subjectAdjustments", [{"subject": "math", "points": 1}] * 9),
    ("formula", "finalAdjustments.0.pointsFrom", "raw"), ("formula", "finalAdjustments.0.multiplier", "-"), ("formula", "requiredInputs.0.label", ""), ("formula", "externalComponents.0.weight", "-"), ("formula", "alternatives", []), ("formula", "alternatives.0.weights", "-"), ("formula", "alternatives.0.englishPolicy.byGrade", {"12": 1}), ("formula", "alternatives.0.totalScale", None),
    ("english", "weight", "-"), ("english", "weight", 0), ("english", "byGrade.1", "5"), ("english", "byGrade", {"x": 1}), ("english", "byGrade", [1]), ("english", "mode", "-"), ("history", "byGrade", "-"), ("history", "mode", "ratio"),
    ("inquiry", "count", 3), ("inquiry", "count", 1.5), ("inquiry", "mode", "best"), ("inquiry", "conversionTable.byPercentile", {}), ("inquiry", "conversionTable.byPercentile", {"101": 1}), ("inquiry", "conversionTable.from", "raw"), ("inquiry", "conversionRisk", "yes"),
    ("eligibility", "maxHistoryGrade", 4.5), ("eligibility", "maxHistoryGrade", 10), ("eligibility", "requiredInquiryCategory", "art"), ("eligibility", "requiredMathSelections", None),
]


def changed(document, path, value):
    out = copy.deepcopy(GOOD[document])
    *way, last = path.split(".")
    at = out
    for step in way:
        at = at[int(step) if step.isdigit() and isinstance(at, list) else step]
    if value == "-":
        del at[last]
    else:
        at[last] = value
    return {**GOOD, document: out}


def mapped(spark, rows):
    """rows: (score type, status, {document: text or None})."""
    df = spark.createDataFrame([(i, t, s, *(d[n] for n in GOOD)) for i, (t, s, d) in enumerate(rows)], "i int, score_type string, verified_status string, " + ", ".join(f"{n} string" for n in GOOD))
    return {r.i: r for r in ruledocs.mapped(df, {n: n for n in GOOD}).collect()}


def texts(documents):
    return {n: json.dumps(d, ensure_ascii=False) for n, d in documents.items()}


def test_each_fault_makes_its_document_not_fit(spark):
    got = mapped(spark, [("standard", "verified", texts(changed(*case))) for case in BAD])
    for i, (document, path, value) in enumerate(BAD):
        fits = {n: got[i][f"{n}_fits"] for n in GOOD}
        assert fits == {n: n != document for n in GOOD} and got[i].rule is None, (document, path, value)


def test_fitting_documents_become_the_rule(spark):
    good = texts(GOOD)
    rows = [("standard", "live", good), ("other", "live", good), ("mixed", "unknown", good), ("custom", "draft", {**good, "eligibility": None}), ("standard", "live", {**good, "history": None}), ("standard", "live", {**good, "english": good["english"][:-1]}), ("standard", "live", {**good, "inquiry": "null"})]
    got = mapped(spark, rows)
    assert [got[i].rule is not None for i in range(len(rows))] == [True, False, False, True, False, False, False]
    rule = got[0].rule.asDict(recursive=True)
    assert (rule["score_type"], rule["verified_status"], rule["total_scale"], rule["weights"]) == ("standard", "live", 1000.0, W)
    assert rule["subject_score_maxes"] == {"korean": None, "math": 150.0, "inquiry": None} and rule["required_inputs"] == ["other"] and rule["external_components"] == ["essay"]
    assert rule["selection_policy"]["rank_weights"] == [6.0, 4.0] and rule["selection_policy"]["groups"][0]["subjects"] == ["inquiry"]
    assert rule["subject_adjustments"][1] == {"subject": "inquiry", "required_selections": None, "required_category": "science", "required_category_count": 2, "multiplier": None, "points": 3.0, "cap_at_max": None}
    assert rule["final_adjustments"][0]["points_from"] == "percentile" and rule["final_adjustments"][0]["max_points"] == 5.0
    assert rule["english_policy"] == {"mode": "ratio", "by_grade": {1: 100.0, 2: 95.5}, "weight": 20.0, "score_max": 100.0}
    assert rule["inquiry_policy"] == {"count": 2, "mode": "sum", "conversion_risk": True, "table_from": "percentile", "table_max": None, "table": {100: 70.0, 0: 1.0}}
    assert rule["alternatives"][0]["total_scale"] == 500.0 and rule["alternatives"][0]["english_policy"]["by_grade"] == {1: 5.0} and rule["eligibility"] == {"required_math_selections": ["미적분"], "required_category": None, "max_history_grade": 4}
    assert got[3].rule.eligibility.max_history_grade is None


def test_a_mapped_rule_scores_as_the_plain_one(spark):
    documents = {"formula": {"totalScale": 1000, "weights": W}, "english": {"mode": "deduction", "byGrade": {"1": 0, "2": 2}}, "history": {"byGrade": {"3": 0}}, "inquiry": {"count": 2, "mode": "average"}, "eligibility": {}}
    scores = [("korean", None, 131.0, 93.0, None), ("math", "미적분", 135.0, 96.0, None), ("english", None, None, None, 2), ("history", None, None, None, 3), ("inquiry1", "물리학Ⅰ", 67.0, 94.0, None), ("inquiry2", "지구과학Ⅰ", 65.0, 90.0, None)]
    people = scoring.subjects_of(spark.createDataFrame([(0, *s) for s in scores], "exam_id int, subject string, selection string, standard double, percentile double, grade int"))
    rules = spark.createDataFrame([(0, "standard", "verified", *(json.dumps(documents[n]) for n in GOOD))], "exam_id int, score_type string, verified_status string, " + ", ".join(f"{n} string" for n in GOOD))
    rows = people.join(ruledocs.mapped(rules, {n: n for n in GOOD}), "exam_id").select(scoring.converted(F.col("rule"), F.col("subjects")).alias("c")).collect()
    assert rows[0].c.score == 563.5 and rows[0].c.method == "exact"
