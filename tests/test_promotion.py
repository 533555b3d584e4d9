from tidemark.plans import promotion as p

SCHEMA = "artifact string, entity string, year int, strength string, confidence string, candidate_confidence string, flags array<string>, quality array<string>, year_status string, area_flag string, match_status string, has_score boolean, has_quota boolean, recent_count int, review_score int"
N = None
CASES = [
    (("universities", N, N, N, N, N, N, N, N, N, N, N, N, N, N), "p0", [], 80),
    (("units", N, 2020, N, N, N, N, N, N, N, "ambiguous", N, N, N, N), "p2", ["unmatched_or_ambiguous_university"], 40),
    (("outcomes", N, 2024, N, "low", N, ["review_required_scale", "fine", "review_required_scale"], ["title_like"], N, "area", N, True, True, N, N), "p0", ["area", "review_required_scale", "title_like", "low_confidence"], 80 + 10 + 20),
    (("csat_rule_drafts", N, 2027, "high", "medium", N, [], [], "unknown", "", N, N, N, N, N), "p2", ["unknown_admission_year"], 40 + 10 + 20 + 8),
    (("csat_rule_drafts", N, 2019, "medium", N, "limited", [], [], N, N, N, N, N, N, N), "p1", ["limited_candidate_confidence"], 60 + 10),
    (("unit_clusters", N, N, N, N, N, ["missing_recent"], N, N, N, N, N, N, 5, N), "p0", ["missing_recent"], 80),
    (("outcome_series", N, N, N, N, N, ["converted_score_scale_review_required"], N, N, N, N, N, N, 7, 12), "p1", ["converted_score_scale_review_required"], 12),
    (("policy_evidence", "GradeCutReference", 2021, N, N, N, N, N, N, N, N, N, N, N, N), "p0", [], 90),
    (("else", N, N, N, "", "high", N, N, N, N, N, N, N, N, N), "p1", [], 60),
]


def test_tiers_blockers_and_scores(spark):
    df = spark.createDataFrame([(i, *row) for i, (row, *_) in enumerate(CASES)], f"i int, {SCHEMA}")
    got = {r.i: (r.tier, r.blockers, r.score) for r in p.queue(df).collect()}
    assert got == {i: tuple(want) for i, (_, *want) in enumerate(CASES)}
