"""The promotion queue: what blocks a candidate row, how urgent its kind makes it, and its place in the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: tiers, blockers and points of the queue; classes of residual reviews ---
RECENT = (2021, 2027)
DRAFT_BLOCKERS = "noise|low_structured|low_context|review_required|unknown|missing"
QUALITY_BLOCKERS = "noise|low|year_only|title_like|ocr|empty"
WEAK = ("limited", "low")
REFERENCES = ("GradeCutReference", "StandardScoreDistributionReference")
EXAM_REFERENCES = ("ExamScoreReference", "ExamScoreReferenceEvidence")
TIER_POINTS = {"p0": 80, "p1": 60, "p2": 40, "p3": 20}
STRENGTH_POINTS = {"high": 20, "medium": 10}
CONFIDENCE_POINTS = {"high": 16, "medium": 8}
RECENT_POINTS, SCORE_POINTS, QUOTA_POINTS = 10, 10, 10
CLASSES = {
    "rule": "admission_rule_2027_formula_human_review_required",
    "pdf": "office_pdf_outcome_column_reconstruction_required",
    "workbook": "office_workbook_outcome_strict_mismatch",
    "identity": "adiga_admission_unit_identity_only_missing_quota",
    "strict": "admission_unit_source_text_strict_row_mismatch",
    "quota": "admission_unit_source_text_missing_quota",
    "paths": "admission_unit_source_text_missing_source_paths",
    "none": "unclassified_pending_review",
}
# --- end of fixed values ---


def recent(year: Column) -> Column:
    return F.coalesce(year.between(*RECENT), F.lit(False))


def blockers() -> Column:
    """Distinct reasons in their order, from the columns year_status, area_flag, flags, quality, match_status, confidence and candidate_confidence."""
    none = F.array().cast("array<string>")
    weak = lambda c, tail: F.array(F.when(F.col(c).isin(*WEAK), F.concat(c, F.lit(tail))))
    parts = [
        F.array(F.when(F.col("year_status") == "unknown", "unknown_admission_year"), F.nullif("area_flag", F.lit(""))),
        F.filter(F.coalesce("flags", none), lambda f: f.rlike(DRAFT_BLOCKERS)),
        F.filter(F.coalesce("quality", none), lambda f: f.rlike(QUALITY_BLOCKERS)),
        F.array(F.when(F.col("match_status").isin("unmatched_or_ambiguous", "ambiguous"), "unmatched_or_ambiguous_university")),
        weak("confidence", "_confidence"),
        weak("candidate_confidence", "_candidate_confidence"),
    ]
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def tier(found: Column) -> Column:
    """The tier of a row by its artifact; `found` are its blockers. Rules are tried in this order."""
    artifact, entity, now = F.col("artifact"), F.col("entity"), recent(F.col("year"))
    has = lambda f: F.coalesce(F.array_contains("flags", f), F.lit(False))
    strong, weak = F.col("strength").isin("high", "medium"), F.col("strength").isin("low", "limited")
    by = lambda test, yes, no: F.when(F.coalesce(test, F.lit(False)), yes).otherwise(no)
    many, some = F.col("recent_count") >= 5, F.col("recent_count") > 0
    noisy = F.array_contains(found, "unknown_admission_year") | has("has_noise_signals") | has("has_low_context_text")
    drafts = F.when(noisy, by(now, "p2", "p3")).when(strong & now, "p0").when(strong, "p1").when(weak & now, "p2").otherwise("p3")
    scored, quota = F.coalesce("has_score", F.lit(False)), F.coalesce("has_quota", F.lit(False))
    return (
        F.when(artifact == "universities", "p0")
        .when(artifact == "units", by(now, "p0", "p2"))
        .when(artifact == "unit_clusters", F.when(has("full_recent_2021_2027_coverage") | F.coalesce(many, F.lit(False)), "p0").otherwise(by(some, "p1", "p2")))
        .when(artifact == "outcomes", F.when(scored & quota & now, "p0").when(scored & now, "p1").otherwise("p2"))
        .when(artifact == "outcome_series", F.when(has("converted_score_scale_review_required"), "p1").when(F.coalesce(many, F.lit(False)), "p0").otherwise(by(some, "p1", "p2")))
        .when(entity.isin(*REFERENCES), by(now, "p0", "p2"))
        .when(entity.isin(*EXAM_REFERENCES), by(now, "p1", "p2"))
        .when(artifact.endswith("_drafts"), drafts)
        .when(artifact == "office_evidence", by(F.col("review_score") >= 100, "p1", "p2"))
        .when(artifact == "policy_evidence", by(entity.isin("AdmissionRule", "AdmissionSchedule"), "p1", "p2"))
        .when(artifact == "metric_summaries", by(F.col("match_status") == "matched_by_unv_cd", "p1", "p2"))
        .otherwise(by(F.coalesce(F.nullif("confidence", F.lit("")), "candidate_confidence").isin("high", "medium"), "p1", "p2"))
    )


def _points(value: Column, table: dict[str, int], otherwise: int = 0) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def queue(rows: DataFrame) -> DataFrame:
    """rows with blockers, tier and score: the row's own review score, else points of tier, recency, strength, confidence and values."""
    df = rows.withColumn("blockers", blockers()).withColumn("tier", tier(F.col("blockers")))
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = _points(F.col("tier"), TIER_POINTS) + flag(recent(F.col("year")), RECENT_POINTS) + _points(F.col("strength"), STRENGTH_POINTS) + _points(F.col("confidence"), CONFIDENCE_POINTS) + flag(F.col("has_score"), SCORE_POINTS) + flag(F.col("has_quota"), QUOTA_POINTS)
    return df.withColumn("score", F.coalesce("review_score", score))


def residual_class(target: Column, lane: Column, provider: Column, kind: Column, has_quota: Column, has_paths: Column) -> Column:
    """Why a decision is still open, the first reason that holds."""
    unit = target == "AdmissionUnit"
    return (
        F.when((lane == "rule_schedule_2027") | (target == "AdmissionRule"), CLASSES["rule"])
        .when((target == "HistoricalOutcome") & (kind == "pdf_text_manifest"), CLASSES["pdf"])
        .when((target == "HistoricalOutcome") & (kind == "raw_binary"), CLASSES["workbook"])
        .when(unit & (provider == "adiga") & (kind == "raw_text"), F.when(~has_quota, CLASSES["identity"]).otherwise(CLASSES["strict"]))
        .when(unit & (kind == "source_text"), F.when(~has_quota, CLASSES["quota"]).when(~has_paths, CLASSES["paths"]).otherwise(CLASSES["strict"]))
        .otherwise(CLASSES["none"])
    )
