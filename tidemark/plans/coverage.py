"""Coverage of (entity, year) cells: score, missing parts, gaps and their priorities, next stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: points, flags and weights of coverage and gaps ---
POINTS = {"listed": 10, "units": 10, "outcomes": 10, "outcome_scores": 20, "quota_competition": 10, "csat_rules": 10, "quota_drafts": 5, "screening_drafts": 5, "record_drafts": 5, "eligibility_drafts": 5, "year_evidence": 5, "schedules": 3, "queue_p0": 2}
FLAGS = {"units": "missing_admission_units", "outcomes": "missing_historical_outcomes", "outcome_scores": "missing_outcome_scores", "quota_competition": "missing_quota_competition", "csat_rules": "missing_csat_rule_draft", "quota_drafts": "missing_recruitment_quota_draft", "screening_drafts": "missing_screening_method_draft", "record_drafts": "missing_school_record_rule_draft", "eligibility_drafts": "missing_eligibility_rule_draft", "year_evidence": "missing_admission_office_detected_year_evidence", "schedules": "missing_schedule_draft"}
UNLISTED = "university_not_listed_for_year"
ACTION_WEIGHTS = {"missing_historical_outcomes": 35, "missing_outcome_scores": 32, "missing_admission_units": 30, "missing_csat_rule_draft": 28, "missing_quota_competition": 24, "missing_admission_office_detected_year_evidence": 20, "missing_schedule_draft": 18, "missing_recruitment_quota_draft": 16, "missing_screening_method_draft": 14, "missing_school_record_rule_draft": 12, "missing_eligibility_rule_draft": 12, UNLISTED: 8}
TIER_BASE = {"p0": 90, "p1": 70, "p2": 45, "p3": 20}
YEAR_BONUS = {2025: 12, 2026: 12, 2027: 10, 2023: 8, 2024: 8, 2021: 6, 2022: 6}
STAGE_POINTS = {"review_existing_source_candidate": 45, "review_visual_or_ocr_source": 38, "run_or_repair_collection": 25, "wait_for_public_release": 12, "verify_university_scope": 10, "manual_source_discovery": 5}
# --- end of fixed values ---
OUTCOME_FLAGS = ("missing_historical_outcomes", "missing_outcome_scores", "missing_quota_competition")
CRITICAL = ("missing_admission_units", *OUTCOME_FLAGS, "missing_csat_rule_draft")
RULE_FLAGS = ("missing_admission_units", "missing_csat_rule_draft", "missing_recruitment_quota_draft", "missing_screening_method_draft", "missing_school_record_rule_draft", "missing_eligibility_rule_draft", "missing_schedule_draft")
DRAFTS = ("quota_drafts", "screening_drafts", "record_drafts", "eligibility_drafts")
CORE = tuple(x for x in FLAGS if x not in ("year_evidence", "schedules"))


def looked_up(key: Column, table: dict, otherwise: int) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def coverage_score(counts: dict[str, Column]) -> Column:
    """counts: name in POINTS to a count column (`listed` may be a boolean as 0 or 1)."""
    return F.least(sum((F.when(counts[k] > 0, v).otherwise(0) for k, v in POINTS.items()), F.lit(0)), F.lit(100))


def missing_flags(counts: dict[str, Column], year: Column, excluded: Column) -> Column:
    """Flags of empty parts in their order; an unlisted cell has its one flag, whatever is excluded."""
    has = lambda *names: F.forall(F.array(*(counts[n].cast("long") for n in names)), lambda x: x > 0)
    waived = F.coalesce(F.array_contains(excluded, FLAGS["csat_rules"]), F.lit(False))
    core = ("units", "outcomes", "outcome_scores")
    old_rules = (year <= 2025) & has(*core, "year_evidence") & (has("csat_rules") | waived)
    old_schedule = (year <= 2021) & has(*core)
    excuse = {**dict.fromkeys(DRAFTS, old_rules), "year_evidence": has(*CORE), "schedules": old_schedule}
    flags = F.array_compact(F.array(*(F.when((counts[k] == 0) & ~F.coalesce(excuse.get(k, F.lit(False)), F.lit(False)), f) for k, f in FLAGS.items())))
    return F.when(counts["listed"] == 0, F.array(F.lit(UNLISTED))).otherwise(F.filter(flags, lambda f: ~F.coalesce(F.array_contains(excluded, f), F.lit(False))))


def coverage_tier(score: Column, flags: Column) -> Column:
    rich = (score >= 80) & ~F.array_contains(flags, "missing_outcome_scores") & ~F.array_contains(flags, "missing_csat_rule_draft")
    return F.when(rich, "source_rich_review_ready").when(score >= 60, "review_ready_partial").when(score >= 35, "partial_evidence").otherwise("source_gap")


def priority_tier(flag: Column, year: Column, tier: Column) -> Column:
    now = (*RULE_FLAGS, "missing_admission_office_detected_year_evidence")
    return (
        F.when((year <= 2026) & flag.isin(*CRITICAL), "p0")
        .when((year == 2027) & flag.isin(*now), "p0")
        .when((tier == "source_gap") & (year <= 2026), "p0")
        .when(flag.isin(*OUTCOME_FLAGS) & (year == 2027), "p1")
        .when(flag.isin("missing_schedule_draft", "missing_admission_office_detected_year_evidence", *CRITICAL), "p1")
        .when(flag == UNLISTED, "p2")
        .when(tier.isin("partial_evidence", "review_ready_partial"), "p2")
        .otherwise("p3")
    )


def action_priority(flag: Column, year: Column, priority: Column, score: Column, collected: Column) -> Column:
    gap = F.floor(F.greatest(F.lit(0), 100 - score) / 5)
    return looked_up(priority, TIER_BASE, 30) + looked_up(flag, ACTION_WEIGHTS, 10) + looked_up(year, YEAR_BONUS, 0) + gap + F.when(collected > 0, 4).otherwise(0)


def expected_availability(flag: Column, year: Column) -> Column:
    outcome = F.when(year >= 2027, "likely_not_public_until_after_cycle").when(year == 2026, "check_public_now_or_pending_release").otherwise("should_be_public_or_parse_gap")
    rule = F.when(year == 2027, "should_be_public_for_current_cycle").otherwise("should_be_public_or_parse_gap")
    return (
        F.when(year.isNull(), "unknown_year_requires_manual_assignment")
        .when(flag.isin(*OUTCOME_FLAGS), outcome)
        .when(flag.isin(*RULE_FLAGS), rule)
        .when(flag == "missing_admission_office_detected_year_evidence", "should_be_public_or_parse_gap")
        .when(flag == UNLISTED, "verify_scope_or_institution_status")
        .otherwise("needs_review")
    )


def gaps(cells: DataFrame) -> DataFrame:
    """A row per missing flag of each cell (flags, year, tier, score, collected); flags without a weight fall out."""
    rows = cells.withColumn("flag", F.explode("flags")).filter(F.col("flag").isin(*ACTION_WEIGHTS)).drop("flags")
    rows = rows.withColumn("priority", priority_tier(F.col("flag"), F.col("year"), F.col("tier")))
    return rows.withColumn("action_score", action_priority(F.col("flag"), F.col("year"), F.col("priority"), F.col("score"), F.col("collected"))).withColumn("availability", expected_availability(F.col("flag"), F.col("year")))


def next_stage(sources: Column, visuals: Column, targets: Column, availability: Column, unlisted: Column) -> Column:
    return (
        F.when(sources > 0, "review_existing_source_candidate")
        .when(visuals > 0, "review_visual_or_ocr_source")
        .when(targets > 0, "run_or_repair_collection")
        .when(availability == "likely_not_public_until_after_cycle", "wait_for_public_release")
        .when(unlisted, "verify_university_scope")
        .otherwise("manual_source_discovery")
    )


def operation_priority(base: Column, stage: Column, sources: Column, visuals: Column, targets: Column, rule_or_outcome: Column, availability: Column) -> Column:
    return (
        base
        + looked_up(stage, STAGE_POINTS, 0)
        + F.least(F.lit(30), sources * 4)
        + F.least(F.lit(25), visuals * 3)
        + F.least(F.lit(20), targets * 2)
        + F.when(rule_or_outcome, 12).otherwise(0)
        + F.when(availability == "should_be_public_or_parse_gap", 10).otherwise(0)
    )


def match_score(target_points: Column, same_year: Column, category_match: Column, artifact: Column, priority: Column, review_score: Column, least: int = 110) -> Column:
    """Points of a source for a gap; null below `least` or without target points."""
    score = (
        40
        + target_points
        + F.when(same_year, 90).otherwise(0)
        + F.when(category_match, 55).otherwise(0)
        + looked_up(artifact, {"evidence": 25, "structured": 15}, 0)
        + looked_up(priority, {"p0": 20, "p1": 12, "p2": 5}, 0)
        + F.least(F.lit(30), F.floor(review_score / 12))
    )
    return F.when((target_points > 0) & (score >= least), score)


def series_priority(years: Column, score_rows: Column, metrics: Column, mixed: Column, domain: int = 7) -> Column:
    """Review priority of a series by its distinct recent years, scored rows and metrics."""
    return F.greatest(
        F.lit(0),
        years * 12 + F.least(score_rows * 5, F.lit(80)) + F.least(metrics, F.lit(50)) + F.when(years >= 5, 50).otherwise(0) + F.when(years == domain, 30).otherwise(0) - F.when(mixed, 10).otherwise(0),
    )


# --- fixed values: points of evidence ---
EVIDENCE_TYPE = {"workbook_row": 24, "workbook_sheet": 18, "pdf_page_image": 10, "pdf_snippet": 12, "hwp_snippet": 12, "office_document_snippet": 12}
SNIPPETS = ("pdf_snippet", "hwp_snippet", "office_document_snippet")
EVIDENCE_ROLE = {
    "admission_result_table": 20, "admission_result_row": 20, "competition_rate_table": 20, "competition_rate_row": 20,
    "csat_reflection_rule": 16, "screening_method": 16, "screening_method_row": 16, "recruitment_quota_table": 16, "recruitment_quota_row": 16, "eligibility_rule": 16, "school_record_rule": 16,
    "schedule_and_registration": 8, "schedule_row": 8, "low_text_pdf_page_image": 6,
}
LINK_ROLE = {"admission_result": 14, "competition_rate": 12, "recruitment_notice": 8}
LANES = {
    "AdmissionUnit": "admission_unit_core", "GradeCutReference": "kice_score_reference", "StandardScoreDistributionReference": "kice_score_reference",
    "University": "university_master", "AdmissionUnitClusterReview": "continuity_review", "HistoricalOutcomeSeriesReview": "continuity_review",
}
# --- end of fixed values ---


def points(value: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value), F.lit(0))


def evidence_score(kind: Column, role: Column, link: Column, score: Column) -> Column:
    """20 and the points of type, role and link; a snippet adds its own score up to 20."""
    own = F.when(kind.isin(*SNIPPETS), F.least(F.lit(20), F.coalesce(score, F.lit(0)))).otherwise(0)
    return 20 + points(kind, EVIDENCE_TYPE) + own + points(role, EVIDENCE_ROLE) + points(link, LINK_ROLE)


def window_score(text: Column, matched: Column) -> Column:
    """Two a keyword, one for twelve digits up to 8, one a line of three cells or more up to 6."""
    rows = F.filter(F.split(text, "\n"), lambda line: F.size(F.split(F.trim(line), r"\s{2,}")) >= 3)
    return matched * 2 + F.least(F.lit(8), F.floor(F.regexp_count(text, F.lit(r"[0-9]")) / 12)) + F.least(F.lit(6), F.size(rows))


def review_lane(target: Column, artifact: Column, year: Column) -> Column:
    """The queue that a decision belongs to."""
    core = (target == "HistoricalOutcome") & (artifact == "foundation_historical_outcomes")
    next_year = target.isin("AdmissionRule", "AdmissionSchedule") & (year == "2027")
    of = F.create_map(*(F.lit(x) for kv in LANES.items() for x in kv))
    return F.when(core, "historical_outcome_core").when(next_year, "rule_schedule_2027").otherwise(F.coalesce(F.try_element_at(of, target), F.lit("other_p0_review")))
