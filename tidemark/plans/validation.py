"""Checks of what people enter, and of what a rule lets the engine compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import float_prefix
from tidemark.plans.scoring import RANGES

# --- fixed values ---
REQUIRED = ("korean", "math", "english", "history")
GRADED = ("english", "history")
RELATIVE = ("korean", "math", "inquiry1", "inquiry2")
SELECTED = ("math", "inquiry1", "inquiry2")
INQUIRY = ("inquiry1", "inquiry2")
# --- end of fixed values ---


def signal_problem(kind: Column, value: Column) -> Column:
    """What is wrong with another tool's result, null if nothing: empty, kansu (an integer 1 to 8), probability (0 to 100), color (20 characters), memo (500)."""
    text = F.trim(value)
    kansu = text.rlike("^[1-8]$")
    share = float_prefix(F.replace(text, F.lit("%"), F.lit("")))
    fine = F.when(kind == "kansu", kansu).when(kind == "probability", F.coalesce(share.between(0, 100), F.lit(False))).when(kind == "color", F.char_length(text) <= 20).when(kind == "memo", F.char_length(text) <= 500).otherwise(True)
    return F.when(text == "", "empty").when(~fine, kind)


def outcome_problems(applied: Column, result: Column, waitlist: Column, registered: Column) -> Column:
    """Contradictions in a final outcome, in order."""
    given = waitlist.isNotNull()
    return F.array_compact(F.array(
        F.when(~applied & (result != "unknown"), "not_applied"),
        F.when(given & (result != "waitlisted"), "waitlist_result"),
        F.when(given & (result == "waitlisted") & (waitlist < 1), "waitlist_number"),
        F.when(registered & (result != "accepted"), "registered"),
    ))


def complete_grades(by_grade: Column) -> Column:
    """Whether a policy's table has a value for each grade from 1 to 9."""
    return F.coalesce(F.forall(F.sequence(F.lit(1), F.lit(9)), lambda g: F.try_element_at(by_grade, g).isNotNull()), F.lit(False))


def exam_problems(scores: DataFrame, exam: str, ordinal: str) -> DataFrame:
    """(exam, errors, warnings) of rows (exam, subject, selection, raw, standard, percentile, grade); each code once, in order of its text.

    Of repeated subjects the last row by ordinal counts for what must be there; ranges hold for all rows.
    """
    outside = [F.when((F.col(f) < lo) | (F.col(f) > hi), F.concat(F.lit(f"range:{f}:"), F.col("subject"))) for f, (lo, hi) in RANGES.items()]
    last = F.max_by(F.struct("selection", "standard", "percentile", "grade"), F.col(ordinal))
    each = scores.groupBy(exam, "subject").agg(F.count("*").alias("n"), last.alias("x"), F.flatten(F.collect_set(F.array_compact(F.array(*outside)))).alias("ranges"))
    s, x = F.col("subject"), F.col("x")
    code = lambda name, cond: F.when(cond, F.concat(F.lit(f"{name}:"), s))
    errors = F.array_compact(F.array(code("duplicate", F.col("n") > 1), code("grade_required", s.isin(*GRADED) & x["grade"].isNull()), code("metric_required", s.isin(*RELATIVE) & x["standard"].isNull() & x["percentile"].isNull())))
    each = each.select(exam, "subject", F.concat(errors, "ranges").alias("errors"), code("selection", s.isin(*SELECTED) & (F.coalesce(x["selection"], F.lit("")) == "")).alias("warning"))
    whole = each.groupBy(exam).agg(F.collect_set("subject").alias("held"), F.flatten(F.collect_list("errors")).alias("errors"), F.collect_list("warning").alias("warnings"))
    names = lambda v: F.array(*map(F.lit, v))
    missing = F.transform(F.array_except(names(REQUIRED), F.col("held")), lambda v: F.concat(F.lit("required:"), v))
    no_inquiry = F.when(~F.arrays_overlap(F.col("held"), names(INQUIRY)), F.array(F.lit("inquiry"))).otherwise(F.array().cast("array<string>"))
    return whole.select(exam, F.array_sort(F.array_distinct(F.concat("errors", missing))).alias("errors"), F.array_sort(F.concat("warnings", no_inquiry)).alias("warnings"))


def _filled(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def _restricted(rule: Column) -> Column:
    """Whether a rule needs inputs or components that scores don't hold, or converts inquiry scores only roughly."""
    needs = _filled(rule["external_components"]) | _filled(rule["required_inputs"])
    needs |= F.coalesce(F.exists(rule["alternatives"], lambda a: _filled(a["external_components"]) | _filled(a["required_inputs"])), F.lit(False))
    types = rule["subject_score_types"]
    rough = (rule["score_type"] == "mixed") & (rule["weights"]["inquiry"] > 0) & rule["inquiry_policy"]["table"].isNull() & F.coalesce(types["inquiry"].isNull(), F.lit(True))
    return needs | F.coalesce(rough, F.lit(False))


def _usable(rule: Column) -> Column:
    return F.coalesce(rule.isNotNull() & (rule["verified_status"] == "verified") & (rule["score_type"] != "custom"), F.lit(False))


def unlocks_exact(rule: Column) -> Column:
    """Whether a reviewed rule lets the engine compute exact scores."""
    return _usable(rule) & ~_restricted(rule)


def enables_relative(rule: Column) -> Column:
    """Whether it allows a relative comparison only: scores count, but something else is missing."""
    w, english = rule["weights"], rule["english_policy"]
    counts = (w["korean"] > 0) | (w["math"] > 0) | (w["inquiry"] > 0) | ((english["mode"] == "ratio") & (F.coalesce(english["weight"], F.lit(0.0)) > 0)) | rule["selection_policy"].isNotNull()
    return _usable(rule) & F.coalesce(counts, F.lit(False)) & _restricted(rule)
