"""What changed scores would do: one run of the engine over the scenarios of a candidate, and results per examinee.

Scenarios are the scores as they are, all changes together, and each changed
subject alone. They are an array inside the candidate's row, or inside that of an
examinee and a rule that several units have, so that nothing is grouped to bring
the scenarios of a pair together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import round2
from tidemark.plans import scoring

# --- fixed values: reasons that remain a subject's weakness, with the subjects ---
WEAKNESS = {"english_penalty_risk": ("english",), "science_conversion_risk": ("inquiry1", "inquiry2"), "math_requirement_fail": ("math",)}
# --- end of fixed values ---

CHANGE = "struct<standard:double,percentile:double,grade:int,standard_delta:double,percentile_delta:double,grade_delta:int>"


def change(**fields: Column | float) -> Column:
    """A CHANGE from some of its fields; the others are null."""
    names = [x.split(":") for x in CHANGE[len("struct<") : -1].split(",")]
    if unknown := set(fields) - {n for n, _ in names}:
        raise ValueError(f"not fields of a change: {sorted(unknown)}")
    return F.struct(*((fields[n] if isinstance(fields.get(n), Column) else F.lit(fields.get(n))).cast(t).alias(n) for n, t in names))


def changed_subjects(changes: Column) -> Column:
    """The subjects with a change, in their order."""
    return F.filter(F.array(*(F.lit(s) for s in scoring.SUBJECTS)), lambda s: F.map_contains_key(changes, s))


def scenarios(changes: Column) -> Column:
    """Array of struct(scenario, changes): baseline, all, and each changed subject alone if there are several."""
    names = changed_subjects(changes)
    pair = lambda name, own: F.struct(name.alias("scenario"), own.alias("changes"))
    alone = F.transform(names, lambda n: pair(n, F.map_filter(changes, lambda k, _: k == n)))
    fixed = F.array(pair(F.lit("baseline"), F.map_filter(changes, lambda k, v: F.lit(False))), pair(F.lit("all"), changes))
    return F.when(F.size(names) > 1, F.concat(fixed, alone)).otherwise(fixed)


def compared(candidates: DataFrame, keys: list[str], unit: str, *, target: Column | None = None) -> DataFrame:
    """One row per candidate, (keys, unit): the bands before and after all changes and after each alone, null where a unit can't be analysed.

    candidates: those of scoring.analyzed, with `changes` (map of subject to CHANGE); each pair once, or in the `units` of a
    rule's row. target: whether the unit is one that the examinee aims at. Columns: target, before, after, alone (map of subject
    to band), weak (subjects of remaining weaknesses that the examinee has scores of), subjects_changed (array).
    """
    rule, subjects = F.col("rule"), F.col("subjects")
    moved = F.transform(scenarios(F.col("changes")), lambda x: F.struct(x["scenario"].alias("scenario"), scoring.simulated(subjects, x["changes"]).alias("subjects")))
    runs = F.transform(moved, lambda x: F.struct(x["scenario"].alias("scenario"), scoring.scored(rule, x["subjects"]).alias("run")))
    # one-element generators keep the optimizer from copying long expressions
    aimed = F.coalesce(target, F.lit(False)) if target is not None else F.lit(False)
    rows = candidates.withColumn("_runs", F.explode(F.array(runs)))
    # the weaknesses are warnings that a rule's units share
    full = F.get("_runs", F.lit(1))["run"]["warnings"]
    weak = F.array_compact(F.array(*(F.when(F.array_contains(full, code) & F.map_contains_key(subjects, F.lit(s)), s) for code, names in WEAKNESS.items() for s in names)))
    run = lambda n: F.get(F.filter("_runs", lambda x: x["scenario"] == n), F.lit(0))["run"]
    rows = rows.withColumns({"_weak": weak, "subjects_changed": changed_subjects(F.col("changes")), **{f"_run_{n}": run(n) for n in ("baseline", "all", *scoring.SUBJECTS)}})
    if "units" in candidates.columns:
        rows = rows.select(*(c for c in rows.columns if c not in ("rule", "subjects", "changes", "units", "_runs")), F.inline("units"))
    rows = rows.withColumn("target", aimed)

    # a column a scenario, null where the candidate hasn't it; `apart` as the selects are long
    names = ("baseline", "all", *scoring.SUBJECTS)
    rows = rows.withColumns({"quota": scoring.apart(F.col("quota")), **{f"_gap_{n}": round2(F.col(f"_run_{n}")["c"]["score"] - scoring.reference_score(F.col(f"_run_{n}"))) for n in names}})
    settled = {f"_{x}_{n}": y for n in names for x, y in (("ok", scoring.kind_of(F.col(f"_run_{n}"), F.col(f"_gap_{n}")) == "ok"), ("trust", scoring.unit_confidence(F.col(f"_run_{n}"))))}
    rows = rows.withColumns({"quota": scoring.apart(F.col("quota")), **settled})
    rows = rows.withColumns({f"_band_{n}": F.when(F.col(f"_ok_{n}"), scoring.unit_band(F.col(f"_run_{n}"), F.col(f"_gap_{n}"), F.col(f"_trust_{n}"))) for n in names})
    # each band is named twice, so that the optimizer doesn't move its formula into the array's lambda, where it would be interpreted
    alone = F.array_compact(F.array(*(F.when(F.col(f"_band_{s}").isNotNull(), F.struct(F.lit(s).alias("scenario"), F.col(f"_band_{s}").alias("band"))) for s in scoring.SUBJECTS)))
    return rows.select(
        *keys,
        unit,
        "target",
        F.col("_band_baseline").alias("before"),
        F.col("_band_all").alias("after"),
        F.map_from_entries(alone).alias("alone"),
        # warnings stand where kind is ok
        F.when(F.col("_ok_all"), F.col("_weak")).otherwise(F.array().cast("array<string>")).alias("weak"),
        "subjects_changed",
    )


def _favourable(band: Column) -> Column:
    return F.coalesce(scoring.band_rank(band) <= scoring.band_rank(F.lit("match")), F.lit(False))


def _approach(band: str) -> Column:
    """The most favourable band among targets, else among all units, else `limited`."""
    rank, names = scoring.band_rank(F.col(band)), F.array(*(F.lit(b) for b in scoring.BANDS))
    best = F.coalesce(F.min(F.when(F.col("target"), rank)), F.min(rank))
    return F.coalesce(F.try_element_at(names, best + 1), F.lit("limited"))


def band_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of `compared` rows: how many units changed bands and how many came to match or better; keys without changes have no row."""
    return pairs.filter(~F.col("before").eqNullSafe(F.col("after"))).groupBy(*keys).agg(F.count("*").alias("changed"), F.count_if(_favourable(F.col("after")) & ~_favourable(F.col("before"))).alias("moved_to_match_or_better"))


def results(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per examinee of `compared` rows: both distributions, changes, approach to the targets, the most efficient subject and those to mind.

    The most efficient subject is the one whose change alone improves most units (a unit that becomes analysable counts);
    the first in order on ties; the only one if one is changed. caution_subjects are what the changes leave weak, in order.
    """
    before, after = F.col("before"), F.col("after")
    counts = [F.count_if(F.col(when) == b).alias(f"{name}_{b}") for when, name in (("before", "baseline"), ("after", "simulated")) for b in scoring.BANDS]
    # a subject has an improvement only where its own run has a band
    better = lambda s: F.count_if(F.coalesce(scoring.band_rank(F.try_element_at(F.col("alone"), F.lit(s))) < F.coalesce(scoring.band_rank(before), F.lit(len(scoring.BANDS))), F.lit(False)))
    mind = lambda s: F.max(F.array_contains("weak", s)).alias(f"_mind_{s}")
    found = pairs.groupBy(*keys).agg(
        *counts,
        F.count_if(~before.eqNullSafe(after)).alias("changed"),
        F.count_if(_favourable(after) & ~_favourable(before)).alias("moved_to_match_or_better"),
        _approach("before").alias("approach_before"),
        _approach("after").alias("approach_after"),
        *(F.max(F.array_contains("subjects_changed", s)).alias(f"_changed_{s}") for s in scoring.SUBJECTS),
        *(better(s).alias(f"_better_{s}") for s in scoring.SUBJECTS),
        *(mind(s) for s in scoring.SUBJECTS),
    )
    # array_max takes the first in order on ties by the negated place
    scored = F.array_compact(F.array(*(F.when(F.col(f"_changed_{s}"), F.struct(F.col(f"_better_{s}").alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s"))) for i, s in enumerate(scoring.SUBJECTS))))
    efficient = F.array_max(scored)
    caution = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_mind_{s}"), s) for s in scoring.SUBJECTS))), "|")
    return found.select(
        *keys,
        *(c for c in found.columns if c not in keys and not c.startswith("_")),
        efficient["s"].alias("most_efficient_subject"),
        F.when(F.size(scored) > 1, efficient["n"]).alias("units_improved"),
        caution.alias("caution_subjects"),
    )
