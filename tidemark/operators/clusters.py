"""Groups with counters and limited lists, where no list is longer than its limit in any shuffle.

A list's values are counted and ranked as rows (key, list, value) before anything is
collected: distinct values are partial aggregates, a rank cuts each list at its limit
(Spark cuts it in each task before the shuffle, too), and only what is left is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import missing_from

# --- fixed values: continuity, flags and weights of clusters ---
CONTINUITY = ((5, "high"), (3, "medium"), (0, "low"))
CONTINUITY_POINTS = {"high": 80, "medium": 45, "low": 10}
SCORE_POINTS, SCORE_MOST, METRIC_MOST, GROUP_POINTS, GROUP_MOST, YEAR_POINTS = 3, 60, 40, 5, 20, 8
# --- end of fixed values ---


@dataclass
class Limited:
    """A list of a group: its different non-blank values, at most `most`.

    value: a column or an array of values. by: `first` (as first seen), `often` (the most frequent first, then as first
    seen), or a column of text by whose smallest value a value is placed, then as first seen.
    """

    value: Column
    most: int
    by: str | Column = "first"


def limited_lists(df: DataFrame, keys: list[str], lists: dict[str, Limited], ordinal: Column) -> DataFrame:
    """One row per key: for each list an array of struct(value, n), n being how often the value occurs, and `<list>_size`, the number of all its values."""
    schema = dict(df.select(*(x.value.alias(n) for n, x in lists.items())).dtypes)
    own = lambda n, x: x.value.cast("array<string>") if schema[n].startswith("array") else F.array(x.value.cast("string"))
    place = lambda x: x.by if isinstance(x.by, Column) else F.lit("")
    entries = [F.struct(F.lit(i).alias("i"), own(n, x).alias("vs"), place(x).cast("string").alias("p")) for i, (n, x) in enumerate(lists.items())]
    long = df.select(*keys, ordinal.alias("_o"), F.explode(F.array(*entries)).alias("e")).select(*keys, "_o", "e.i", "e.p", F.explode("e.vs").alias("v")).filter("v is not null and trim(v) <> ''")
    counted = long.groupBy(*keys, "i", "v").agg(F.count("*").alias("n"), F.min(F.struct("p", "_o")).alias("f"))
    often = [i for i, x in enumerate(lists.values()) if isinstance(x.by, str) and x.by == "often"]
    order = F.struct(F.when(F.col("i").isin(often) if often else F.lit(False), -F.col("n")).otherwise(F.lit(0)).alias("a"), F.col("f.p").alias("b"), F.col("f._o").alias("c"), F.col("v").alias("d"))
    cap = F.element_at(F.array(*(F.lit(x.most) for x in lists.values())), F.col("i") + 1)
    part = Window.partitionBy(*keys, "i")
    # a constant bound lets Spark cut in tasks; each list's own limit follows
    ranked = counted.withColumn("_r", F.row_number().over(part.orderBy(order))).filter(F.col("_r") <= max(x.most for x in lists.values())).filter(F.col("_r") <= cap)
    sizes = counted.groupBy(*keys).agg(*(F.count_if(F.col("i") == i).alias(f"{n}_size") for i, n in enumerate(lists)))
    gathered = ranked.groupBy(*keys).agg(*(F.array_sort(F.collect_list(F.when(F.col("i") == i, F.struct("_r", "v", "n")))).alias(n) for i, n in enumerate(lists)))
    trimmed = gathered.select(*keys, *(F.transform(n, lambda x: F.struct(x["v"].alias("value"), x["n"].alias("n"))).alias(n) for n in lists))
    return trimmed.join(sizes, keys)


def clustered(units: DataFrame, outcomes: DataFrame, keys: list[str], unit: str, counters: dict[str, Column], lists: dict[str, Limited], outcome_counters: dict[str, Column], outcome_lists: dict[str, Limited], *, ordinal: str, outcome_ordinal: Column) -> DataFrame:
    """One row per key of the units: counters (sums) of its unit rows and of the outcomes of its units, and both kinds of lists.

    An outcome belongs to each row of its unit. Counters of outcomes are summed by unit before they meet the units, so that
    no counter is multiplied; lists of outcomes take the units' order first.
    """
    sums = outcomes.groupBy(unit).agg(*(F.sum(c).alias(n) for n, c in outcome_counters.items()))
    totals = units.join(sums, unit, "left").groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in counters.items()), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in outcome_counters))
    own = limited_lists(units, keys, lists, F.struct(F.col(ordinal)))
    theirs = limited_lists(units.select(*keys, unit, F.col(ordinal).alias("_unit_order")).join(outcomes, unit), keys, outcome_lists, F.struct("_unit_order", outcome_ordinal))
    return totals.join(own, keys, "left").join(theirs, keys, "left")


def assigned(clusters: DataFrame, ids: str, cluster: str, order: list, rows: DataFrame, unit: str) -> DataFrame:
    """Rows with the cluster that lists their unit, the last in order where several do; others are dropped."""
    each = clusters.select(F.explode(ids).alias(unit), cluster, F.struct(*order).alias("_order"))
    last = each.groupBy(unit).agg(F.max_by(cluster, "_order").alias(cluster))
    return rows.join(last, unit)


def continuity(years: Column) -> Column:
    out = F.lit(CONTINUITY[-1][1])
    for least, name in reversed(CONTINUITY[:-1]):
        out = F.when(F.size(years) >= least, name).otherwise(out)
    return out


def judged(df: DataFrame, domain: list[int], *, years: str, scored: str, quota: str, metrics: str, groups: str, names: str) -> DataFrame:
    """df with recent and missing years of the domain, continuity, flags and the review priority; groups and names are list sizes."""
    recent = F.filter(F.array_sort(F.transform(years, lambda x: x["value"].cast("int"))), lambda y: y.isin(domain))
    df = df.withColumn("recent_years", recent).withColumn("missing_years", missing_from(domain, F.col("recent_years"))).withColumn("continuity", continuity(F.col("recent_years")))
    n = F.size("recent_years")
    flags = [(n >= 5, "has_recent_5plus_years"), (n == len(domain), "has_full_coverage"), (n < len(domain), "has_recent_year_gaps"), (F.col(scored) > 0, "has_score_outcomes"), (F.col(quota) > 0, "has_quota_competition"), (F.col(groups) > 1, "has_multiple_recruitment_groups"), (F.col(names) > 1, "has_name_variants")]
    bonus = F.lit(0)
    for name, v in CONTINUITY_POINTS.items():
        bonus = F.when(F.col("continuity") == name, v).otherwise(bonus)
    priority = bonus + F.least(F.col(scored) * SCORE_POINTS, F.lit(SCORE_MOST)) + F.least(F.col(metrics), F.lit(METRIC_MOST)) + F.least(F.col(groups) * GROUP_POINTS, F.lit(GROUP_MOST)) + n * YEAR_POINTS
    return df.withColumn("flags", F.array_compact(F.array(*(F.when(c, f) for c, f in flags)))).withColumn("priority", priority)
