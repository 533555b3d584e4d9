"""Row filters of the reference-data lookups, as conditions or small compositions of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def candidate_filter(unit: Column, university: Column, region: Column, name: Column, *, unit_ids=(), university_ids=(), regions=(), names=()) -> Column:
    """Unit ids alone if given, else university ids alone, else regions and names, each where given; nothing given keeps all."""
    if unit_ids:
        return unit.isin(*unit_ids)
    if university_ids:
        return university.isin(*university_ids)
    return reduce(lambda x, y: x & y, [c.isin(*v) for c, v in ((region, regions), (name, names)) if v], F.lit(True))


def outcome_fits(verified: Column, total_scale: Column, cut_score: Column, percentile_cut: Column) -> Column:
    """Whether an outcome can be compared under a rule: verified ones by cut over scale in [0.2, 1.2], others by a percentile cut in [20, 100]."""
    return F.coalesce(F.when(verified, (cut_score / total_scale).between(0.2, 1.2)).otherwise(percentile_cut.between(20, 100)), F.lit(False))


def uuid_or_null(text: Column) -> Column:
    return F.when(text.rlike(UUID), text)


def limit_of(asked: int | None, default: int, most: int) -> int:
    """A limit asked for, between 1 and most."""
    return max(1, min(most, default if asked is None else asked))


def in_queue(verdict: Column, uncertain: Column, *, pending: bool = False, decided: bool = False, only_uncertain: bool = False) -> Column:
    """The rows of a review queue: without a verdict, with one, and of these the uncertain ones, as asked for."""
    wanted = [(pending, verdict.isNull()), (decided, verdict.isNotNull()), (only_uncertain, uncertain)]
    return reduce(lambda x, y: x & y, [c for on, c in wanted if on], F.lit(True))


def seeded(rows: DataFrame, parent: DataFrame, key: str, id_col: str, keep: Column, order: list) -> DataFrame:
    """Rows that are kept, have their parent and are the first of their id."""
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return rows.filter(keep).join(parent.select(key).distinct(), key, "left_semi").withColumn("_first", first).filter("_first = 1").drop("_first")


def not_blocked(text: Column, noise: str, override: str) -> Column:
    """Whether a text lacks the noise pattern, or holds the one that overrides it."""
    return ~text.rlike(noise) | text.rlike(override)


def inferred_years(explicit: Column, collected: Column) -> Column:
    """The explicit years if there are any, else the collected year if it is the only one, else none."""
    none = F.slice(explicit, 1, 0)
    return F.when(F.size(explicit) > 0, explicit).when(F.size(collected) == 1, collected).otherwise(none)
