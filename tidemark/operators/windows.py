"""Rankings, fills and islands, as windows. Every order is total: give a tie-breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list, k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; Spark cuts the groups before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_k(df, keys, order, 1)


def guaranteed_then_fill(df: DataFrame, keys: list[str], role: str, order: list, per_role: int, total: int) -> DataFrame:
    """Of each key `total` rows: the first per_role of every role, then the others, both by order."""
    own = F.row_number().over(Window.partitionBy(*keys, role).orderBy(*order))
    ranked = df.withColumn("_own", own).withColumn("_late", F.col("_own") > per_role)
    return top_k(ranked, keys, ["_late", *order], total).drop("_own", "_late")


def quota_then_cap(df: DataFrame, keys: list[str], role: str, order: list, per_role: int, total: int) -> DataFrame:
    """Of each key the first `total` of what is left when every role keeps its first per_role rows."""
    return top_k(top_k(df, [*keys, role], order, per_role), keys, order, total)


def capped_ranking(df: DataFrame, group: list[str], order: list, per_group: int, limit: int) -> DataFrame:
    """The first `limit` rows with at most per_group of each group."""
    return top_k(df, group, order, per_group).orderBy(*order).limit(limit)


def forward_fill(df: DataFrame, keys: list[str], order: list, columns: dict[str, Column]) -> DataFrame:
    """Adds columns: the last non-null value of each expression up to the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.last(c, ignorenulls=True).over(w) for name, c in columns.items()})


def context(df: DataFrame, keys: list[str], order: list, value: str, before: int, after: int, name: str, separator: str = "\n") -> DataFrame:
    """Adds the values of the rows from `before` rows above to `after` rows below, joined."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn(name, F.array_join(F.collect_list(value).over(w), separator))


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap, name: str = "island") -> DataFrame:
    """Numbers runs of intervals that begin at most `gap` after all earlier ends of their key."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def folded_score(scores: Column) -> Column:
    """The score of an island whose members merge one after the other: max(current, next) + 1 a merge. scores: array in order."""
    return F.aggregate(F.slice(scores, 2, 1 << 20), scores[0], lambda s, x: F.greatest(s, x) + 1)


def latest_value(value: Column, order: Column) -> Column:
    """Aggregate: the value of the largest order among non-null values."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def greedy_spans(spans: Column, per_role: int, most: int) -> Column:
    """Of an ordered array of struct(role, start, end, ...): those taken in turn that overlap none taken of their role, within the quotas."""

    def fits(taken: Column, x: Column) -> Column:
        own = F.filter(taken, lambda y: y["role"] == x["role"])
        return (F.size(own) < per_role) & (F.size(taken) < most) & ~F.exists(own, lambda y: (x["start"] <= y["end"]) & (y["start"] <= x["end"]))

    return F.aggregate(spans, F.slice(spans, 1, 0), lambda taken, x: F.when(fits(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
