"""Group computations. Lists are ordered by an ordinal of the source, never by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_counts(column: str, values: tuple[str, ...], prefix: str = "n_") -> list[Column]:
    """One count per value, 0 where it doesn't occur."""
    return [F.count(F.when(F.col(column) == v, 1)).alias(f"{prefix}{v}") for v in values]


def ordered_unique(value: Column, ordinal: Column, most: int | None = None) -> Column:
    """Aggregate: distinct non-blank values by first ordinal, at most `most`."""
    kept = F.when(value.isNotNull() & (value.cast("string") != ""), F.struct(ordinal.alias("o"), value.alias("v")))
    out = F.array_distinct(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["v"]))
    return F.slice(out, 1, most) if most else out


def first_best(row: Column, score: Column, ordinal: Column) -> Column:
    """Aggregate: the row of the highest score, the smallest ordinal on ties."""
    return F.max_by(row, F.struct(score, -ordinal))


def mode_by_first(df: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """The most frequent non-null value of each key; of equal counts the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first"))).alias("m")).select(*keys, f"m.{value}", "m.n")


def merged_by_name(df: DataFrame, name: str, id_col: str, count_col: str, rank_col: str, order_col: str, attributes: list[str]) -> DataFrame:
    """Rows of one display name: ids in order, summed count, smallest rank, and the attributes of the row first in order."""
    return df.groupBy(name).agg(
        F.transform(F.sort_array(F.collect_set(F.struct(order_col, id_col))), lambda x: x[id_col]).alias("ids"),
        F.sum(count_col).alias(count_col),
        F.min(rank_col).alias(rank_col),
        F.min_by(F.struct(*attributes), F.struct(F.col(order_col), F.col(id_col))).alias("_a"),
    ).select(name, "ids", count_col, rank_col, *(F.col(f"_a.{a}").alias(a) for a in attributes))


def value_counts(df: DataFrame, array: Column, name: str = "value", by: list[str] | None = None) -> DataFrame:
    """How often each array element occurs, for each key of `by`."""
    keys = by or []
    return df.select(*keys, F.explode(array).alias(name)).groupBy(*keys, name).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, empty keys, surplus rows of repeated keys."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    counts = df.filter(~blank).groupBy(key).agg(F.count("*").alias("n"))
    surplus = counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))
    totals = df.agg(F.count("*").alias("rows"), F.count(F.when(blank, 1)).alias("empty_ids"))
    return totals.join(surplus, F.lit(True))


def missing_from(domain: list[int], seen: Column) -> Column:
    return F.array_except(F.array(*(F.lit(x) for x in domain)), seen)


def numeric_range(value: Column, order: Column) -> list[Column]:
    """Aggregates: count, min, max and the value of the largest order."""
    return [F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, F.when(value.isNotNull(), order)).alias("latest")]


def melted(df: DataFrame, keys: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long: a row per key and non-null column."""
    return df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], name, value).filter(F.col(value).isNotNull())


def keyed_by_lane(df: DataFrame, lane: Column, keys: dict[str, list[Column]]) -> DataFrame:
    """Adds lane and batch_key: the key columns that the row's lane groups by, joined."""
    out = df.withColumn("lane", lane)
    key = F.coalesce(*(F.when(F.col("lane") == name, F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))) for name, columns in keys.items()))
    return out.withColumn("batch_key", key)


def batched(df: DataFrame, group: list[str], id_col: str, url_col: str, score_col: str, ids: int = 20, urls: int = 5) -> DataFrame:
    """Of each group: count, best score, first ids and first distinct urls by id. Lists are cut to what the report shows."""
    first_urls = df.groupBy(*group, url_col).agg(F.min(id_col).alias("_at")).groupBy(*group).agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("_at", url_col))), 1, urls), lambda x: x[url_col]).alias("urls"))
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(id_col)))
    heads = numbered.groupBy(*group).agg(F.count("*").alias("n"), F.max(score_col).alias("best"), F.sort_array(F.collect_list(F.when(F.col("_n") <= ids, F.col(id_col)))).alias("ids"))
    return heads.join(first_urls, group, "left")


def head_and_union(df: DataFrame, keys: list[str], order: list, head: list[str], union: str) -> DataFrame:
    """Of each group the `head` columns of its first row, its size and the distinct values of `union`, in order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("_first", first)
    return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("_first") == 1, F.col(c))).alias(c) for c in head), F.count("*").alias("n"), F.sort_array(F.collect_set(union)).alias(union))


def tally(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): how often each value of each column occurs, in one shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return df.select(pairs).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
