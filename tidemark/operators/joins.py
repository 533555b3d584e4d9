"""Lookups between tables: all of them equi joins with small residual conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import top_k


def with_latest(left: DataFrame, right: DataFrame, keys: list[str], order: list, how: str = "left") -> DataFrame:
    """left with the first row by order of its key in right."""
    return left.join(top_k(right, keys, order), keys, how)


def fallback(left: DataFrame, own: DataFrame, own_key: list[str], other: DataFrame, keys: list[str], fits: Column, order: list, both: Column | None = None, tag: str | None = None) -> DataFrame:
    """Rows of left without any row in `own` by own_key, with the first row of `other` on keys that fits; null where none does.

    fits and order read columns of `other` alone, so it is ranked before the join, one row a key. A condition `both` that
    reads left's columns too makes each pair of a key a candidate; `tag` then is the column that identifies a row of left.
    """
    lacking = left.join(own.select(*own_key).distinct(), own_key, "left_anti")
    if both is None:
        return lacking.join(top_k(other.filter(fits), keys, order), keys, "left")
    found = top_k(lacking.join(other.filter(fits), keys).filter(both), [tag], order)
    extra = [c for c in found.columns if c not in left.columns]
    return lacking.join(found.select(tag, *extra), tag, "left")


def tiered(left: DataFrame, right: DataFrame, keys: list[str], tier: Column, order: list) -> DataFrame:
    """left with one row of right on keys: of the smallest non-null tier, then by order; both read right's columns, so it is ranked before the join."""
    best = top_k(right.withColumn("tier", tier).filter("tier is not null"), keys, ["tier", *order])
    return left.join(best, keys, "left")


def compared(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join of two runs: prev_ and curr_ of each value."""
    a = before.select(*keys, *(F.col(v).alias(f"prev_{v}") for v in values))
    b = after.select(*keys, *(F.col(v).alias(f"curr_{v}") for v in values))
    return a.join(b, keys, "full")


def expanded(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """A row for each integer from start to end (start alone if end is null), so that a range joins by equality."""
    return df.withColumn(name, F.explode(F.sequence(F.col(start), F.greatest(F.coalesce(F.col(end), F.col(start)), F.col(start)))))


def scaffold(keys: DataFrame, domain: list[int], name: str, sources: dict[str, DataFrame], on: str) -> DataFrame:
    """Every key with every value of a small fixed domain, and the rows of each source counted by (key, value); 0 where none."""
    out = keys.select(on).distinct().withColumn(name, F.explode(F.array(*(F.lit(v) for v in domain))))
    for column, source in sources.items():
        counts = source.groupBy(on, name).agg(F.count("*").alias(column))
        out = out.join(counts, [on, name], "left").withColumn(column, F.coalesce(column, F.lit(0)))
    return out


def ranked_with_default(gaps: DataFrame, candidates: DataFrame, keys: list[str], dedup: list[str], order: list, k: int) -> DataFrame:
    """Each gap with the first k distinct candidates of its keys and their rank; a gap without any keeps one row of rank 0.

    Candidates are ranked by their own keys before they meet the gaps.
    """
    best = top_k(top_k(candidates, [*keys, *dedup], order), keys, order, k, rank="rank")
    return gaps.join(best, keys, "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def with_extra_tier(first: DataFrame, extra: DataFrame, key: str, fewer_than: int) -> DataFrame:
    """Rows of `first`, and of `extra` those whose key has fewer rows in `first` than that."""
    counts = first.groupBy(key).agg(F.count("*").alias("_n"))
    late = extra.join(counts, key, "left").filter(F.coalesce("_n", F.lit(0)) < fewer_than).drop("_n")
    return first.unionByName(late, allowMissingColumns=True)


def numbers_confirmed(required: Column, found: Column) -> Column:
    """Whether each of required struct(value, tolerance) has a number in found within its tolerance."""
    return F.forall(required, lambda r: F.exists(found, lambda n: F.abs(n - r["value"]) <= r["tolerance"]))


def first_mismatch(pairs: list[tuple[str, Column, Column]]) -> Column:
    """The name of the first pair that differs (nulls equal nulls), else null."""
    return F.coalesce(*(F.when(~a.eqNullSafe(b), name) for name, a, b in pairs))


def reconciled(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, as (key, side)."""
    return ours.join(theirs, key, "left_anti").select(key, F.lit("missing").alias("side")).unionByName(theirs.join(ours, key, "left_anti").select(key, F.lit("extra").alias("side")))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key isn't null and isn't in parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def overlaid(base: DataFrame, decisions: DataFrame, key: str, order: list, fields: list[str], drops: tuple[str, ...] = ("flag",)) -> DataFrame:
    """base with its latest decision's non-null fields before its own; a verdict in `drops` nulls them.

    decisions: key, verdict and the fields as `new_<field>`.
    """
    joined = with_latest(base, decisions, [key], order)
    out = F.coalesce(F.col("verdict").isin(*drops), F.lit(False))
    return joined.withColumns({f: F.when(~out, F.coalesce(F.col(f"new_{f}"), F.col(f))) for f in fields}).drop(*(f"new_{f}" for f in fields))


def kept_edits(fresh: DataFrame, old: DataFrame, key: str, editable: list[str]) -> DataFrame:
    """fresh rows, but with old non-blank values of editable columns."""
    held = old.select(key, *(F.col(c).alias(f"_old_{c}") for c in editable))
    joined = fresh.join(held, key, "left")
    return joined.withColumns({c: F.coalesce(F.when(F.trim(F.col(f"_old_{c}")) != "", F.col(f"_old_{c}")), F.col(c)) for c in editable}).select(*fresh.columns)


def first_listed(df: DataFrame, array: str, lookup: DataFrame, key: str, tag: str) -> DataFrame:
    """df with the lookup row of the first array element that has one."""
    probes = df.select(tag, F.posexplode(array).alias("_pos", key)).join(lookup, key)
    return df.join(top_k(probes, [tag], ["_pos"]).drop("_pos"), tag, "left")


def overlapping(df: DataFrame, array: str, ids: DataFrame, key: str, tag: str) -> DataFrame:
    """Rows of df whose array shares an element with ids, once each."""
    hits = df.select(tag, F.explode(array).alias(key)).join(ids.select(key).distinct(), key, "left_semi").select(tag).distinct()
    return df.join(hits, tag, "left_semi")


def same_place(chosen: DataFrame, places: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The ids of all places that equal a chosen one in keys; null equals null."""
    want, n = chosen.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct(), len(keys)
    cond = [F.col(keys[i]).eqNullSafe(F.col(f"_{keys[i]}")) for i in range(n)]
    return places.join(want, cond, "left_semi").select(id_col, *keys)


def siblings(df: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """Each row with the ids of the other rows of its group, in order; rows alone, or with a null in their group, have none. Groups are gathered once, not paired."""
    every = df.groupBy(*group).agg(F.sort_array(F.collect_set(id_col)).alias("siblings"))
    others = F.array_remove("siblings", F.col(id_col))
    return df.join(every, group, "left").withColumn("siblings", F.coalesce(others, F.array().cast(df.select(F.array(id_col)).schema[0].dataType)))


def with_each_latest(left: DataFrame, sides: dict[str, tuple[DataFrame, list]], key: str) -> DataFrame:
    """left with, of each side, the first row of its key by an order; columns get the side's name in front."""
    for name, (right, order) in sides.items():
        best = top_k(right, [key], order)
        left = left.join(best.select(key, *(F.col(c).alias(f"{name}_{c}") for c in best.columns if c != key)), key, "left")
    return left


def split_by(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with `found`: whether its key is in right."""
    known = right.select(key).distinct().withColumn("found", F.lit(True))
    return left.join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_national(rows: DataFrame, national: DataFrame, year: str, count: str) -> DataFrame:
    """Rows whose count is 0 count 1 in years that `national` has."""
    years = national.select(year).distinct().withColumn("_national", F.lit(1))
    return rows.join(years, year, "left").withColumn(count, F.when((F.col(count) == 0) & F.col("_national").isNotNull(), 1).otherwise(F.col(count))).drop("_national")


def by_indexes(gaps: DataFrame, key: str, indexes: list[tuple[DataFrame, list[str]]], last: tuple[DataFrame, list[str]], fewer_than: int, source: str) -> DataFrame:
    """(key, source, via): sources of each gap by every index in turn, the first that has it counts; those of `last` only for gaps of fewer than that."""
    found = None
    for via, (right, on) in enumerate(indexes):
        part = gaps.join(right, on).select(key, source, F.lit(via).alias("via"))
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(key, source).agg(F.min("via").alias("via"))
    counts = found.groupBy(key).agg(F.count("*").alias("_n"))
    few = gaps.join(counts, key, "left").filter(F.coalesce("_n", F.lit(0)) < fewer_than).drop("_n")
    more = few.join(last[0], last[1]).select(key, source, F.lit(len(indexes)).alias("via")).join(found, [key, source], "left_anti")
    return found.unionByName(more.distinct())


def first_scoped(rows: DataFrame, tracks: DataFrame, key: str, id_col: str, scopes: list[Column], order: list, *, both: bool = False) -> DataFrame:
    """Each row with the first track of its key by the first scope condition that holds; a row that none fits keeps null.

    Scopes and order read the tracks' columns, so tracks are ranked by key before they meet the rows. With `both` they may read
    the rows' columns, too: then each row meets all tracks of its key, and id_col identifies rows.
    """
    scope = F.coalesce(*(F.when(c, i) for i, c in enumerate(scopes)))
    extra = [c for c in tracks.columns if c != key]
    if not both:
        best = top_k(tracks.withColumn("scope", scope).filter("scope is not null"), [key], ["scope", *order])
        return rows.join(best.select(key, "scope", *extra), key, "left")
    best = top_k(rows.join(tracks, key).withColumn("scope", scope).filter("scope is not null"), [id_col], ["scope", *order])
    return rows.join(best.select(id_col, "scope", *extra), id_col, "left")
