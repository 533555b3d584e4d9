"""Orders of listings: columns for orderBy, total by an id at the end, with the placement of nulls stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in(value: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a list, the list's length if it isn't there."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1, F.lit(len(order)))


def by_gap(gap: str, id_col: str) -> list[Column]:
    return [F.desc_nulls_last(gap), F.asc(id_col)]


def by_priority_or_last(priority: str, name: str, id_col: str) -> list[Column]:
    """Priority descending, none as -1."""
    return [F.desc(F.coalesce(priority, F.lit(-1))), F.asc(name), F.asc(id_col)]


def by_saved(priority: str, saved_at: str, id_col: str) -> list[Column]:
    """Priority ascending, nulls last as in SQL databases, then the latest."""
    return [F.asc_nulls_last(priority), F.desc(saved_at), F.asc(id_col)]


def by_created(created_at: str, id_col: str) -> list[Column]:
    return [F.asc(created_at), F.asc(id_col)]


def by_readiness(tier: Column, readiness: Column, display: str, names: list[str], id_col: str) -> list[Column]:
    return [tier.asc(), readiness.desc(), F.asc(display), *map(F.asc, names), F.asc(id_col)]


def by_gap_action(tier: str, tiers: tuple[str, ...], score: str, year: str, name: str, flag: str) -> list[Column]:
    return [rank_in(F.col(tier), tiers).asc(), F.desc(score), F.desc(year), F.asc(name), F.asc(flag)]


def by_series(years: str, rows: str, names: list[str]) -> list[Column]:
    return [F.desc(years), F.desc(rows), *map(F.asc, names)]


def by_draft(bucket: Column, year: str, name: str, priority: str, id_col: str) -> list[Column]:
    return [bucket.asc(), F.desc(year), F.asc(name), F.desc(priority), F.asc(id_col)]


def collated(name: str, language: str = "ko") -> Column:
    """A name as the language sorts it: for Korean, Hangul before Latin letters, without regard to code points."""
    return F.collate(F.col(name), language)


def by_unit(tier: Column, readiness: Column, display: str, names: list[str], id_col: str) -> list[Column]:
    """Tier, readiness, display order, then the names as Korean sorts them; the id decides where these are equal."""
    return [tier.asc(), readiness.asc(), F.asc(display), *(collated(n).asc() for n in names), F.asc(id_col)]


def by_match(match: str, tier: Column, display: str, name: str, id_col: str) -> list[Column]:
    return [F.asc(match), tier.asc(), F.asc(display), collated(name).asc(), F.asc(id_col)]


def cut(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows with their rank from 1. The limit is taken in tasks first; only what is left is ranked in one place."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
