"""Unions and differences of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def united(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def superseded(old: DataFrame, new: DataFrame, target: str, reviewer: str) -> DataFrame:
    """old without the rows whose target or whose reviewer has new ones, and new."""
    left = old.join(new.select(target).distinct(), target, "left_anti").join(new.select(reviewer).distinct(), reviewer, "left_anti")
    return left.select(*old.columns).unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed insert or update: rows of new replace those of old."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)
