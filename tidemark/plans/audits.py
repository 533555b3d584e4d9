"""Audits: invariants counted where rows pass anyway, and reports of errors, warnings and counts.

`observed` adds the counts to whatever job reads or writes the rows (no job of its
own); `report` makes a one-row table of many tables' invariants, missing references
included: each table is read once for all its invariants.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class AuditFailed(ValueError):
    """The errors, as a list."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass
class Check:
    """How many rows break the rule, and what is said of them; more than `most` is a fault. level: error or warning."""

    name: str
    broken: Column
    message: str
    level: str = "error"
    most: int = 0


@dataclass
class Reference(Check):
    """Rows whose column has no counterpart among the key column of another table; null columns refer to nothing."""

    column: str = ""
    to: DataFrame | None = None
    key: str = ""

    @classmethod
    def of(cls, name: str, column: str, to: DataFrame, key: str, message: str, level: str = "error") -> Reference:
        return cls(name, F.col(f"_has_{name}").isNull() & F.col(column).isNotNull(), message, level, 0, column, to, key)


def measures(checks: list[Check]) -> list[Column]:
    return [F.count_if(F.coalesce(c.broken, F.lit(False))).alias(c.name) for c in checks]


def failures(checks: list[Check], found: dict[str, int]) -> tuple[list[str], list[str]]:
    """(errors, warnings) in the checks' order."""
    said = [(c.level, f"{c.message}: {found[c.name]}") for c in checks if found[c.name] > c.most]
    return [m for level, m in said if level == "error"], [m for level, m in said if level != "error"]


def observed(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, Observation]:
    """df, and what its next action will have counted: rows and each check's rows. See `demand`."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures(checks)), seen


def demand(checks: list[Check], seen: Observation) -> list[str]:
    """After the action: the warnings; AuditFailed with all errors if there are any."""
    errors, warnings = failures(checks, seen.get)
    if errors:
        raise AuditFailed(errors)
    return warnings


def counted(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row: rows and each check's count, in one pass over df; referred keys are joined by their distinct values."""
    for c in checks:
        if isinstance(c, Reference):
            keys = c.to.select(F.col(c.key).alias(c.column), F.lit(True).alias(f"_has_{c.name}")).filter(F.col(c.column).isNotNull()).dropDuplicates([c.column])
            df = df.join(keys, c.column, "left")
    return df.agg(F.count(F.lit(1)).alias("rows"), *measures(checks))


def report(tables: dict[str, tuple[DataFrame, list[Check]]]) -> DataFrame:
    """One row: status, errors, warnings, rows (map by table), invariants (map by check). Messages are in the checks' order."""
    long = []
    for i, (name, (df, checks)) in enumerate(tables.items()):
        entry = lambda place, check, level, message, most, n: F.struct(F.lit(place).alias("place"), F.lit(check).alias("name"), F.lit(level).alias("level"), F.lit(message).alias("message"), F.lit(most).cast("long").alias("most"), F.col(n).alias("n"))
        rows = [entry(1000 * i, name, "rows", "", 0, "rows"), *(entry(1000 * i + j, c.name, c.level, f"{name}: {c.message}", c.most, c.name) for j, c in enumerate(checks, 1))]
        long.append(counted(df, checks).select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    every = reduce(lambda a, b: a.unionByName(b), long)
    told = lambda level: F.transform(F.array_sort(F.collect_list(F.when((F.col("level") == level) & (F.col("n") > F.col("most")), F.struct("place", F.concat("message", F.lit(": "), F.col("n").cast("string")).alias("m"))))), lambda x: x["m"])
    pairs = lambda test: F.map_from_entries(F.array_sort(F.collect_list(F.when(test, F.struct("name", "n")))))
    found = every.agg(told("error").alias("errors"), told("warning").alias("warnings"), pairs(F.col("level") == "rows").alias("rows"), pairs(F.col("level") != "rows").alias("invariants"))
    return found.select(F.when(F.size("errors") == 0, "ok").otherwise("failed").alias("status"), "errors", "warnings", "rows", "invariants")
