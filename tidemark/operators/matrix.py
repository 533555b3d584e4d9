"""Cells of (entity, period) filled from many sources in one shuffle.

Instead of a join for each counter, every source becomes tagged rows of (entity,
period, its counters, its marks, its best candidate), the scaffold of all cells is one
more source, and a single aggregate by (entity, period) brings them together. Tasks
aggregate before the shuffle, so a hot cell travels once a task, and no counter joins
anything. Rows outside the scaffold are dropped after the aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Source:
    """Rows of one source. period: an integer column or an array of integers; a row counts once in each different one.

    counters: name to a condition (None: every row). marks: name to (value, domain): values of a small fixed domain, listed
    by number of rows, the most frequent first. best: name to (order, value): the value of the smallest order stays.
    """

    rows: DataFrame
    entity: Column
    period: Column
    counters: dict[str, Column | None] = field(default_factory=dict)
    marks: dict[str, tuple[Column, tuple[str, ...]]] = field(default_factory=dict)
    best: dict[str, tuple[Column, Column]] = field(default_factory=dict)


def matrix(scaffold: DataFrame, entity: str, period: str, sources: list[Source]) -> DataFrame:
    """One row per (entity, period) of the scaffold: its other columns, all counters (0 if none), marks as lists and the best values.

    Several sources may add to one counter, mark or best. Ties of marks go by the domain's order, of bests by the value.
    """
    counters = list(dict.fromkeys(c for s in sources for c in s.counters))
    domains = {m: d for s in sources for m, (_, d) in s.marks.items()}
    bests = list(dict.fromkeys(b for s in sources for b in s.best))
    kept = [c for c in scaffold.columns if c not in (entity, period)]

    def tagged(s: Source) -> DataFrame:
        own = s.period if dict(s.rows.select(s.period.alias("p")).dtypes)["p"].startswith("array") else F.array(s.period)
        count = lambda c: F.lit(0) if c not in s.counters else F.lit(1) if s.counters[c] is None else F.when(s.counters[c], 1).otherwise(0)
        parts = [s.entity.alias("_e"), F.array_distinct(own).alias("_p"), *(count(c).alias(c) for c in counters)]
        parts += [s.marks[m][0].alias(f"_m_{m}") for m in s.marks] + [F.struct(o.alias("o"), v.alias("v")).alias(f"_b_{b}") for b, (o, v) in s.best.items()]
        return s.rows.select(*parts).withColumn("_p", F.explode("_p")).filter("_e is not null and _p is not null")

    cells = scaffold.select(F.col(entity).alias("_e"), F.col(period).alias("_p"), F.struct(F.lit(1).alias("_there"), *kept).alias("_cell"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [cells, *map(tagged, sources)])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    of_mark = [F.count_if(F.col(f"_m_{m}") == v).alias(f"_n_{m}_{i}") for m, d in domains.items() for i, v in enumerate(d)]
    found = rows.groupBy("_e", "_p").agg(F.max("_cell").alias("_cell"), *sums, *of_mark, *(F.min(F.when(F.col(f"_b_{b}")["o"].isNotNull(), F.col(f"_b_{b}"))).alias(f"_b_{b}") for b in bests))

    def listed(m: str) -> Column:
        held = F.array_compact(F.array(*(F.when(F.col(f"_n_{m}_{i}") > 0, F.struct((-F.col(f"_n_{m}_{i}")).alias("n"), F.lit(i).alias("i"), F.lit(v).alias("v"))) for i, v in enumerate(domains[m]))))
        return F.transform(F.array_sort(held), lambda x: x["v"])

    return found.filter("_cell is not null").select(
        F.col("_e").alias(entity), F.col("_p").alias(period), *(F.col("_cell")[c].alias(c) for c in kept), *counters, *(listed(m).alias(m) for m in domains), *(F.col(f"_b_{b}")["v"].alias(b) for b in bests)
    )


def filled(cells: DataFrame, period: str, counter: str, periods: DataFrame, into: str) -> DataFrame:
    """Cells whose counter is 0 get one where their period is among `periods` (at most as many rows as there are periods); `into` tells which."""
    known = F.broadcast(periods.select(F.col(period)).distinct().withColumn("_filled", F.lit(True)))
    gets = F.col("_filled").isNotNull() & (F.col(counter) == 0)
    return cells.join(known, period, "left").withColumn(into, F.when(gets, 1).otherwise(0)).withColumn(counter, F.col(counter) + F.col(into)).drop("_filled")
