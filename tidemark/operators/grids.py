"""Sheets with several blocks under one another: each data row is read by the header above it.

A sheet's rows have a sheet id, a row number and an array of cells. A header row names
the blocks that begin in it, (column, name) each; the header is carried down the sheet
to the next one or to a stop row, and each data row is unpivoted by its own header, so
blocks of one sheet may differ in number, width and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = "array<struct<col:int,name:string>>"


def cell(cells: Column, col: Column | int) -> Column:
    """The trimmed cell at a column from 0; null where the row is shorter or the cell is blank."""
    return F.nullif(F.trim(F.try_element_at(cells, (F.lit(col) if isinstance(col, int) else col) + 1)), F.lit(""))


def named_columns(cells: Column, start: int = 1) -> Column:
    """BLOCKS of a header row whose names stand above their columns: the columns from `start` on that have a name."""
    every = F.transform(cells, lambda x, i: F.struct(i.cast("int").alias("col"), F.trim(x).alias("name")))
    return F.filter(every, lambda b: (b["col"] >= start) & (b["name"] != ""))


def marked_columns(cells: Column, mark: str, follower: str, names: Column) -> Column:
    """BLOCKS of a header row whose blocks begin with `mark`, followed by `follower`; their names stand in the same columns of `names`, the row above."""
    every = F.transform(cells, lambda x, i: F.struct(i.cast("int").alias("col"), cell(names, i.cast("int")).alias("name"), (F.trim(x) == mark).alias("own"), F.coalesce(cell(cells, i.cast("int") + 1) == follower, F.lit(False)).alias("next")))
    held = F.filter(every, lambda b: b["own"] & b["next"])
    return F.transform(held, lambda b: F.struct(b["col"].alias("col"), b["name"].alias("name")))


def blocks(rows: DataFrame, sheet: str, row: str, header: Column, stop: Column) -> DataFrame:
    """Data rows with `header_row` and one of their header's blocks (`col`, `name`): a row for each block with a name.

    header: BLOCKS on header rows, null on others. stop: whether what follows belongs to no header until the next one; a
    header isn't a stop. Headers and stop rows themselves are gone, as are rows above the first header.
    """
    own = header.cast(BLOCKS)
    state = F.when(own.isNotNull(), F.struct(F.col(row).alias("row"), own.alias("blocks"))).when(F.coalesce(stop, F.lit(False)), F.struct(F.lit(None).cast("long").alias("row"), F.lit(None).cast(BLOCKS).alias("blocks")))
    marked = rows.withColumn("_state", state)
    above = Window.partitionBy(sheet).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.withColumn("_h", F.last("_state", ignorenulls=True).over(above)).filter(F.col("_state").isNull() & F.col("_h.row").isNotNull())
    return carried.withColumn("_b", F.explode("_h.blocks")).filter("_b.name is not null and _b.name <> ''").select(*rows.columns, F.col("_h.row").alias("header_row"), "_b.col", "_b.name")


def with_row_above(rows: DataFrame, sheet: str, row: str, cells: str, into: str = "above") -> DataFrame:
    return rows.withColumn(into, F.lag(cells).over(Window.partitionBy(sheet).orderBy(row)))


def whole(text: Column) -> Column:
    """A whole number, thousands' commas left out; null if it isn't one."""
    return F.regexp_replace(text, ",", "").try_cast("int")


def grade_cuts(rows: DataFrame, sheet: str, row: str, cells: str, label: str) -> DataFrame:
    """(sheet, row, header_row, name, grade, cut, takers, ratio): of rows that begin with a grade of 1 to 9 under a header that begins with `label`, what stands under each name and in the two columns after it, unless all three are blank."""
    c = F.col(cells)
    first = F.coalesce(cell(c, 0), F.lit(""))
    header = F.when((first == label) & (F.size(named_columns(c)) > 0), named_columns(c))
    found = blocks(rows, sheet, row, header, first == label).withColumn("grade", whole(cell(c, 0))).filter("grade between 1 and 9")
    parts = [cell(c, F.col("col") + i).alias(n) for i, n in enumerate(("cut", "takers", "ratio"))]
    return found.select(sheet, row, "header_row", "name", "grade", *parts).filter("cut is not null or takers is not null or ratio is not null").withColumns({"takers": whole(F.col("takers")), "ratio": F.col("ratio").try_cast("double")})


def distributions(rows: DataFrame, sheet: str, row: str, cells: str, mark: str, follower: str, total: str) -> DataFrame:
    """(sheet, row, name, score, first, second, both, running): of rows under blocks that begin with `mark` and `follower`, the whole numbers from the block's column on. A row that begins with `total`, is blank, or has a mark ends the blocks."""
    c = F.col(cells)
    up = with_row_above(rows, sheet, row, cells)
    found = marked_columns(c, mark, follower, F.col("above"))
    has_mark, blank = F.exists(c, lambda x: F.trim(x) == mark), ~F.exists(c, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    held = blocks(up, sheet, row, F.when(F.size(found) > 0, found), has_mark | blank | (F.coalesce(cell(c, 0), F.lit("")) == total))
    return held.select(sheet, row, "name", *(whole(cell(c, F.col("col") + i)).alias(n) for i, n in enumerate(("score", "first", "second", "both", "running")))).filter("score is not null")
