"""Sources and sinks: delimited files, JSON lines, HTML tables, upserts, partition overwrites and manifests."""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sets import upserted


def read_csv(spark: SparkSession, path: str, *, blank_as: str | None = "") -> DataFrame:
    """All columns as text: quoted cells, doubled quotes, line feeds in cells; a byte-order mark leaves the first header; missing cells read blank_as."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return df if blank_as is None else df.fillna(blank_as)


def typed(df: DataFrame, schema: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows with `problems`): trimmed cells, empty ones null; a filled cell that doesn't cast rejects its row."""
    cell = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in schema}
    value = {c: (F.when(F.lower(cell[c]).isin("true", "1", "yes", "y"), True).when(F.lower(cell[c]).isin("false", "0", "no", "n"), False) if t == "boolean" else cell[c].try_cast(t)) for c, t in schema.items()}
    problems = F.array_compact(F.array(*(F.when(cell[c].isNotNull() & value[c].isNull(), c) for c in schema)))
    marked = df.withColumn("problems", problems)
    return marked.filter(F.size("problems") == 0).select(*(value[c].alias(c) for c in schema)), marked.filter(F.size("problems") > 0)


def aliased(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """One column per name: the first non-null of its spellings that the table has."""
    return df.select(*(F.coalesce(*(F.col(a) for a in spellings if a in df.columns), F.lit(None)).alias(name) for name, spellings in names.items()))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def snake(name: str) -> str:
    """camelCase to snake_case, other characters to `_`."""
    return re.sub(r"\W+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).strip("_").lower()


def renamed(df: DataFrame) -> DataFrame:
    """Columns in snake case; a name that occurs again gets _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = snake(c) or "column"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*out)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A fixed list of columns; nested ones as JSON, nulls as empty cells."""
    nested = lambda c: dict(df.dtypes)[c].startswith(("array", "struct", "map"))
    df.select(*(F.coalesce((F.to_json(c) if nested(c) else F.col(c).cast("string")), F.lit("")).alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def upsert(target: str, new: DataFrame, keys: list[str], staged: str) -> None:
    """Keyed insert or update of a Parquet folder: written aside, then put in place by two renames.

    What the folder held moves to `<staged>-before` first, and back if the second rename fails; a call that finds the target
    gone and that folder there puts it back before it begins. Readers that must never find the target gone follow
    tidemark.sources.versions.upsert, which changes one pointer.
    """
    spark = new.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    before = path(f"{staged.rstrip('/')}-before")
    if fs.exists(before):
        if fs.exists(path(target)):
            fs.delete(before, True)
        else:
            fs.rename(before, path(target))
    upserted(spark.read.parquet(target), new, keys).write.mode("overwrite").parquet(staged)
    if not fs.rename(path(target), before):
        raise OSError(f"{target} can't be moved aside")
    if not fs.rename(path(staged), path(target)):
        fs.rename(before, path(target))
        raise OSError(f"{staged} can't be put in place")
    fs.delete(before, True)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """path, bytes and sha256 of the files of a pattern."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def summary(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n): rows by each dimension alone."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("x"))
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


_TAG = re.compile(r"<(/?)(table|tr|t[dh])\b([^>]*)>", re.I)


def _grids(markup: str) -> Iterator[tuple[int, int, int, str]]:
    """(table, row, column, text) of flat tables; row and column spans repeat their cell."""
    table, row, column, held, start, span = -1, -1, 0, {}, None, (1, 1)
    for tag in _TAG.finditer(markup):
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if start is not None and (name != "table" or closing):
            text = re.sub(r"\s+", " ", html_module.unescape(re.sub(r"<[^>]*>", " ", markup[start : tag.start()]))).strip()
            while (row, column) in held:
                column += 1
            for y in range(span[0]):
                for x in range(span[1]):
                    held[row + y, column + x] = text
            start, column = None, column + span[1]
        if name == "table":
            if held:
                yield from ((table, y, x, t) for (y, x), t in sorted(held.items()))
            held, row = {}, -1
            table += not closing
        elif name == "tr" and not closing:
            row, column = row + 1, 0
        elif name != "tr" and not closing:
            size = {m[0].lower(): min(int(m[1]), 200) for m in re.findall(r"(row|col)span\s*=\s*[\"']?(\d+)", attributes, re.I)}
            span, start = (max(1, size.get("row", 1)), max(1, size.get("col", 1))), tag.end()
    if held:
        yield from ((table, y, x, t) for (y, x), t in sorted(held.items()))


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """A row per cell of the pages' tables: id, table, row, column, text; spans are expanded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *cell) for i, markup in zip(batch["id"], batch["html"], strict=True) if markup for cell in _grids(markup)]
            yield pd.DataFrame(rows, columns=["id", "table", "row", "column", "text"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kind}, table int, row int, column int, text string")


def table_role(section: Column, content: Column, roles: dict[str, tuple[str, ...]]) -> Column:
    """The first role one of whose words stands in a table's section or content, else `other`."""
    out = F.lit("other")
    for role, words in reversed(roles.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | section.contains(w) | content.contains(w)
        out = F.when(hit, role).otherwise(out)
    return out
