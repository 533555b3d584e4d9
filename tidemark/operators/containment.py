"""Joins on containment: short texts that stand inside long ones, and numbers that must stand there too.

An inverted index instead of a nested loop: each needle offers its grams of one length
in UTF-8 bytes, each text its different grams of the lengths in use; of a needle's grams the
one that fewest texts hold makes the candidates, and `contains` decides. A needle with a
gram that no text holds has none. Needles are different ones, so that a name that many
rows share is looked up once.

A text's grams are looked up in a table of bits of the grams asked for, of at most
2 ** MOST_BITS bits, so that those that nobody asks for are not made rows. Texts stay
where they are if the grams and needles, by their counted sizes, are below
BROADCAST_BYTES and so are broadcast; beyond that ids and grams are shuffled and joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from tidemark.functions.text import compact

#: Lengths in bytes of grams for needles that are at least as long, at most 7; a shorter needle is a gram itself.
SIZES = (3, 7)
#: Bits of the table of grams, at least and at most; in between 16 or more a gram.
LEAST_BITS, MOST_BITS = 16, 25
#: Places of a text that are looked at together.
PLACES = 1 << 17
BROADCAST_BYTES = 32 << 20
NUMBER = r"-?\d+(?:\.\d+)?"


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, null ones empty, and where each starts and the last one ends."""
    texts = pa.array(texts.cast(pa.large_string()).fill_null(""))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def _codes(raw: np.ndarray, size: int) -> np.ndarray:
    """The gram of `size` bytes from each place but the last 8: its bytes, and its size above them."""
    places = np.ndarray(len(raw) - 8, dtype="<u8", buffer=raw, strides=(1,))
    return places & np.uint64((1 << 8 * size) - 1) | np.uint64(size << 56)


def _place(codes: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each gram in a table of 2 ** bits."""
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _grams(texts: pa.Array, sizes: list[int], asked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram): the different grams of each text, in order; those that `asked`, a table of bits, may have, or if None those of the size that a needle offers."""
    raw, offsets = _buffer(texts)
    own = np.diff(offsets)
    offered = np.minimum(own, SIZES[0])
    for s in SIZES[1:]:
        offered[own >= s] = s
    rows, grams = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for lo in range(0, len(raw), PLACES):
        part = np.zeros(min(PLACES, len(raw) - lo) + 8, dtype=np.uint8)
        there = raw[lo : lo + len(part)]
        part[: len(there)] = there
        for size in sizes:
            codes = _codes(part, size)
            if asked is None:
                at = np.arange(len(codes))
            else:
                bit = _place(codes, len(asked).bit_length() + 2)
                at = np.flatnonzero(asked[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            row = np.searchsorted(offsets, lo + at, "right") - 1
            keep = lo + at + size <= offsets[row + 1]
            if asked is None:
                keep &= offered[row] == size
            rows.append(row[keep])
            grams.append(codes[at[keep]])
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new].view(np.int64)


def _listed(sizes: list[int], asked: np.ndarray | None = None):
    """The rows with their grams as a further column; the text is the last column before."""

    def run(batches):
        for batch in batches:
            row, gram = _grams(batch.column(batch.num_columns - 1), sizes, asked)
            cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(gram))], names=[*batch.schema.names, "gs"])

    return run


def _counted(sizes: list[int], asked: np.ndarray):
    """Of the texts of a batch: each gram and how many hold it."""

    def run(batches):
        for batch in batches:
            gram, c = np.unique(_grams(batch.column(0), sizes, asked)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(c, pa.int64())], names=["g", "c"])

    return run


def _marked(bits: int):
    """The bytes of the table of bits that have one of the grams."""

    def run(batches):
        for batch in batches:
            bit = _place(batch.column(0).to_numpy().astype(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(3)).astype(np.int32)), pa.array(np.left_shift(1, (bit & np.uint64(7)).astype(np.int32), dtype=np.int32))], names=["at", "m"])

    return run


def _table(asked: DataFrame, count: int) -> np.ndarray:
    """The table of bits of the grams."""
    bits = min(max(LEAST_BITS, (16 * count).bit_length()), MOST_BITS)
    marks = asked.mapInArrow(_marked(bits), "at int, m int").groupBy("at").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    out[marks.column("at").to_numpy()] = marks.column("m").to_numpy()
    return out


def contained(texts: DataFrame, needles: DataFrame, *, key: str, text: str = "text", needle: str = "needle", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, needle): the texts, by their unique key, and the different needles that stand in them. Empty needles and nulls stand nowhere.

    keep: further columns of the texts that the rows have too.
    """
    with_grams = lambda df: StructType([*df.schema.fields]).add("gs", ArrayType(LongType()))
    t = texts.select(F.col(key).alias("k"), *keep, F.col(text).alias("t"))
    n = needles.select(F.col(needle).alias("n")).filter("n <> ''").distinct()
    offers = n.mapInArrow(_listed([*range(1, SIZES[0]), *SIZES]), with_grams(n)).select("n", F.size("gs").alias("of"), F.explode("gs").alias("g"))
    asked = offers.groupBy("g").agg(F.sum((F.octet_length("n") + 64) / F.col("of")).alias("bytes"))
    count, size, sizes = asked.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.collect_set(F.shiftright("g", 56))).first()
    sizes, table = sorted(sizes), _table(asked.select("g"), count)
    # what is counted of texts has at most as many rows as grams are asked for
    few = count * 64 <= BROADCAST_BYTES
    sent = F.broadcast if few else lambda df: df
    often = t.select("t").mapInArrow(_counted(sizes, table), "g long, c long").join(sent(asked.select("g")), "g", "left_semi").groupBy("g").agg(F.sum("c").alias("c"))
    rarest = offers.join(sent(often), "g", "left").groupBy("n").agg(F.count_if(F.col("c").isNull()).alias("gone"), F.min(F.struct("c", "g"))["g"].alias("g")).filter("gone = 0").select("n", "g")
    held = t.mapInArrow(_listed(sizes, table), with_grams(t))
    if few and size <= BROADCAST_BYTES:
        pairs = held.select("k", *keep, "t", F.explode("gs").alias("g")).join(F.broadcast(rarest), "g")
    else:
        pairs = rarest.join(held.select("k", F.explode("gs").alias("g")), "g").join(t, "k")
    return pairs.filter(F.contains("t", "n")).select(F.col("k").alias(key), F.col("n").alias(needle), *keep)


def numbers(text: Column) -> Column:
    """All numbers of a text, thousands' commas left out."""
    return F.transform(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(f"({NUMBER})")), lambda x: x.cast("double"))


def required(fields: dict[str, tuple[Column, float | Column]]) -> Column:
    """Array of struct(field, value, tolerance) of the fields (value, tolerance) that have a value."""
    rows = (F.when(v.isNotNull(), F.struct(F.lit(n).alias("field"), v.cast("double").alias("value"), (t if isinstance(t, Column) else F.lit(t)).cast("double").alias("tolerance"))) for n, (v, t) in fields.items())
    return F.array_compact(F.array(*rows))


def _step(value: Column, width: Column) -> Column:
    """The step of `width` that a number lies in, from -10 ** 15 to 10 ** 15."""
    return F.floor(F.greatest(F.least(F.nanvl(value / width, F.lit(0.0)), F.lit(1e15)), F.lit(-1e15)))


def _steps(wanted: DataFrame) -> DataFrame:
    """Of each name's requirements, those that may be near a number of a step: (_n, _width, _steps: map of step to array of struct(place, field, value, tolerance)).

    A step is at least twice as wide as any tolerance, so that a requirement lies in few of them.
    """
    width = F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform("_wanted", lambda r: r["tolerance"])) * 2, F.lit(1.0)))
    single = wanted.withColumn("_width", width).select("_n", "_width", F.posexplode("_wanted").alias("place", "r"))
    # a little more on each side, as it is the rounded distance that is compared
    reach = F.col("r")["tolerance"] * (1 + 1e-9) + F.abs(F.col("r")["value"]) * 1e-15
    first, last = _step(F.col("r")["value"] - reach, F.col("_width")), _step(F.col("r")["value"] + reach, F.col("_width"))
    placed = single.select("_n", "_width", F.struct((F.col("place") + 1).alias("place"), *(F.col("r")[f].alias(f) for f in ("field", "value", "tolerance"))).alias("r"), F.explode(F.sequence(first, last)).alias("step"))
    lists = placed.groupBy("_n", "_width", "step").agg(F.collect_list("r").alias("rs"))
    return lists.groupBy("_n", "_width").agg(F.map_from_entries(F.collect_list(F.struct("step", "rs"))).alias("_steps"))


def hits(steps: Column, width: Column, found: Column) -> Column:
    """Sets of at most one requirement a field, sorted by field, that have near enough numbers in `found`: each as the requirements' places, from 1."""
    close = lambda x: F.filter(F.coalesce(F.try_element_at(steps, _step(x, width)), F.array()), lambda r: F.abs(x - r["value"]) <= r["tolerance"])
    near = F.sort_array(F.array_distinct(F.transform(F.flatten(F.transform(found, close)), lambda r: F.struct(r["place"].alias("place"), r["field"].alias("field")))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("last"), F.lit("").alias("key")))
    more = lambda sets, r: F.transform(F.filter(sets, lambda s: ~s["last"].eqNullSafe(r["field"])), lambda s: F.struct(r["field"].alias("last"), F.concat(s["key"], r["place"].cast("string"), F.lit(",")).alias("key")))
    return F.transform(F.aggregate(near, none, lambda sets, r: F.concat(sets, more(sets, r))), lambda s: s["key"])


def _subset(at: Column, mask: Column) -> Column:
    """The key, as of `hits`, of the places whose bit is set."""
    return F.array_join(F.transform(F.array_sort(F.filter(at, lambda _, i: F.getbit(mask, i) == 1)), lambda x: F.concat(x.cast("string"), F.lit(","))), "")


def _exactly(counts: Column, mask: Column) -> Column:
    """Rows that meet these requirements and no other, from the rows that meet at least those of each mask (by place)."""
    more = F.filter(F.transform(counts, lambda c, i: F.struct(c.alias("c"), i.cast("long").alias("m"))), lambda x: x["m"].bitwiseAND(mask) == mask)
    return F.aggregate(more, F.lit(0).cast("long"), lambda t, x: t + F.when(F.bit_count(x["m"].bitwiseXOR(mask)) % 2 == 1, -x["c"]).otherwise(x["c"]))


def verified(outcomes: DataFrame, rows: DataFrame, *, key: str, name: str = "name", group: str = "group", needed: str = "needed", text: str = "row_text") -> DataFrame:
    """One row per outcome: (key, status, matched_rows, lacking), from rows whose compact text contains the outcome's compact name and whose text its group, if it has one.

    status: missing_unit_name, unit_not_in_source_row, group_not_in_source_row, missing_required_values, matched or
    source_row_values_missing; lacking is then the most frequent set of fields without a number (the first in order on ties).
    Equal texts are read once and count as often as they occur. Texts and outcomes of a name never meet: texts are counted by their
    different numbers and the groups they have, those by the sets of the name's requirements that they meet, and an outcome looks up
    the sets of its own (2 to the number of its fields).
    """
    own = outcomes.select(key, compact(F.coalesce(F.col(name), F.lit(""))).alias("_n"), F.coalesce(F.col(group), F.lit("")).alias("_g"), F.col(needed).alias("_needed"))
    # texts are read twice; with the count needed by both, the shuffle is done once
    sheet = rows.groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("_rows")).filter("_text is not null and _rows > 0").withColumn("_t", compact(F.col("_text")))
    sheet = sheet.withColumn("_numbers", F.sort_array(F.array_distinct(numbers(F.col("_text")))))
    # outcomes that ask for the same are asked once
    asked = own.filter("_n <> ''").select("_n", "_g", "_needed").distinct()
    # a requirement's place is that in the sorted list of its name's; all rows of a name have the group ''
    wanted = asked.groupBy("_n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_needed")))).alias("_wanted"), F.array_sort(F.array_union(F.collect_set("_g"), F.array(F.lit("")))).alias("_groups"))
    group_bytes, step_bytes = F.octet_length("_n") + F.octet_length(F.array_join("_groups", "")) + 32 * F.size("_groups") + 64, 256 * F.size("_wanted") + 64
    sizes = wanted.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (group_bytes, step_bytes))).first()
    sent = lambda df, size: F.broadcast(df) if size <= BROADCAST_BYTES else df
    pairs = contained(sheet, own, key="_text", text="_t", needle="_n", keep=("_rows", "_numbers")).join(sent(wanted.select("_n", "_groups"), sizes[0]), "_n")
    alike = pairs.select("_n", "_rows", "_numbers", F.filter("_groups", lambda g: (g == "") | F.contains("_text", g)).alias("_gs")).groupBy("_n", "_gs", "_numbers").agg(F.sum("_rows").alias("_rows"))
    met = alike.join(sent(_steps(wanted), sizes[1]), "_n", "left").select("_n", "_rows", "_gs", F.when(F.col("_steps").isNull(), F.array(F.lit(""))).otherwise(hits(F.col("_steps"), F.col("_width"), F.col("_numbers"))).alias("_sets"))
    # explode_outer, as the optimizer adds a filter by the whole array before explode, which makes the sets again; none is empty
    by_set = met.select("_n", "_rows", F.explode_outer("_gs").alias("_of"), "_sets").select("_n", "_rows", "_of", F.explode_outer("_sets").alias("_set")).groupBy("_n", "_of", "_set").agg(F.sum("_rows").alias("_c"))
    # the mask -1 stands for all rows of the name
    masks = F.sequence(F.lit(-1).cast("long"), F.pow(F.lit(2), F.size("_needed")).cast("long") - 1)
    looked = asked.join(wanted.select("_n", "_wanted"), "_n").withColumn("_at", F.transform("_needed", lambda r: F.array_position(F.col("_wanted"), r))).select("_n", "_g", "_needed", "_at", F.explode(masks).alias("_m"))
    all_rows = F.col("_m") < 0
    looked = looked.withColumns({"_of": F.when(all_rows, "").otherwise(F.col("_g")), "_set": F.when(all_rows, "").otherwise(_subset(F.col("_at"), F.col("_m")))}).join(by_set, ["_n", "_of", "_set"], "left")
    counts = looked.groupBy("_n", "_g", "_needed").agg(F.transform(F.array_sort(F.collect_list(F.struct("_m", F.coalesce("_c", F.lit(0)).alias("c")))), lambda x: x["c"]).alias("_of_masks"))
    counts = counts.select("_n", "_g", "_needed", (F.get("_of_masks", F.lit(0)) > 0).alias("_there"), F.slice("_of_masks", 2, F.size("_of_masks") - 1).alias("_counts"))
    every = F.size("_counts").cast("long") - 1
    lacks = lambda m: F.array_join(F.transform(F.filter("_needed", lambda _, i: F.getbit(m, i) == 0), lambda r: r["field"]), "|")
    exact = F.transform(F.sequence(F.lit(0).cast("long"), every), lambda m: F.struct((-_exactly(F.col("_counts"), m)).alias("c"), lacks(m).alias("l"), m.alias("m")))
    found = counts.withColumn("_exact", F.filter(exact, lambda x: x["c"] < 0)).select(
        "_n",
        "_g",
        "_needed",
        F.when(F.col("_there"), F.get("_counts", F.lit(0)) > 0).alias("_grouped"),
        F.get(F.filter("_exact", lambda x: x["m"] == every), F.lit(0))["c"].alias("_all"),
        F.array_min(F.filter("_exact", lambda x: x["m"] < every))["l"].alias("_worst"),
    )
    found = found.withColumn("matched_rows", -F.col("_all"))
    status = (
        F.when(F.col("_n") == "", "missing_unit_name")
        .when(F.col("_grouped").isNull(), "unit_not_in_source_row")
        .when(~F.col("_grouped"), "group_not_in_source_row")
        .when(F.size("_needed") == 0, "missing_required_values")
        .when(F.col("matched_rows").isNotNull(), "matched")
        .otherwise("source_row_values_missing")
    )
    out = own.join(found.drop("_all"), ["_n", "_g", "_needed"], "left").withColumn("status", status)
    return out.select(key, "status", F.when(F.col("status") == "matched", F.col("matched_rows")).alias("matched_rows"), F.when(F.col("status") == "source_row_values_missing", F.col("_worst")).alias("lacking"))
