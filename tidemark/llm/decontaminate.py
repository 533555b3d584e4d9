"""Benchmark decontamination by spaced seeds.

A mask such as 111011 takes the words under its ones and ignores the others, so
a hit survives a substitution at an ignored place. Every position of every whole
text and item is hashed under each mask, and texts join items on equal hashes. A
hit gives a diagonal (document position minus item position), along which the item
is laid over the text: the longest segment whose score (+1 a match, -4 a
mismatch) is not negative, so that at least 80 % of its words match, is the
overlap, without mismatches at its ends. No such segment has more matches. It
counts if it has `least` matching words, or 80 % of all words of a shorter item.

Masks go by an item's length, so that each overlap that counts holds a hit: with
LONG_MASKS any 13 words with two substitutions, 16 with three, 20 with four; with
SHORT_MASKS any 5 to 9 with one and 10 to 12 with two. Items of fewer words must
stand whole, as 80 % of them is all of them.

1. Items become rows of seeds, and their hashes a Bloom filter of at most
   2**MOST_BITS bits, built by tasks, that lets most positions of a text go at
   once. It only saves work: past its size more positions travel.
2. Texts are cut into blocks of word positions, with as many words around them as
   the longest item has. Only blocks with a seed in the filter travel, as codes of four bytes a word.
3. Blocks join seeds by hash, then their items, and each (block, item) is verified
   on all its diagonals at once. Seeds and items are broadcast if their counted
   size is below BROADCAST_BYTES; else both sides are salted, so that neither a
   preamble of many items nor a passage of many texts is one task's.

Words are runs of ASCII letters, digits and other characters beyond ASCII, in
lower case.

Cases: null and empty texts and items have no words and no overlaps; rows of
either table that are equal in id and text are one; an empty table on either side
gives no rows; texts and items of any length are used whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import BYTE_CODES, chunks, mix64, rolling, split_words, text_buffer
from tidemark.llm.shared import written

#: Fixed masks: a one takes the word at its place, a zero ignores it.
LONG_MASKS = ("11111", "111011")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
LEAST_WORDS = 13
MISMATCH = 4
CHUNK_BYTES = 1 << 19
BLOCK_WORDS = 1024
#: Bits of the filter in front of the join, from FEWEST_BITS to MOST_BITS (64 MB) by the number of seeds, and those of one hash set.
FEWEST_BITS, MOST_BITS, PART_BITS = 16, 29, 15
PROBES = 4
BROADCAST_BYTES = 32 << 20
SALTS = 16

WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True

ITEMS = "_i long, item_id long, w binary, n int, s array<long>, places array<array<int>>"
BLOCKS = "_k long, doc_id long, block int, base int, codes binary, s array<long>, at array<array<int>>"
VERIFIED = "_k long, doc_id long, _i long, item_id long, doc_start long, item_start long, overlap_words long, matched_words long"


def masks_of(words: int) -> tuple[str, ...]:
    """The masks for an item of so many words."""
    if words >= LEAST_WORDS:
        return LONG_MASKS
    return SHORT_MASKS if words >= 5 else ("1" * words,) if words else ()


def word_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word of lower-case texts."""
    starts, ends, doc = split_words(raw, offsets, WORD_BYTES)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), doc
    return mix64(rolling(BYTE_CODES[raw])(starts, ends) + (ends - starts).astype(np.uint64)), doc


def short(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(32)).astype("<u4")


def seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at every position where the mask fits; masks have hashes of their own."""
    n = len(codes) - len(mask) + 1
    out = np.full(max(n, 0), np.uint64(int("1" + mask, 2)), dtype=np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = (out + codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(out)


def _listed(value: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct values, the places of each)."""
    order = np.argsort(value, kind="stable")
    value, place = value[order], place[order]
    lead = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, dtype=np.int64)
    return value[lead], np.split(place, lead[1:]) if len(value) else []


def _item_seeds(batches):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("_t"))
        cols = [[], [], [], []]
        for lo, hi in chunks(offsets, CHUNK_BYTES):
            o = offsets[lo : hi + 1]
            codes, doc = word_codes(raw[o[0] : o[-1]], o - o[0])
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            for d in range(hi - lo):
                own = codes[cut[d] : cut[d + 1]]
                each = [seeds(own, mask) for mask in masks_of(len(own))]
                value, places = _listed(np.concatenate([*each, own[:0]]), np.concatenate([*(np.arange(len(x), dtype=np.int32) for x in each), np.zeros(0, dtype=np.int32)]))
                for col, v in zip(cols, (short(own).tobytes(), len(own), value.view(np.int64), places), strict=True):
                    col.append(v)
        kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([batch.column("_i"), batch.column("item_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["_i", "item_id", "w", "n", "s", "places"])


def _probe(seed: np.ndarray, j: int, bits: int) -> np.ndarray:
    return (mix64(seed + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def _places(bits: int):
    def run(batches):
        for batch in batches:
            seed = np.asarray(batch.column("s")).view(np.uint64)
            place = np.unique(np.concatenate([_probe(seed, j, bits) for j in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array(place >> PART_BITS), pa.array(place & ((1 << PART_BITS) - 1))], names=["c", "p"])

    return run


def _part(table: pa.Table) -> pa.Table:
    """The bits of one part of the filter."""
    held = np.zeros(1 << PART_BITS, dtype=bool)
    held[np.asarray(table["p"])] = True
    return pa.table({"c": pa.array([table["c"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})


def front_filter(seed: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """(B, 2**B bits) of the Bloom filter of the seeds."""
    bits = min(max(FEWEST_BITS, (64 * count).bit_length()), MOST_BITS)
    parts = seed.select("s").mapInArrow(_places(bits), "c long, p long").distinct().groupBy("c").applyInArrow(_part, "c long, bits binary").collect()
    held = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in parts:
        at = r.c << (PART_BITS - 3)
        held[at : at + (1 << PART_BITS - 3)] = np.frombuffer(r.bits, dtype=np.uint8)
    return bits, held


def passes(front: tuple[int, np.ndarray], seed: np.ndarray) -> np.ndarray:
    """Places of the seeds that the filter holds; it holds a few others too."""
    bits, held = front
    at = np.arange(len(seed))
    for j in range(PROBES):
        p = _probe(seed[at], j, bits)
        at = at[((held[p >> 3] << (p & 7).astype(np.uint8)) & np.uint8(0x80)) > 0]
    return at


def _blocks(front, masks: tuple[str, ...], block: int, reach: int):
    """The blocks of each text that hold a seed of the filter."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("_t"))
            ks, ids, rows = batch.column("_k").to_pylist(), batch.column("doc_id").to_pylist(), []
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                o = offsets[lo : hi + 1]
                codes, doc = word_codes(raw[o[0] : o[-1]], o - o[0])
                size = np.bincount(doc, minlength=hi - lo)
                first = np.cumsum(size) - size
                found = []
                for mask in masks:
                    s = seeds(codes, mask)
                    at = passes(front.value, s)
                    at = at[doc[at] == doc[at + len(mask) - 1]]
                    found.append((at, s[at]))
                at, value = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(at):
                    continue
                own = doc[at]
                part = (at - first[own]) // block
                order = np.lexsort((part, own))
                at, value, own, part = at[order], value[order], own[order], part[order]
                lead = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (part[1:] != part[:-1])))
                for a, b in zip(lead.tolist(), [*lead[1:].tolist(), len(at)], strict=True):
                    d, x = int(own[a]), int(part[a])
                    base, stop = max(0, x * block - reach), min(int(size[d]), (x + 1) * block + reach)
                    s, places = _listed(value[a:b], (at[a:b] - first[d]).astype(np.int32))
                    rows.append((ks[lo + d], ids[lo + d], x, base, short(codes[first[d] + base : first[d] + stop]).tobytes(), s.view(np.int64), places))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return run


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """Of the longest segment with a score that isn't negative: its first and behind its last match."""
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    # the last place from which on no gain is as high as at a start ends its segment
    high = np.maximum.accumulate(gain[::-1])[::-1]
    stops = np.searchsorted(-high, -gain, side="right") - 1
    start = int(np.argmax(stops - np.arange(len(gain))))
    hits = np.flatnonzero(equal[start : int(stops[start])])
    return (start + int(hits[0]), start + int(hits[-1]) + 1) if len(hits) else (0, 0)


def overlap(codes: np.ndarray, base: int, words: np.ndarray, diagonals: np.ndarray, least: int) -> tuple[int, int, int, int] | None:
    """(document start, item start, words, matches) of the best overlap on any of the diagonals; codes start at word `base` of the document."""
    needed, n = max(min(least, -(-4 * len(words) // 5)), 1), len(words)
    best = None
    for lo in range(0, len(diagonals), max(1, (1 << 20) // n)):
        some = diagonals[lo : lo + max(1, (1 << 20) // n)]
        place = some[:, None] - base + np.arange(n)
        inside = (place >= 0) & (place < len(codes))
        equal = inside & (codes[np.where(inside, place, 0)] == words)
        total = equal.sum(axis=1)
        for i in np.argsort(-total, kind="stable").tolist():
            if total[i] < needed or (best and total[i] < best[0]):
                break
            start, stop = best_segment(equal[i])
            matched = int(equal[i, start:stop].sum())
            if matched >= needed:
                x = (matched, start - stop, -(int(some[i]) + start), start)
                best = max(best or x, x)
    return best and (-best[2], best[3], -best[1], best[0])


def _verify(least: int):
    def run(batches):
        for batch in batches:
            rows = []
            held = zip(*(batch.column(c).to_pylist() for c in ("_k", "doc_id", "base", "codes", "_i", "item_id", "w", "hits")), strict=True)
            for k, doc_id, base, codes, i, item_id, w, hits in held:
                diagonals = np.unique(np.concatenate([np.subtract.outer(np.array(x["at"]), np.array(x["places"])).ravel() for x in hits]))
                if found := overlap(np.frombuffer(codes, dtype="<u4"), base, np.frombuffer(w, dtype="<u4"), diagonals, least):
                    rows.append((k, doc_id, i, item_id, *found))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in VERIFIED.split(", ")])

    return run


def _met(left: DataFrame, right: DataFrame, key: str, size: int) -> DataFrame:
    """left joined to right: by broadcast if right is below BROADCAST_BYTES, else with left's rows of a key dealt to SALTS tasks."""
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key)
    left = left.withColumn("_salt", F.pmod(F.xxhash64("_k", "block"), F.lit(SALTS)))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def _keyed(docs: DataFrame, id_col: str, text_col: str, key: str, name: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias(key), F.col(id_col).cast("long").alias(name), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))


def best_overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(_k, _i) and the columns of `overlaps`: a row per text and item that overlap; _k is xxhash64 of a document's id and text."""
    spark = docs.sparkSession
    items = written(_keyed(benchmark, item_col, text_col, "_i", "item_id").dropDuplicates(["_i"]).mapInArrow(_item_seeds, ITEMS).filter("n > 0"), "items")
    lengths = F.collect_set(F.when(F.col("n") < 5, F.col("n")).when(F.col("n") < LEAST_WORDS, 5).otherwise(LEAST_WORDS))
    sizes, longest, words, count = items.agg(lengths, F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("s")), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], VERIFIED)
    seed = items.select("_i", F.explode(F.arrays_zip("s", "places")).alias("x")).select("_i", "x.s", "x.places")
    front = spark.sparkContext.broadcast(front_filter(seed, count))
    masks = tuple(dict.fromkeys(m for n in sorted(sizes) for m in masks_of(n)))
    found = _keyed(docs, id_col, text_col, "_k", "doc_id").mapInArrow(_blocks(front, masks, max(BLOCK_WORDS, 2 * longest), longest), BLOCKS)
    blocks = written(found.dropDuplicates(["_k", "block"]), "blocks")
    at = blocks.select("_k", "block", F.explode(F.arrays_zip("s", "at")).alias("x")).select("_k", "block", "x.s", "x.at")
    hits = _met(at, seed, "s", 80 * count).groupBy("_k", "block", "_i").agg(F.collect_list(F.struct("at", "places")).alias("hits"))
    both = _met(hits, items.select("_i", "item_id", "w"), "_i", 4 * words).join(blocks.drop("s", "at"), ["_k", "block"])
    order = F.struct("matched_words", F.negate("overlap_words").alias("x"), F.negate("doc_start").alias("y"), "item_start")
    best = both.mapInArrow(_verify(least), VERIFIED).groupBy("_k", "_i").agg(F.max_by(F.struct("doc_id", "item_id", "doc_start", "item_start", "overlap_words", "matched_words"), order).alias("best"))
    return best.select("_k", "_i", "best.*")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per document text and benchmark item that overlap: the best overlap, in words."""
    return best_overlaps(docs, benchmark, id_col=id_col, item_col=item_col, text_col=text_col, least=least).drop("_k", "_i").distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs that overlap no benchmark item, with all their columns."""
    leaks = written(best_overlaps(docs, benchmark, id_col=id_col, item_col=item_col, text_col=text_col, least=least).select("_k").distinct(), "leaks")
    if 16 * leaks.count() <= BROADCAST_BYTES:
        leaks = F.broadcast(leaks)
    return docs.join(leaks, F.xxhash64(docs[id_col], docs[text_col]) == leaks["_k"], "left_anti")
