"""Ranked lexical search: TPUT (three-phase uniform threshold) over term-partitioned postings.

Every whole text is cut into terms where it lies. Postings (term, document, tf) of
the terms that items ask for are written, then dealt out by term: a list of over
LIST_ROWS postings in so many parts as it needs, each sorted by impact, which is
what a posting adds to a score: w * ((10**9 * tf) div (1000 * tf + 12 * m)).

1. Heads. The k highest impacts of each list give partial sums. The FIRST * k
   documents of the largest ones are looked up at once, and an item's k-th score
   among them, `low`, is a lower bound of its k-th score.
2. Uniform threshold. Of each of an item's lists all postings are fetched that add at
   least low / (DEPTH * number of lists). A document that none of them holds is below `low`.
   A posting travels once, however many items ask for it, to the block of its
   document, where partial sums are made for each item. What a list that didn't
   hold a document may add is at most the threshold and at most its head. A
   block leaves out documents that can't reach the k-th partial sum of the block;
   the k-th of all blocks is a better bound for those that are left.
3. Look-up. What the lists below the threshold add to the documents that stay is
   looked up by document and term, and gives exact scores.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z
lower-cased. N, L and df count all documents. All but a term's weight is integer
arithmetic, so thresholds are compared without rounding.

Memory and skew: the terms asked for filter postings by a bitmap of at most
2**MOST_BITS bits, which only saves work, and then exactly by a join; small sides
are broadcast below a counted size, else joined by a shuffle. Items are searched in
turns of about ASKED_ROWS (item, term) rows, which are what a block of documents needs
of them; so a turn's rows may go to the driver and to tasks. Besides these only the
counts N, L and the bitmap do.

Cases: null and empty texts have no terms, are never found and don't count in N; an
item without terms, or whose terms no document holds, gives no rows; each row of
either table stands for itself, so rows of equal id are ranked apart (in the order
of their scores, ties in any order); null ids come last among ties; texts of any
length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import BYTE_CODES, binary_array, chunks, mix64, rolling, split_words, text_buffer
from tidemark.llm.shared import small, written

K = 20
#: Times k documents of the largest partial sums are looked up for the first bound.
FIRST = 2
CHUNK_BYTES = 1 << 20
LIST_ROWS = 8192
#: The threshold is so much lower than the bound over the number of lists: more is fetched, less looked up.
DEPTH = 2
#: Postings of a block of documents, rows of (item, term) of a turn, and sums that a block makes at once.
BLOCK_ROWS = 200_000
ASKED_ROWS = 200_000
SUMS_AT_ONCE = 1_000_000
#: Bits of the terms' bitmap: from FEWEST_BITS to MOST_BITS (8 MB) by their number; and those of a row of it.
FEWEST_BITS, MOST_BITS, PART_BITS = 15, 26, 15
#: Bits for each term asked for.
SPARSE = 32
#: A task's rows have the numbers from its partition times 2**ROW_BITS.
ROW_BITS = 36

TERM_BYTES = np.zeros(256, dtype=bool)
TERM_BYTES[0x30:0x3A] = TERM_BYTES[0x41:0x5B] = TERM_BYTES[0x61:0x7B] = TERM_BYTES[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _terms(held: np.ndarray | None):
    """A row for each of a text's different terms that the bitmap holds (None: all), then one of a task's totals.

    Rows: row, id, n (the text's terms), term, tf, code (the term's hash). The totals have no term, n has all terms and tf the texts with one.
    """

    def run(batches):
        row, texts, total = TaskContext.get().partitionId() << ROW_BITS, 0, 0
        for batch in batches:
            raw, offsets = text_buffer(batch.column("_t"))
            ids = batch.column("_i")
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                o = offsets[lo : hi + 1] - offsets[lo]
                low = LOWER[raw[offsets[lo] : offsets[hi]]]
                starts, ends, doc = split_words(low, o, TERM_BYTES)
                size = np.bincount(doc, minlength=hi - lo)
                texts, total = texts + int(np.count_nonzero(size)), total + int(size.sum())
                code = mix64(rolling(BYTE_CODES[low])(starts, ends) + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, dtype=np.uint64)
                if held is not None:
                    bit = (code >> np.uint64(64 - (len(held) * 8).bit_length() + 1)).astype(np.int64)
                    asked = np.flatnonzero(held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    starts, ends, doc, code = starts[asked], ends[asked], doc[asked], code[asked]
                named = binary_array(low, starts, ends).dictionary_encode()
                number = np.asarray(named.indices).astype(np.int64)
                many = max(len(named.dictionary), 1)
                key, first, tf = np.unique(doc * many + number, return_index=True, return_counts=True)
                own = key // many
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + own), ids.slice(lo, hi - lo).take(pa.array(own)), pa.array(size[own]), named.dictionary.take(pa.array(key % many)).cast(pa.binary()), pa.array(tf), pa.array(code[first].view(np.int64))],
                    names=["row", "id", "n", "term", "tf", "code"],
                )
                row += hi - lo
        yield pa.RecordBatch.from_arrays([*(pa.array([v], kind) for v, kind in ((None, pa.int64()), (None, pa.int64()), (total, pa.int64()), (None, pa.binary()), (texts, pa.int64()), (None, pa.int64())))], names=["row", "id", "n", "term", "tf", "code"])

    return run


def terms(rows: DataFrame, id_col: str, text_col: str, held: np.ndarray | None, name: str) -> DataFrame:
    """The written rows of _terms; what is written gives each text its number once and for all."""
    own = rows.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t"))
    return written(own.mapInArrow(_terms(held), "row long, id long, n long, term binary, tf long, code long").withColumn("term", F.col("term").cast("string")), name)


def bitmap(codes: DataFrame, number: int) -> np.ndarray:
    """The bytes of a bitmap of the codes' highest bits, built by tasks in parts of 4 KB."""
    bits = min(max(FEWEST_BITS, math.ceil(math.log2(max(number, 1) * SPARSE))), MOST_BITS)
    at = codes.select(F.expr(f"shiftrightunsigned(code, {64 - bits})").alias("at"))
    parts = at.groupBy(F.expr(f"at div {1 << PART_BITS}").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % (1 << PART_BITS)).alias("bits"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in parts.collect():
        part = np.frombuffer(r.bits, dtype=np.uint8)
        out[r.part << (PART_BITS - 3) :][: len(part)] = part
    return out


def _impact(texts: int, total: int) -> Column:
    """What a posting adds to a score for each occurrence of its term in an item."""
    m = F.expr(f"75 + (25 * n * {texts}L) div {max(total, 1)}L")
    return F.col("w") * F.call_function("div", F.lit(1_000_000_000).cast("long") * F.col("tf"), 1000 * F.col("tf") + 12 * m)


def lists(found: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows of _terms: the terms `asked` (term) that they hold, numbered: (term, t); and the postings of an impact s above 0: (t, row, s), dealt by term and sorted by impact."""
    total, texts = found.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    often = found.filter("term is not null").groupBy("term").agg(F.count("*").alias("df")).join(small(written(asked, "asked")), "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(texts) + 2).cast("double") / (2 * F.col("df") + 1)))
    # numbers are given by one written table, so that they are the same wherever it is read
    known = small(written(often.select("term", weight.alias("w"), F.ceil(F.col("df") / LIST_ROWS).alias("parts"), F.monotonically_increasing_id().alias("t")), "weights"))
    rows = found.join(known, "term").select("t", "row", _impact(texts, total).alias("s"), F.pmod(F.xxhash64("row"), "parts").alias("part")).filter("s > 0")
    return known.select("term", "t"), written(rows.repartition("t", "part").sortWithinPartitions("t", F.desc("s")).drop("part"), "lists")


def _heads(k: int):
    """The first k rows of each run of a term in a task."""

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            t = np.asarray(batch.column("t"))
            if not len(t):
                continue
            lead = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            place = np.arange(len(t)) - np.repeat(lead, np.diff(np.append(lead, len(t))))
            if t[0] == last:
                place[: lead[1] if len(lead) > 1 else len(t)] += seen
            last, seen = t[-1], int(place[-1]) + 1
            yield batch.filter(pa.array(place < k))

    return run


def _best(sums: DataFrame, most: int) -> DataFrame:
    """The rows (q, s, ...) of each item's largest s, with _r from 1."""
    return sums.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "row"))).filter(F.col("_r") <= most)


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """(q, bound): the k-th largest s of each item; 0 if it has fewer."""
    return _best(sums, k).groupBy("q").agg(F.when(F.max("_r") == k, F.min("s")).otherwise(0).alias(name))


def _blocks(asked: pa.Table, k: int):
    """(q, row, s, most) of a block of postings (row, t, s): partial sums of what reaches the threshold, and what they may become.

    asked: (q, t, times, low, size, head), sorted by t.
    """
    term, start = np.unique(np.asarray(asked["t"]), return_index=True)
    start = np.append(start, len(asked))
    items, q_of = np.unique(np.asarray(asked["q"]), return_inverse=True)
    times, low, size, head = (np.asarray(asked[c]) for c in ("times", "low", "size", "head"))
    # whole numbers of 1 / size: no rounding
    cap = np.minimum(low, head * times * size)
    all_caps = np.zeros(len(items), dtype=np.int64)
    np.add.at(all_caps, q_of, cap)
    size_of, low_of = np.zeros((2, len(items)), dtype=np.int64)
    size_of[q_of], low_of[q_of] = size, low

    def run(block: pa.Table) -> pa.Table:
        row, t, s = (np.asarray(block[c]) for c in ("row", "t", "s"))
        order = np.argsort(row, kind="stable")
        row, t, s = row[order], np.searchsorted(term, t[order]), s[order]
        many = start[t + 1] - start[t]
        before = np.append(0, np.cumsum(many))
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        bound = low_of.copy()
        held: list[np.ndarray] = []
        lo = 0
        while lo < len(row):
            # whole documents of about SUMS_AT_ONCE sums
            hi = int(np.searchsorted(before, before[lo] + SUMS_AT_ONCE, side="right")) - 1
            cut = int(np.searchsorted(first, max(hi, lo + 1), side="right"))
            hi = int(first[cut - 1]) if cut and first[cut - 1] > lo and hi < len(row) else (int(first[cut]) if cut < len(first) and hi < len(row) else len(row))
            n = many[lo:hi]
            post = np.repeat(np.arange(lo, hi), n)
            ask = np.arange(len(post)) - np.repeat(before[lo:hi] - before[lo] - start[t[lo:hi]], n)
            value = s[post] * times[ask]
            near = np.flatnonzero(value * size[ask] >= low[ask])
            post, ask, value = post[near], ask[near], value[near]
            key = np.searchsorted(first, post, side="right") * len(items) + q_of[ask]
            by = np.argsort(key, kind="stable")
            key, value, extra = key[by], value[by], (value * size[ask] - cap[ask])[by]
            lead = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
            if len(lead):
                q, doc = key[lead] % len(items), key[lead] // len(items) - 1
                part, most = np.add.reduceat(value, lead), np.add.reduceat(extra, lead) + all_caps[key[lead] % len(items)]
                held.append(np.stack([q, row[first[doc]], part, most]))
                q, _, part, _ = now = np.concatenate(held, axis=1)
                order = np.lexsort((-part, q))
                q, part = q[order], part[order]
                at = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                enough = at[np.diff(np.append(at, len(q))) >= k]
                bound[q[enough]] = np.maximum(bound[q[enough]], part[enough + k - 1])
                held = [now[:, now[3] >= bound[now[0]] * size_of[now[0]]]]
            lo = hi
        q, row, part, most = held[0] if held else np.zeros((4, 0), dtype=np.int64)
        return pa.table({"q": items[q] if len(q) else q, "row": row, "s": part, "most": most})

    return run


def search(docs: DataFrame, items: DataFrame, *, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score."""
    asked = terms(items, item_col, item_text_col, None, "items").filter("term is not null")
    words = asked.groupBy("term").agg(F.first("code").alias("code"))
    found = terms(docs, id_col, text_col, bitmap(words, words.count()), "postings")
    known, posted = lists(found, words.select("term"))
    heads = written(_tops(posted.mapInArrow(_heads(k), posted.schema), k), "heads")
    tops = heads.groupBy("t").agg(F.max("s").alias("head"))
    # an item's lists are those that hold anything; size: by what `low` is divided
    lengths = Window.partitionBy("q")
    asked = asked.join(known, "term").join(tops, "t").select(F.col("row").alias("q"), F.col("id").alias("item_id"), "t", F.col("tf").alias("times"), "head").withColumn("size", DEPTH * F.count("*").over(lengths))
    turns = asked.withColumn("turn", F.pmod(F.xxhash64("q"), F.lit(max(1, math.ceil(asked.count() / ASKED_ROWS)))))
    asked = written(turns, "queries")
    blocks = max(1, math.ceil(posted.count() / BLOCK_ROWS))
    out = [_turn(posted, heads, asked.filter(F.col("turn") == r.turn), blocks, k) for r in asked.select("turn").distinct().orderBy("turn").collect()]
    exact = out[0] if out else posted.select(F.col("row").alias("q"), "row", "s").limit(0)
    for more in out[1:]:
        exact = exact.unionByName(more)
    # ids are needed of the best only, and of all that tie with them
    ranked = written(exact.withColumn("_r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("s")))).filter(F.col("_r") <= k), "best")
    named = found.select("row", "id").join(small(ranked.select("row").distinct()), "row", "left_semi").groupBy("row").agg(F.first("id").alias("doc_id"))
    owners = asked.select("q", "item_id").distinct()
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), F.asc_nulls_last("doc_id"), "row"))
    return ranked.join(named, "row").join(owners, "q").withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", F.col("s").alias("score"))


def _tops(posted: DataFrame, k: int) -> DataFrame:
    return posted.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "row"))).filter(F.col("_r") <= k).drop("_r")


def _turn(posted: DataFrame, heads: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """(q, row, s): the exact scores of the documents that may be among an item's k best."""
    asked = F.broadcast(asked)  # at most ASKED_ROWS on average, and an item's terms more
    # 1. heads of the lists
    sums = heads.join(asked, "t").groupBy("q", "row").agg(F.sum(F.col("times") * F.col("s")).alias("s"))
    wanted = written(_best(sums, FIRST * k).select("q", "row").join(asked, "q").select("q", "row", "t", "times"), "first")
    first = posted.join(small(wanted, 96), ["t", "row"]).groupBy("q", "row").agg(F.sum(F.col("s") * F.col("times")).alias("s"))
    limits = written(asked.join(_kth(first, k, "low"), "q").select("q", "t", "times", "low", "size", "head"), "limits")
    # 2. all postings that reach an item's threshold
    lowest = limits.groupBy("t").agg(F.min(F.expr("low / size / times")).alias("least"))
    near = posted.join(F.broadcast(lowest), "t").filter(F.col("s") >= F.col("least") * (1 - 1e-9)).select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "row", "t", "s")
    partial = written(near.groupBy("block").applyInArrow(_blocks(limits.orderBy("t", "q").toArrow(), k), "q long, row long, s long, most long"), "partial")
    limits = F.broadcast(limits)
    bounds = _kth(partial, k, "high").join(limits.groupBy("q").agg(F.first("low").alias("low"), F.first("size").alias("size")), "q").withColumn("high", F.greatest("high", "low"))
    stay = written(partial.join(F.broadcast(bounds), "q").filter("most >= high * size").select("q", "row", "s"), "candidates")
    # 3. exact scores of the documents that stay
    rows = small(written(stay.groupBy("row").agg(F.collect_list("q").alias("qs")), "rows"), 128)
    rest = posted.join(rows, "row").select("row", "t", "s", F.explode("qs").alias("q")).join(limits, ["q", "t"]).filter("s * times * size < low").select("q", "row", (F.col("s") * F.col("times")).alias("s"))
    return stay.unionByName(rest).groupBy("q", "row").agg(F.sum("s").alias("s"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT doc_id, len(ws) AS n, ws FROM words WHERE len(ws) > 0
), totals AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM counted
), tfs AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM counted) GROUP BY ALL
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark)
  GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, nn
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
