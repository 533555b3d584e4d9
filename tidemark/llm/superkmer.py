"""Where a window of units occurs more than once in a corpus: super-k-mer partitioning.

A unit is a word or a byte. Of the m-unit grams of a window the one with the
smallest hash is its minimiser. Consecutive windows with one minimiser form a
super-k-mer, which travels as ONE packed string to the bucket of its minimiser;
equal windows have equal minimisers and so always meet in a bucket.

1. Every text is hashed once to count the minimisers of all documents. A window
   whose minimiser occurs once in the corpus cannot repeat, so its string need not
   travel. This is exact: nothing that could repeat is left out.
2. Documents join the repeated minimisers they hold and pack those super-k-mers.
   Equal strings met in one chunk of a batch settle there: all their windows repeat, one
   copy travels on behalf of all. A group of copies thus sends at most one
   string a chunk, however large it is.
3. Buckets settle the distinct strings, by a function of the caller (sorting).
   Their number follows from the counted minimisers, so a bucket stays small.
4. Spans of repeated windows return to their documents.

A minimiser with more than `heavy` occurrences has no bucket: strings around one
common passage differ at its ends and would all meet there. Its windows travel
as hashes of 128 bits instead, each to the bucket of its own hash and, of equal
ones met in a chunk, once. So no bucket grows with a passage's number of copies.

The documents' shuffle by key is the same in steps 2 and 4 and so written once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import BYTE_CODES, chunks, gram_hashes, merged, mix64, rolling, sliding_min, split_words, text_buffer
from tidemark.llm.shared import written

CHUNK_BYTES = 1 << 19
SECOND_CODES = np.uint64(0xA0761D6478BD642F)
#: Occurrences of a minimiser beyond which its windows travel as hashes, and strings a bucket (few, as sorting is fastest in cache).
HEAVY = 8192
BUCKET_STRINGS = 1024


class Units:
    """How a text falls into units: `words` (white space between) or `bytes`; k, m: units of a window and of a gram."""

    def __init__(self, kind: str, k: int, m: int):
        assert kind in ("words", "bytes") and 0 < m <= k
        self.kind, self.k, self.m = kind, k, m

    def codes(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each unit, units of each document)."""
        if self.kind == "bytes":
            return BYTE_CODES[raw], np.diff(offsets)
        starts, ends, doc = split_words(raw, offsets)
        codes = mix64(rolling(BYTE_CODES[raw])(starts, ends) + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, dtype=np.uint64)
        return codes, np.bincount(doc, minlength=len(offsets) - 1)

    def runs(self, units: np.ndarray, size: np.ndarray, counted: bool = False):
        """(document, first unit in it, windows, minimiser, its places in the run if `counted`) of each super-k-mer."""
        none = np.zeros(0, dtype=np.int64)
        if len(units) < self.k:
            return none, none, none, none.astype(np.uint64), none
        first = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=first[1:])
        grams = gram_hashes(units, self.m)
        # window i lies in one document if that of its first unit also has its last
        windows = np.maximum(size - self.k + 1, 0)
        doc = np.repeat(np.arange(len(size)), windows)
        before = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(windows, out=before[1:])
        at = np.arange(before[-1]) - np.repeat(before[:-1] - first[:-1], windows)
        key = sliding_min(grams, self.k - self.m + 1)[at]
        if not len(key):
            return none, none, none, none.astype(np.uint64), none
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        i = np.flatnonzero(new)
        n = np.diff(np.append(i, len(key)))
        return doc[i], at[i] - first[doc[i]], n, key[i], self._places(grams, at[i], n, key[i]) if counted else none

    def _places(self, grams: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
        """How often each run's minimiser stands in the run: windows that repeat within one run have it twice."""
        width = self.k - self.m + 1
        least = sliding_min(grams, width)
        most = ~sliding_min(~np.concatenate([np.repeat(least[:1], width - 1), least, np.repeat(least[-1:], width - 1)]), width)
        place = np.flatnonzero(grams == most)
        lo, hi = np.searchsorted(place, at), np.searchsorted(place, at + n + width - 1)
        held = hi - lo
        run = np.repeat(np.arange(len(at)), held)
        which = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held - lo, held)
        return np.bincount(run, weights=grams[place[which]] == key[run], minlength=len(at)).astype(np.uint64)


def _minimisers(units: Units):
    """Each document's minimisers and how often they stand in it."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("_t"))
            k = batch.column("_k").to_numpy(zero_copy_only=False)
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                o = offsets[lo : hi + 1]
                doc, _, _, key, places = units.runs(*units.codes(raw[o[0] : o[-1]], o - o[0]), counted=True)
                if len(doc):
                    order = np.lexsort((key, doc))
                    doc, key, places = doc[order], key[order], places[order].astype(np.int64)
                    new = np.ones(len(doc), dtype=bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                    i = np.flatnonzero(new)
                    n = np.add.reduceat(places, i)
                    yield pa.RecordBatch.from_arrays([pa.array(key[i].view(np.int64)), pa.array(k[lo + doc[i]]), pa.array(n, type=pa.int64())], names=["h", "k", "n"])

    return run


def _unsigned(lists: pa.Array, lo: int, hi: int) -> np.ndarray:
    return np.sort(np.asarray(pa.concat_arrays([lists[i].values for i in range(lo, hi)]), dtype=np.int64).view(np.uint64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), dtype=bool)


#: One row a string (s), a window's hash (s, hashed) or, without s, a span that is settled.
#: n > 1: known to occur twice. k, id, start, stop: where; null for one that stands for settled copies.
PACKED = pa.schema([("b", pa.int32()), ("s", pa.binary()), ("n", pa.int32()), ("hashed", pa.bool_()), ("k", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
PACKED_SQL = "b int, s binary, n int, hashed boolean, k long, id long, start int, stop int"


def _hashed(units: Units, codes: np.ndarray, strings: list[tuple], buckets: int):
    """Rows of the windows of heavy strings (first code, windows, known twice, owner), equal ones once."""
    n = np.array([w for _, w, _, _ in strings])
    which = np.repeat(np.arange(len(strings)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.array([x[0] for x in strings])[which] + inner
    pair = np.stack([_window_codes(codes, at, units.k), _window_codes(mix64(codes ^ SECOND_CODES), at, units.k)], axis=1)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    same = (pair[order[1:]] == pair[order[:-1]]).all(axis=1)
    lead = np.append(True, ~same)
    group = np.cumsum(lead) - 1
    often = np.bincount(group, minlength=int(group[-1]) + 1) > 1
    twice = np.array([x[2] for x in strings])
    np.logical_or.at(often, group, twice[which[order]])
    settled = np.zeros(len(at), dtype=bool)
    settled[order] = often[group]
    for i, spans in spans_of_windows(settled, which, inner, units.k).items():
        k, doc_id, start = strings[i][3]
        if k is not None:
            for a, b in spans:
                yield 0, None, 2, True, k, doc_id, start + a, start + b
    for i, some in zip(order[lead].tolist(), often.tolist(), strict=True):
        k, doc_id, start = (None, None, None) if some else strings[which[i]][3]
        a = None if start is None else start + int(inner[i])
        yield int(pair[i, 0] % np.uint64(buckets)), pair[i].tobytes(), 1 + some, True, k, doc_id, a, None if a is None else a + units.k


def _window_codes(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return gram_hashes(codes, length)[at]


def _pack(units: Units, buckets: int):
    """Super-k-mers of repeated minimisers; equal ones of a chunk settle at once."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("_t"))
            ks, ids = batch.column("_k").to_pylist(), batch.column("_id").to_pylist()
            hots, heavies = batch.column("hot"), batch.column("heavy")
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                o = offsets[lo : hi + 1]
                codes, size = units.codes(raw[o[0] : o[-1]], o - o[0])
                doc, start, n, key, _ = units.runs(codes, size)
                if not len(doc):
                    continue
                first = np.cumsum(size) - size
                # a document's own list is a subset of the corpus's repeated minimisers, so the union of a chunk holds for each of them
                keep = np.flatnonzero(_among(key, _unsigned(hots, lo, hi)))
                many = _among(key[keep], _unsigned(heavies, lo, hi))
                stops = start + n - 1 + units.k
                current, words = -1, None
                rows: list[tuple] = []
                seen: dict[bytes, list] = {}
                for i, big in zip(keep.tolist(), many.tolist(), strict=True):
                    d, a, stop = int(doc[i]), int(start[i]), int(stops[i])
                    if d != current:
                        current = d
                        words = raw[o[d] : o[d + 1]].tobytes()
                        if units.kind == "words":
                            words = words.split()
                    s = b" ".join(words[a:stop]) if units.kind == "words" else words[a:stop]
                    own = (ks[lo + d], ids[lo + d], a, stop)
                    if (x := seen.get(s)) is None:
                        seen[s] = [-1 if big else int(key[i] % np.uint64(buckets)), 1, int(n[i]), own, int(first[d]) + a]
                    else:
                        if x[1] == 1:
                            rows.append((x[0] % buckets, None, 2, False, *x[3]))
                            x[1] = 2
                        rows.append((x[0] % buckets, None, 2, False, *own))
                rows += [(b, s, m, False, *(own if m == 1 else (None,) * 4)) for s, (b, m, _, own, _) in seen.items() if b >= 0]
                big = [(at, w, m > 1, own[:3] if m == 1 else (None, None, None)) for b, m, w, own, at in seen.values() if b < 0]
                yield from _packed(rows)
                del rows, seen
                if big:
                    yield from _packed(_hashed(units, codes, big, buckets))

    return run


def _packed(rows):
    for some in itertools.batched(rows, 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some, strict=True), PACKED, strict=True)], schema=PACKED)


def _settle(units: Units, resolve: Callable):
    """Of a bucket's strings and window hashes, the spans of windows that occur twice or more."""
    schema = pa.schema([("k", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        first: dict[bytes, int] = {}
        strings, twice, rows = [], [], []
        hashes: dict[bytes, list] = {}
        for s, n, hashed, k, i, a, b in zip(*(table.column(c).to_pylist() for c in PACKED.names[1:]), strict=True):
            if s is None:
                out.append((k, i, a, b))
            elif hashed:
                x = hashes.setdefault(s, [0, []])
                x[0] += n
                if k is not None:
                    x[1].append((k, i, a, b))
            else:
                at = first.get(s)
                if at is None:
                    at = first[s] = len(strings)
                    strings.append(s)
                    twice.append(n > 1)
                else:
                    twice[at] = True
                if k is not None:
                    rows.append((at, k, i, a, b))
        for n, where in hashes.values():
            if n > 1:
                out += where
        spans = resolve(strings, np.array(twice, dtype=bool), units.k) if not all(twice) else {}
        for at, k, i, a, b in rows:
            if twice[at]:
                out.append((k, i, a, b))
            else:
                out += [(k, i, a + x, a + y) for x, y in spans.get(at, ())]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def spans_of_windows(flags: np.ndarray, owner: np.ndarray, at: np.ndarray, k: int) -> dict[int, list[tuple[int, int]]]:
    """Spans covered by flagged windows; owner and at: string and unit of each window, in order."""
    i = np.flatnonzero(flags)
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(i):
        return out
    new = np.ones(len(i), dtype=bool)
    new[1:] = (owner[i][1:] != owner[i][:-1]) | (at[i][1:] != at[i][:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(i)) - 1
    for o, a, b in zip(owner[i[lo]].tolist(), at[i[lo]].tolist(), at[i[hi]].tolist(), strict=True):
        out.setdefault(o, []).append((a, b + k))
    return {o: merged(x) for o, x in out.items()}


def rows_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """_k, _id, _t: a key that tells rows apart by id and text; equal rows share it and so their result, as it must be."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k"), F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*rows_key(docs, id_col, text_col))


def repeated_spans(docs: DataFrame, units: Units, resolve: Callable, *, heavy: int = HEAVY, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """(_k, spans) for each document of `keyed` with a repeated window; spans: id, start, stop in units, overlapping."""
    spark = docs.sparkSession
    found = written(docs.select("_k", "_t").mapInArrow(_minimisers(units), "h long, k long, n long"), "minimisers")
    repeated = written(found.groupBy("h").agg(F.sum("n").alias("total")).filter("total > 1"), "repeated")
    strings = repeated.agg(F.coalesce(F.sum(F.least("total", F.lit(heavy))), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-strings // bucket_strings))
    held = found.select("h", "k").join(repeated, "h").groupBy(F.col("k").alias("_k")).agg(F.collect_set("h").alias("hot"), F.collect_set(F.when(F.col("total") > heavy, F.col("h"))).alias("heavy"))
    packed = docs.join(held, "_k").select("_k", "_id", "_t", "hot", "heavy").mapInArrow(_pack(units, buckets), PACKED_SQL)
    settled = packed.groupBy("b").applyInArrow(_settle(units, resolve), "k long, id long, start int, stop int")
    # rows that are equal share a key, and their spans are equal too
    return settled.groupBy(F.col("k").alias("_k")).agg(F.collect_set(F.struct("id", "start", "stop")).alias("spans"))
