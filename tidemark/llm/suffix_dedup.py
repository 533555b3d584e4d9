"""Suffix-array deduplication on bytes: every string of k bytes that starts in two places or more.

Super-k-mers (see superkmer.py) bring strings that may share k bytes to one
bucket. A bucket's strings are joined, each closed by a separator, and their
suffixes are sorted in two stages:

1. Suffixes smaller than their successors (type S) are sorted directly: the
   segment from one S position to the next gets a name by its (symbol, type)
   pairs, and ranks of names double in length until ties are broken or agree
   for `k` bytes.
2. The others (type L) are induced by scanning the buckets of first symbols in
   ascending order: the predecessor of a placed suffix, if of type L, is placed
   next in the bucket of its own first symbol.

Neighbours in that order then get the length of their common prefix, up to the
window. A place's longest one tells whether a string of k bytes starts there that
also starts elsewhere.

Cases: null and empty texts have no bytes; repeated rows are separate documents;
texts of any length are processed whole; ids may be null. Matches never cross
documents, since super-k-mers don't.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrowtext import merged
from tidemark.llm.superkmer import Units, keyed, repeated_spans, spans_of_windows

WINDOW_BYTES = 400
GRAM_BYTES = 40
#: (symbol, type) pairs of ten bits in one 64-bit name.
PER_NAME = 6


def _refine(rank: np.ndarray, items: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Splits ties of `rank` among `items` by `second`; ranks are the first places of their groups. Returns items still tied."""
    key = (rank[items].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
    order = np.argsort(key)
    items, key = items[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    group = key >> np.uint64(32)
    outer = np.ones(len(key), dtype=bool)
    outer[1:] = group[1:] != group[:-1]
    place = np.arange(len(key))
    shift = place[new][np.cumsum(new) - 1] - place[outer][np.cumsum(outer) - 1]
    rank[items] += shift
    alone = new.copy()
    alone[:-1] &= new[1:]
    return items[~alone]


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one counts as such."""
    n = len(text)
    small = np.ones(n, dtype=bool)
    if n > 1:
        # the next place that differs from its successor
        at = np.where(text[1:] != text[:-1], np.arange(n - 1), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        there = np.minimum(at, n - 2)
        small[:-1] = (at < n) & (text[there] < text[there + 1])
    return small


def _sort_small(text: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """Positions of type S in the order of their suffixes' first `depth` symbols at least."""
    p = np.flatnonzero(small)
    m = len(p)
    length = np.append(p[1:] - p[:-1] + 1, 1)
    symbol = np.zeros(len(text) + PER_NAME, dtype=np.uint64)
    symbol[: len(text)] = (text.astype(np.uint64) << np.uint64(1)) | small
    def name(items: np.ndarray, skip: int) -> np.ndarray:
        out = np.zeros(len(items), dtype=np.uint64)
        left = length[items] - skip
        for j in range(PER_NAME):
            out = (out << np.uint64(10)) | np.where(left > j, symbol[np.minimum(p[items] + skip + j, len(symbol) - 1)], np.uint64(0))
        return out

    names = name(np.arange(m), 0)
    order = np.argsort(names)
    ordered = names[order]
    new = np.ones(m, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    firsts = np.flatnonzero(new)
    rank = np.empty(m, dtype=np.int64)
    rank[order] = firsts[np.cumsum(new) - 1]
    size = np.diff(np.append(firsts, m))
    tied = order[np.repeat(size > 1, size)]
    skip = PER_NAME
    longer = tied[length[tied] > skip]
    while len(longer) and skip < depth + PER_NAME:
        longer = _refine(rank, longer, np.unique(name(longer, skip), return_inverse=True)[1])
        skip += PER_NAME
        longer = longer[length[longer] > skip]
    # ranks may have been split since
    order = np.argsort(rank, kind="stable")
    same = rank[order[1:]] == rank[order[:-1]] if m > 1 else np.zeros(0, dtype=bool)
    tied = order[np.append(same, False) | np.append(False, same)]
    end, h = np.append(p, len(text)), 1
    while len(tied):
        tied = tied[(end[np.minimum(tied + h, m)] - p[tied] < depth) & (tied + h < m)]
        if not len(tied):
            break
        tied = _refine(rank, tied, rank[tied + h] + 1)
        h *= 2
    return p[np.argsort(rank, kind="stable")]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` symbols at least, by two-stage sorting.

    text: symbols under 512, the last a 0 after another symbol, none less than 0.
    """
    n = len(text)
    small = _types(text)
    span = int(text.max()) + 1
    count = np.bincount(text, minlength=span)
    start = np.cumsum(count) - count
    stop = start + count
    smalls = np.bincount(text[small], minlength=span)
    out = np.empty(n, dtype=np.int64)
    ordered = _sort_small(text, small, depth)
    at = np.cumsum(smalls) - smalls
    for c in np.flatnonzero(smalls):
        out[stop[c] - smalls[c] : stop[c]] = ordered[at[c] : at[c] + smalls[c]]
    front = start.copy()
    symbols = text.astype(np.uint16)
    for c in np.flatnonzero(count):
        lo, hi = start[c], front[c]
        while lo < hi:  # a run of c: each wave places the suffixes one symbol longer
            before = out[lo:hi] - 1
            before = before[before >= 0]
            before = before[symbols[before] == c]
            out[hi : hi + len(before)] = before
            lo, hi = hi, hi + len(before)
        before = out[start[c] : stop[c]] - 1
        before = before[before >= 0]
        before = before[symbols[before] > c]
        if not len(before):
            continue
        first = symbols[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        tails = np.append(heads[1:], len(first))
        for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
            d = first[a]
            out[front[d] : front[d] + b - a] = before[a:b]
            front[d] += b - a
    return out


def common_prefixes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of raw[a:] and raw[b:], pair by pair, up to `most`."""
    wide = np.zeros(len(raw) + most + 8, dtype=np.uint8)
    wide[: len(raw)] = raw
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)).view(np.uint64).ravel()
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    for at in range(0, most, 8):
        differ = eight[a[live] + at] ^ eight[b[live] + at]
        ended = differ != 0
        if ended.any():
            low = differ[ended] & (~differ[ended] + np.uint64(1))  # the lowest bit that differs, so the first byte
            out[live[ended]] = at + np.floor(np.log2(low.astype(np.float64))).astype(np.int64) // 8
            live = live[~ended]
    out[live] = most
    return np.minimum(out, most)


def resolve_bytes(strings: list[bytes], twice: np.ndarray, k: int) -> dict[int, list[tuple[int, int]]]:
    """Spans of strings of k bytes that start in two places of `strings`, or in one that is marked `twice`."""
    size = np.array([len(s) for s in strings], dtype=np.int64)
    raw = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    text = raw.astype(np.int64) + 1
    first = np.cumsum(size + 1) - size - 1
    text[first + size] = 0
    order = suffix_order(text, k)
    windows = np.maximum(size - k + 1, 0)
    owner = np.repeat(np.arange(len(size)), windows)
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    pos = first[owner] + at
    place = np.full(len(text), -1, dtype=np.int64)
    place[pos] = np.arange(len(pos))
    order = place[order]
    order = order[order >= 0]
    a, b = order[:-1], order[1:]
    left = (size[owner] - at)[order]
    prefix = np.minimum(common_prefixes(raw, pos[a], pos[b], k), np.minimum(left[:-1], left[1:]))
    longest = np.zeros(len(pos), dtype=np.int64)
    np.maximum.at(longest, a, prefix)
    np.maximum.at(longest, b, prefix)
    return spans_of_windows((longest >= k) & ~twice[owner], owner, at, k)


def repeated_byte_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_BYTES, gram: int = GRAM_BYTES) -> DataFrame:
    """One row per row of docs: _k, _id, _t and the byte spans of its repeated strings."""
    rows = keyed(docs, id_col, text_col)
    return rows.join(repeated_spans(rows, Units("bytes", window, gram), resolve_bytes), "_k", "left")


def _digests(batches):
    for batch in batches:
        out = [[], [], [], [], []]
        for i, t, spans in zip(batch.column("_id").to_pylist(), batch.column("_t"), batch.column("spans").to_pylist(), strict=True):
            raw = t.as_buffer().to_pybytes()
            cut = merged((x["start"], x["stop"]) for x in spans or () if x["id"] == i)
            digest, at = hashlib.sha256(), 0
            for a, b in cut:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            for col, v in zip(out, (i, len(raw), sum(b - a for a, b in cut), len(cut), digest.hexdigest()), strict=True):
                col.append(v)
        kinds = [*[pa.int64()] * 4, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeated_byte_spans(docs).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = r"""
with b as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as t from documents),
g as (select r, i, md5(t[i:i + 399]) as h from (select r, t, unnest(range(1, octet_length(t) - 398)) as i from b where octet_length(t) >= 400)),
d as (select r, i from g qualify count(*) over (partition by h) > 1),
s as (select r, i, sum(fresh::int) over (partition by r order by i) as k from (select r, i, coalesce(i > lag(i) over (partition by r order by i) + 400, true) as fresh from d)),
e as (select r, min(i) as a, max(i) + 400 as z from s group by r, k),
p as (select r, octet_length(t) as n, t, a, z, coalesce(lag(z) over (partition by r order by a), 1) as z0, lead(a) over (partition by r order by a) is null as final from b join e using (r)),
x as (select r, sum(z - a) as n_removed, count(*) as n_spans, unhex(string_agg(hex(t[z0:a - 1]) || case when final then hex(t[z:n]) else '' end, '' order by a)) as kept from p group by r)
select doc_id, octet_length(t) as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(case when x.r is null then t else kept end) as kept_sha256
from b left join x using (r)
"""
