"""Substring deduplication on words: every window of k consecutive words that occurs twice or more.

Method: super-k-mer partitioning (see superkmer.py). In a bucket the windows of
all packed strings are sorted and equal neighbours are counted exactly: words are
numbered by their text, windows sort by a hash of those numbers, and neighbours
with one hash are compared number by number.

Cases: null and empty texts have no words and lose none; repeated rows (same id
and text) are separate documents, so all their windows repeat; a text of any
length is processed whole; ids may be null; other columns are carried untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm.arrowtext import gram_hashes, merged, mix64, split_words
from tidemark.llm.superkmer import Units, keyed, repeated_spans, rows_key, spans_of_windows

WINDOW_WORDS = 35
GRAM_WORDS = 8


def resolve_words(strings: list[bytes], twice: np.ndarray, k: int) -> dict[int, list[tuple[int, int]]]:
    """Spans of windows of k words that occur in two places of `strings`, or in one that is marked `twice`."""
    offsets = np.zeros(len(strings) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in strings], out=offsets[1:])
    blob = b"".join(strings)
    raw = np.frombuffer(blob, dtype=np.uint8)
    starts, ends, doc = split_words(raw, offsets)
    where = np.append(starts, len(raw)).astype(np.int64)
    # each word with the space after it, cut off again, is the slice between starts; equal words have equal slices but for that space
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=at[1:])
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    tight = raw[np.cumsum(inside[:-1]).astype(bool)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(tight))])
    del where
    number = np.asarray(pc.dictionary_encode(words).indices, dtype=np.int64)
    size = np.bincount(doc, minlength=len(strings))
    first = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=first[1:])
    windows = np.maximum(size - k + 1, 0)
    owner = np.repeat(np.arange(len(size)), windows)
    before = np.cumsum(windows) - windows
    pos = np.arange(int(windows.sum())) + np.repeat(first[:-1] - before, windows)
    if len(pos) < 2:
        return {}
    code = gram_hashes(mix64(number.astype(np.uint64)), k)[pos]
    order = np.argsort(code, kind="stable")
    same = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    a, b = pos[order[same]], pos[order[same + 1]]
    equal = np.ones(len(a), dtype=bool)
    for j in range(k):
        equal &= number[a + j] == number[b + j]
    flags = twice[owner].copy()
    if not equal.all():  # different windows with one hash stand in this run: tell them apart by all their numbers
        members: dict[tuple, list[int]] = {}
        for i in order[np.union1d(same, same + 1)].tolist():
            members.setdefault(tuple(number[pos[i] : pos[i] + k].tolist()), []).append(i)
        for group in members.values():
            if len(group) > 1:
                flags[group] = True
    else:
        flags[order[same]] = True
        flags[order[same + 1]] = True
    return spans_of_windows(flags & ~twice[owner], owner, pos - first[owner], k)


def repeated_word_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """(keyed documents, their repeated spans) with one row per row of docs: _k, _id, _t, spans."""
    rows = keyed(docs, id_col, text_col)
    return rows.join(repeated_spans(rows, Units("words", window, gram), resolve_words), "_k", "left")


def _own(spans, own_id) -> list[tuple[int, int]]:
    return merged((x["start"], x["stop"]) for x in spans if x["id"] == own_id) if spans else []


def _digests(batches):
    for batch in batches:
        out = [[], [], [], []]
        for i, t, spans in zip(batch.column("_id").to_pylist(), batch.column("_t"), batch.column("spans").to_pylist(), strict=True):
            words = t.as_buffer().to_pybytes().split()
            n, kept = len(words), words
            if cut := _own(spans, i):
                kept, at = [], 0
                for a, b in cut:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
            for col, v in zip(out, (i, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return repeated_word_spans(docs).mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _strip(batches):
    for batch in batches:
        out = []
        for i, t, spans in zip(batch.column("_id").to_pylist(), batch.column("_t"), batch.column("spans").to_pylist(), strict=True):
            raw = t.as_buffer().to_pybytes()
            if cut := _own(spans, i):
                starts, ends, _ = split_words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
                pieces, at = [], 0
                for a, b in cut:
                    pieces.append(raw[at : starts[a]])
                    at = int(starts[b]) if b < len(starts) else int(ends[b - 1])
                raw = b"".join([*pieces, raw[at:]])
            out.append(raw.decode())
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], names=["_row", "_text"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """docs with the words of repeated windows taken out of their texts, other text left as it is. All rows and columns stay."""
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, Units("words", window, gram), resolve_words)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *rows_key(docs, id_col, text_col))
    joined = own.join(spans, "_k", "left").select("_row", "_id", "_t", "spans")
    done = joined.mapInArrow(_strip, StructType([joined.schema["_row"], StructField("_text", StringType())]))
    text = F.when(F.col(f"_row.`{text_col}`").isNotNull(), F.col("_text"))
    return done.select(*(text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


ORACLE = r"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select r, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from (select r, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)),
d as (select r, i from g qualify count(*) over (partition by h) > 1),
c as (select distinct r, unnest(range(i, i + 35)) as p from d),
k as (select r, string_agg(word, ' ' order by p) as kept, count(*) as n from (select r, unnest(ws) as word, generate_subscripts(ws, 1) as p from w) anti join c using (r, p) group by r)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (r)
"""
