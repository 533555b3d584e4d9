"""Sequence packing by minimum bin slack.

Texts become token ids (vocabulary file by parameter) and an end id. A document
longer than the window is cut into whole windows and a rest; rests are packed: the
longest one left opens a sequence, and a subset-sum dynamic programme over a
bitset of reachable sums picks the multiset of the remaining lengths whose sum
comes closest to the room left. Its counts are backtracked from the bitsets, and
the pick is repeated as often as the remaining counts allow.

Packing needs lengths only, so documents are dealt into shards by a hash of their
id, text and input partition, some `docs_per_shard` in each, and every shard packs
its own rests. Equal rows of different partitions go to different shards. A shard
leaves a sequence or two that are not full.

Tokens of a text are those of its pieces (see Encoder), as the default vocabulary
never joins them; pieces repeat, so each is encoded once a Python worker.

Cases: null texts are empty and give the end id alone; repeated rows are
separate documents; texts of any length are tokenized whole; ids may be null; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import binary_array, chunks, split_words, text_buffer

WINDOW = 2048
END_ID = 1
DOCS_PER_SHARD = 2048
VOCABULARY = "word_bpe_49k.json"
CHUNK_BYTES = 1 << 20
#: Encoded pieces that a worker holds in a task and keeps after it; past that it starts anew.
KEPT_PIECES = 600_000
KEPT_BETWEEN_TASKS = 150_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Between two pieces of one call; no other piece may hold it.
BAR = b"~"
CLOSERS = np.zeros(256, dtype=bool)
CLOSERS[list(b".,;:!?")] = True
#: Lower-case ASCII and Latin-1 letters of either case: no composition, one lower-case letter each, no other piece inside.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Encoder:
    """Ids of texts, through a table of the ids of their pieces.

    Pieces end at ASCII white space and between an ASCII letter and one of .,;:!?,
    where the vocabulary's splitting rule always ends a piece. Its normalizer
    lowers case, so ASCII letters are lowered first, but for pieces with a `<`,
    which may hold a special token. New pieces are encoded many in a call, with
    bars between them.
    """

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.end_id = end_id
        bar = self.tokenizer.encode(BAR.decode(), add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self.plain = self._model_alone(vocabulary)
        self._clear()

    def _model_alone(self, vocabulary: str):
        """The model behind a split at white space, if the vocabulary marks ends of words and keeps runs of letters whole."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(vocabulary, encoding="utf-8") as f:
            rules = json.load(f)
        suffix, how = rules["model"].get("end_of_word_suffix"), (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        if not suffix or [x["type"] for x in how] != ["Split", "ByteLevel"] or "[\\p{L}]+" not in how[0]["pattern"].get("Regex", ""):
            return None
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.last[[i for t, i in rules["model"]["vocab"].items() if t.endswith(suffix)]] = True
        model = Tokenizer(self.tokenizer.model)
        model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return model

    def _clear(self):
        self.known: dict[bytes, int] = {}
        self.flat, self.at, self.size = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def rest(self):
        """Between tasks: an idle worker holds no large table and no free pages of Arrow's."""
        if len(self.known) > KEPT_BETWEEN_TASKS:
            self._clear()
        pa.default_memory_pool().release_unused()

    def _add(self, pieces: list[bytes], ids: np.ndarray, size: np.ndarray):
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while n + len(pieces) > len(self.at):
            self.at, self.size = (np.append(x, np.zeros_like(x)) for x in (self.at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(pieces)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(pieces)] = size
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The place of each piece in the table."""
        if len(self.known) + len(pieces) > KEPT_PIECES:
            self._clear()
        known = self.known
        new = [p for p in pieces if p not in known]
        if self.plain:
            letters = [p for p in new if PLAIN(p)]
            for lo in range(0, len(letters), 8192):
                part = letters[lo : lo + 8192]
                ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode().lower()], add_special_tokens=False)[0].ids, dtype=np.uint32)
                ends = np.flatnonzero(self.last[ids])
                if len(ends) != len(part):
                    raise ValueError("the vocabulary doesn't end each word once")
                self._add(part, ids, np.diff(ends, prepend=-1))
            new = [p for p in new if p not in known]
        apart = [p for p in new if self.bar is None or BAR in p or b"<" in p]
        if apart:
            each = [e.ids for e in self.tokenizer.encode_batch([p.decode() for p in apart], add_special_tokens=False)]
            self._add(apart, np.fromiter(itertools.chain.from_iterable(each), dtype=np.uint32), np.array([len(x) for x in each], dtype=np.int64))
            new = [p for p in new if p not in known]
        for lo in range(0, len(new), 8192):
            part = new[lo : lo + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([(b" " + BAR + b" ").join(part).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            bars = np.flatnonzero(ids == self.bar)
            if len(bars) != len(part) - 1:
                raise ValueError("the vocabulary joins pieces across white space")
            size = np.diff(np.concatenate([[-1], bars, [len(ids)]])) - 1
            self._add(part, np.delete(ids, bars), size)
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each closed by the end id; where each document's ids start)."""
        n = len(offsets) - 1
        starts, ends, doc = split_words(raw, offsets)
        if len(starts):
            low = LOWER[raw]
            marked = np.add.reduceat((raw == 0x3C).astype(np.int64), starts) > 0
            for a, b in zip(starts[marked].tolist(), ends[marked].tolist(), strict=True):
                low[a:b] = raw[a:b]
            cut = np.flatnonzero(CLOSERS[raw[1:]] & LETTERS[raw[:-1]]) + 1
            owner = np.searchsorted(starts, cut, side="right") - 1
            inner = (starts[owner] < cut) & (cut < ends[owner]) & ~marked[owner]
            cut, owner = cut[inner], owner[inner]
            doc = np.insert(doc, owner + 1, doc[owner])
            starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
            raw = low
        coded = pc.dictionary_encode(binary_array(raw, starts, ends))
        table = self._numbers(coded.dictionary.to_pylist())
        size, at = self.size[table], self.at[table]
        word = np.asarray(coded.indices, dtype=np.int64)
        held = size[word] if len(word) else np.zeros(0, dtype=np.int64)
        total = np.bincount(doc, weights=held, minlength=n).astype(np.int64) + 1
        first = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(total, out=first[1:])
        out = np.full(first[-1], self.end_id, dtype=np.uint32)
        before = np.cumsum(held) - held
        within = np.arange(int(held.sum())) - np.repeat(before, held)
        # each document's end id moves what follows by one
        out[np.repeat(before + doc, held) + within] = self.flat[np.repeat(at[word], held) + within]
        return out, first


@functools.lru_cache(maxsize=1)
def encoder_of(vocabulary: str, end_id: int) -> Encoder:
    """One encoder a Python worker: Spark gives a worker many tasks, which share its table of pieces."""
    return Encoder(vocabulary, end_id)


def _cut(vocabulary: str, window: int, end_id: int, with_ids: bool):
    def run(batches):
        encoder = encoder_of(vocabulary, end_id)
        for batch in batches:
            raw, offsets = text_buffer(batch.column("_t"))
            key, shard = batch.column("_id").to_pylist(), batch.column("_shard").to_pylist()
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                o = offsets[lo : hi + 1]
                ids, first = encoder.encode(raw[o[0] : o[-1]], o - o[0])
                cols = [[], [], [], [], [], [], []]
                for d in range(hi - lo):
                    own = ids[first[d] : first[d + 1]]
                    for a in range(0, len(own), window):
                        piece = own[a : a + window]
                        data = piece.astype("<u4").tobytes()
                        for col, v in zip(cols, (shard[lo + d], key[lo + d], a, len(piece), zlib.crc32(data), len(own), piece if with_ids else None), strict=True):
                            col.append(v)
                kinds = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())]
                names = ["_shard", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                keep = 7 if with_ids else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:keep], kinds, strict=False)], names=names[:keep])
        encoder.rest()

    return run


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of lengths with their counts, the multiset whose sum is the largest one up to room."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, t = min(counts[length], room // length), 1
        while left:  # counts by powers of two, so that each takes a few shifts
            t = min(t, left)
            steps.append((length, t, reach))
            reach |= (reach << (t * length)) & mask
            left -= t
            t *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, t, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + t
            at -= t * length
    return used


def minimum_slack(lengths: list[int], window: int) -> list[list[int]]:
    """Indices of `lengths`, in sequences that hold at most `window` together."""
    rows: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        rows.setdefault(n, []).append(i)
    counts = {n: len(x) for n, x in rows.items()}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        pick = closest_multiset(counts, window - longest)
        counts[longest] = counts.get(longest, 0) + 1
        pick[longest] = pick.get(longest, 0) + 1
        for _ in range(min(counts[n] // c for n, c in pick.items())):
            out.append([rows[n].pop() for n, c in pick.items() for _ in range(c)])
            for n, c in pick.items():
                counts[n] -= c
        counts = {n: c for n, c in counts.items() if c}
    return out


def _pack(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        length = np.asarray(table["length"])
        base = table["_shard"][0].as_py() << 32
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        whole = np.flatnonzero(length == window)
        sequence[whole] = base + np.arange(len(whole))
        rest = np.flatnonzero(length < window)
        for s, members in enumerate(minimum_slack(length[rest].tolist(), window)):
            at = 0
            for i in rest[members].tolist():
                sequence[i], offset[i] = base + len(whole) + s, at
                at += length[i]
        return table.drop_columns(["_shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, docs_per_shard: int = DOCS_PER_SHARD, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset.

    with_ids also carries each piece's token ids through the shards' shuffle.
    """
    shards = max(1, -(-docs.count() // docs_per_shard))
    shard = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(shards)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"), shard.alias("_shard"))
    more = ", ids array<int>" if with_ids else ""
    pieces = rows.mapInArrow(_cut(vocabulary or default_vocabulary(), window, end_id, with_ids), f"_shard int, {PIECES}{more}")
    return pieces.groupBy("_shard").applyInArrow(_pack(window), f"{PIECES}{more}, sequence_id long, offset long")
