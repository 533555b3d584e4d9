"""Near-duplicate detection by Order MinHash.

A text's k-mers are its 5-word shingles (words: runs of ASCII letters and digits
and of characters beyond ASCII, in lower case), labelled by occurrence so that
repeats differ. Each of `sketches` hash orders takes the `sampled` smallest
labelled k-mers and keeps them IN THEIR TEXT ORDER: two texts agree in a sketch
if they share these k-mers in one order, so agreement follows edit similarity and
not just the sets.

1. Equal texts become one node.
2. Nodes that agree in a sketch meet in its bucket. A bucket's first candidates
   are a star: each member with one member of it, chosen by a hash order that
   differs from bucket to bucket. An aggregate a bucket and a join, whatever its size.
3. Of a node's candidates the one that agrees most is verified first. Candidates
   of different classes after that are verified in a second pass; those within one
   class already need not be.
4. Verification aligns the two WORD sequences in a band: their edit distance is at
   most (1 - `similarity`) of the longer one's length (bit-parallel, exact, in
   memory linear in the texts).
5. Classes are the connected components of verified pairs (alternating stars).
6. A bucket that still holds several classes compares all its pairs of different
   classes. One of at most SMALL members does so by a join. A larger one holds texts
   around a common passage: its members are dealt into tiles by length, and tiles
   meet where lengths allow. Counts of hashed words bound the edit distance from
   below, what is left is verified, and classes joined meanwhile are passed over.

Pairs of one class or of lengths too far apart are passed over. So every pair that
agrees in one sketch is a candidate, whatever the size of the bucket; a tile pair is
bounded in memory, their number grows with the square of the texts of like length
that share a passage. With 24 sketches of 2, a pair whose
shingles have a Jaccard share of 0.42 (one word in ten substituted, scattered)
agrees in one with a probability of 0.99, one of 0.67 (shingle edit similarity 0.8)
with 0.999999.

Cases: null texts are classes of their own; equal texts, empty ones too, are one
class; texts without words match only equal texts; texts of under five words are
one shingle; rows that share an id but not their text are told apart, and their
nodes named by a hash; rows without an id are named by a hash of their text; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import BYTE_CODES, chunks, gram_hashes, mix64, rolling, split_words, text_buffer
from tidemark.llm.decontaminate import WORD_BYTES
from tidemark.llm.shared import written

SHINGLE_WORDS = 5
SKETCHES = 24
SAMPLED = 2
SIMILARITY = 0.8
#: Members up to which a bucket of several classes compares all pairs by a join; larger ones do so by tiles.
SMALL = 48
#: Members and words of a tile, on average.
TILE, TILE_WORDS = 1024, 1 << 18
#: Counts of hashed words of a text, and how many of them are added up for the first look.
BINS, FOLD = 1024, 16
#: Nodes' least neighbours are broadcast up to this size, at so many bytes an edge: its two nodes in a hashed table.
BROADCAST_BYTES, EDGE_BYTES = 32 << 20, 128
#: No longer read: large buckets have no common shingles to send. Callers may still set it.
BROADCAST_SHINGLES = 1 << 20
CHUNK_BYTES = 1 << 19


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, document) of lower-case texts in text order, and each document's number of words."""
    starts, ends, doc = split_words(raw, offsets, WORD_BYTES)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), doc, np.zeros(n, dtype=np.int64)
    words = mix64(rolling(BYTE_CODES[raw])(starts, ends) + (ends - starts).astype(np.uint64))
    return *shingles_of(words, doc, n, k), np.bincount(doc, minlength=n)


def shingles_of(words: np.ndarray, doc: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(doc, minlength=n)
    first = np.cumsum(size) - size
    grams = gram_hashes(words, k)
    whole = np.flatnonzero(doc[: len(grams)] == doc[k - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((size > 0) & (size < k))
    if not len(short):
        return grams[whole], doc[whole]
    small = mix64(rolling(words)(first[short], first[short] + size[short]) + size[short].astype(np.uint64))
    order = np.argsort(np.concatenate([doc[whole], short]), kind="stable")
    return np.concatenate([grams[whole], small])[order], np.concatenate([doc[whole], short])[order]


def sketch(grams: np.ndarray, doc: np.ndarray, n: int, sketches: int, sampled: int) -> np.ndarray:
    """The Order MinHash of each document with shingles, as sketches x documents of 64 bits."""
    size = np.bincount(doc, minlength=n)
    held = np.flatnonzero(size)
    count = size[held]
    first = np.cumsum(count) - count
    # label repeats of a shingle in a document by their number
    order = np.lexsort((grams, doc))
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[order][1:] != grams[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    start = np.flatnonzero(new)
    label = np.empty(len(grams), dtype=np.uint64)
    label[order] = np.arange(len(grams)) - start[np.cumsum(new) - 1]
    labelled = mix64(grams + label * np.uint64(0xC2B2AE3D27D4EB4F))
    own = np.repeat(np.arange(len(held)), count)
    top = np.uint64((1 << 64) - 1)
    out = np.empty((sketches, len(held)), dtype=np.uint64)
    for j in range(sketches):
        salt = mix64(np.array([2 * j + 1, 2 * j + 2], dtype=np.uint64))
        value = (labelled ^ salt[0]) * (salt[1] | np.uint64(1))
        places = []
        for _ in range(sampled):
            least = np.minimum.reduceat(value, first)
            at = np.flatnonzero(value == least[own])
            lead = np.ones(len(at), dtype=bool)
            lead[1:] = own[at][1:] != own[at][:-1]
            at = at[lead]
            places.append(at)
            value[at] = top
        code = np.full(len(held), salt[0], dtype=np.uint64)
        for at in np.sort(np.stack(places), axis=0):
            code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + grams[at])
        out[j] = code
    return out


def _sketch(k: int, sketches: int, sampled: int):
    """Of each text: its sketches and its number of words."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("_l"))
            lists: list = [None] * batch.num_rows
            sizes = np.zeros(batch.num_rows, dtype=np.int32)
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                o = offsets[lo : hi + 1]
                grams, doc, words = shingles(raw[o[0] : o[-1]], o - o[0], k)
                sizes[lo:hi] = words
                if len(grams):
                    codes = sketch(grams, doc, hi - lo, sketches, sampled).view(np.int64)
                    for d, i in enumerate(np.unique(doc).tolist()):
                        lists[lo + i] = codes[:, d]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_n", "_x", "_b", "_m")), pa.array(lists, pa.list_(pa.int64())), pa.array(sizes)], names=["_n", "_x", "_b", "_m", "codes", "k"])

    return run


def banded_distance(a: list[int], b: list[int], band: int) -> int:
    """Edit distance of two sequences if it is at most `band`, else a larger number.

    Bit-parallel rows of vertical differences, kept for the 2 * band + 1 places
    around the diagonal and moved along it by one bit a step.
    """
    m, n = len(a), len(b)
    if abs(m - n) > band:
        return band + 1
    width = 2 * band + 1
    mask, bottom = (1 << width) - 1, 1 << (width - 1)
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    # bit r of step j stands for place j - band + r of a; places before a fall by one each, so that step j starts at j
    less = (1 << (band + 1)) - 1
    more = mask ^ less
    score = band
    for j, x in enumerate(b, 1):
        more = (more >> 1) | bottom
        less >>= 1
        shift = j - band - 1
        hit = 0
        if places := where.get(x):
            for i in places[bisect_left(places, shift) :]:
                if i - shift >= width:
                    break
                hit |= 1 << (i - shift)
        diagonal = (((hit & more) + more) ^ more) | hit | less
        right = less | (mask & ~(diagonal | more))
        left = more & diagonal
        if not diagonal & bottom:
            score += 1
        across = hit | less
        right = ((right << 1) | 1) & mask
        left = (left << 1) & mask
        more = left | (mask & ~(across | right))
        less = right & across
    above = m - n + band
    return score - (more >> (above + 1)).bit_count() + (less >> (above + 1)).bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the edit similarity of two sequences is at least `similarity`; narrow bands are tried first."""
    longest = max(len(a), len(b))
    if not len(a) or not len(b):
        return False
    most = int((1 - similarity) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    a, b = a[head:], b[head:]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(differ[0]) if len(differ) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= most
    if len(a) == len(b) and np.count_nonzero(a != b) <= most:
        return True
    # at least as many edits as the longer one has elements that the other lacks
    (x, p), (y, q) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = max(len(a), len(b)) - int(np.minimum(p[i], q[j]).sum())
    if least > most:
        return False
    a, b, band = a.tolist(), b.tolist(), min(most, max(64, 2 * least))
    while True:
        if banded_distance(a, b, band) <= band:
            return True
        if band == most:
            return False
        band = min(most, 4 * band)


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("wa"), batch.column("wb"), strict=True)):
                keep[i] = similar(*(np.frombuffer(v.as_buffer(), dtype="<u4") for v in (x, y)), similarity)
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("a", "b")], names=["a", "b"])

    return run


def _words(batches):
    """The word hashes of each text, four bytes a word."""
    for batch in batches:
        raw, offsets = text_buffer(batch.column("_l"))
        out = []
        for lo, hi in chunks(offsets, CHUNK_BYTES):
            o = offsets[lo : hi + 1]
            starts, ends, doc = split_words(raw[o[0] : o[-1]], o - o[0], WORD_BYTES)
            codes = rolling(BYTE_CODES[raw[o[0] : o[-1]]])(starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
            codes = (mix64(codes + (ends - starts).astype(np.uint64)) >> np.uint64(32)).astype("<u4")
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            out += [codes[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([batch.column("_n"), pa.array(out, pa.binary())], names=["id", "w"])


def components(edges: DataFrame) -> DataFrame:
    """(id, class) of every node of edges (a, b): the class is the component's smallest id. Alternating large and small stars."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())
        before = now
        # a node's least neighbour is broadcast if their counted size allows, so that edges stay where they are
        sent = F.broadcast if now[0] * EDGE_BYTES <= BROADCAST_BYTES else lambda df: df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # edges that occur twice here go with the small stars'
        large = both.join(sent(least), "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").filter("u != v").distinct(), "edges")


class Verifier:
    """Verifies pairs (a, b) of nodes, each once, and keeps the classes so far."""

    def __init__(self, words: DataFrame, similarity: float):
        self.words, self.similarity = words, similarity
        self.joined: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame:
        left = pairs.select("a", "b").join(self.words.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a")
        return left.join(self.words.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b").mapInArrow(_verify(self.similarity), "a long, b long")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose nodes lie in different classes."""
        of = lambda c: self.joined.select(F.col("id").alias(c), F.col("class").alias(f"c{c}"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    def add(self, links: DataFrame) -> None:
        links = written(links, "links")
        if self.joined is None:
            self.joined = components(links)
        elif not links.isEmpty():
            self.joined = components(self.joined.select(F.col("id").alias("a"), F.col("class").alias("b")).unionByName(links))


def near_lengths(ka: str, kb: str, similarity: float) -> Column:
    return F.abs(F.col(ka) - F.col(kb)) <= F.floor(F.lit(1 - similarity) * F.greatest(ka, kb) + 1e-9)


def starred(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of buckets s of two or more with the bucket's size n, the pairs of each with the hub of its bucket and how often they meet)."""
    order = F.xxhash64("s", F.lit(0))
    stars = members.groupBy("s").agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(order)).alias("hub")).filter("n > 1")
    met = written(members.join(stars, "s").select(*members.columns, "n", F.col("hub").bitwiseXOR(order).alias("hub")), "buckets")
    pairs = met.filter("id != hub").groupBy(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).agg(F.count("*").alias("votes"))
    return met.drop("hub"), written(pairs, "pairs")


def _mixed(met: DataFrame, verifier: Verifier) -> DataFrame:
    """The members of buckets that hold several classes, with their classes."""
    own = met.join(verifier.joined, "id", "left").select(*met.columns, F.coalesce("class", "id").alias("class"))
    mixed = own.groupBy("s").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("s")
    return written(own.join(mixed, "s"), "open")


def _compare_all(own: DataFrame, verifier: Verifier) -> None:
    """Links the members of each bucket, all pairs of different classes."""
    left, right = (own.select("s", F.col("id").alias(c), F.col("k").alias(f"k{c}"), F.col("class").alias(f"c{c}")) for c in "ab")
    pairs = left.join(right, "s").filter("a < b and ca != cb").filter(near_lengths("ka", "kb", verifier.similarity)).select("a", "b").distinct()
    verifier.add(verifier.links(written(pairs, "pairs")))


def _counts(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text's hashed words, up to 255, and sums of FOLD of them."""
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    fine = np.bincount(doc * BINS + np.concatenate(words) % BINS, minlength=len(words) * BINS).reshape(len(words), BINS)
    fine = np.minimum(fine, 255).astype(np.int16)
    return fine, fine.reshape(len(words), FOLD, -1).sum(1, dtype=np.int16)


def _bound(x: np.ndarray, y: np.ndarray, size: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, chunk: int) -> np.ndarray:
    """At least as few edits as pairs (i, j) need: a substitution changes two counts by one, any other edit one count and the length."""
    out = np.abs(size[0][i] - size[1][j])
    for at in range(0, len(i), chunk):
        out[at : at + chunk] += np.abs(x[i[at : at + chunk]] - y[j[at : at + chunk]]).sum(1, dtype=np.int64)
    return (out + 1) // 2


def tile_links(left: tuple, right: tuple, same: bool, similarity: float):
    """Pairs (a, b) of similar texts of two tiles (ids, classes, words) that join different classes; none between classes joined before."""
    (ids, own, words), (others, theirs, that) = left, right
    size = np.array([len(w) for w in words]), np.array([len(w) for w in that])
    (x, xs), (y, ys) = _counts(words), _counts(that)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    most_of = lambda i, j: ((1 - similarity) * np.maximum(size[0][i], size[1][j]) + 1e-9).astype(np.int64)
    rows = max(1, (1 << 18) // len(others))
    for at in range(0, len(ids), rows):
        cut = slice(at, at + rows)
        near = own[cut, None] != theirs[None]
        if same:
            near &= np.arange(len(ids))[cut, None] < np.arange(len(others))[None]
        i, j = np.nonzero(near)
        i += at
        most = most_of(i, j)
        keep = np.abs(size[0][i] - size[1][j]) <= most
        i, j, most = i[keep], j[keep], most[keep]
        keep = _bound(xs, ys, size, i, j, 1 << 15) <= most
        i, j, most = i[keep], j[keep], most[keep]
        least = _bound(x, y, size, i, j, 1 << 11)
        # the likeliest first, since classes that they join need no further look
        order = np.argsort(least, kind="stable")
        for p, q in ((i[n], j[n]) for n in order[least[order] <= most[order]]):
            a, b = find(int(own[p])), find(int(theirs[q]))
            if a != b and similar(words[p], that[q], similarity):
                root[max(a, b)] = min(a, b)
                yield int(ids[p]), int(others[q])


def _meet(similarity: float):
    def members(tile: pa.Array, row: int) -> tuple:
        ids, own, words = tile[row].values.flatten()
        return np.asarray(ids), np.asarray(own), [np.frombuffer(w.as_buffer(), dtype="<u4").astype(np.int64) for w in words]

    def run(batches):
        for batch in batches:
            for row, same in enumerate(batch.column("same").to_pylist()):
                left = members(batch.column("left"), row)
                links = list(tile_links(left, left if same else members(batch.column("right"), row), same, similarity))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _tiled(own: DataFrame, verifier: Verifier) -> DataFrame:
    """Links (a, b) within each bucket of `own` (s, id, k, class) by tiles of like length; lengths of one level or the next may be near."""
    level = F.floor(F.log("k") / (-math.log(min(verifier.similarity, 0.99)) * (1 + 1e-6)))
    own = own.withColumn("level", level)
    sizes = own.groupBy("s", "level").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("k") / TILE_WORDS)).alias("tiles"))
    dealt = own.join(sizes, ["s", "level"]).select("s", "level", F.pmod(F.xxhash64("id", F.lit(1)), "tiles").alias("t"), "id", "class").join(verifier.words, "id")
    tiles = written(dealt.groupBy("s", "level", "t").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.collect_list(F.struct("id", "class", "w")).alias("members")), "tiles")
    names = tiles.select("s", "level", "t", "low", "high")
    a = names.select("s", "level", F.col("t").alias("ta"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.array("level", F.col("level") + 1)).alias("next"))
    b = names.select("s", F.col("level").alias("next"), F.col("t").alias("tb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    met = a.join(b, ["s", "next"]).filter("(level <> next or ta <= tb) and least(la, lb) <> greatest(ha, hb)").withColumn("same", F.expr("level = next and ta = tb"))
    met = met.join(tiles.select("s", "level", F.col("t").alias("ta"), F.col("members").alias("left")), ["s", "level", "ta"])
    of = tiles.select("s", F.col("level").alias("next"), F.col("t").alias("tb"), F.col("members").alias("right"))
    met = met.join(of, ["s", "next", "tb"]).select("same", "left", F.when(~F.col("same"), F.col("right")).alias("right"))
    return met.mapInArrow(_meet(verifier.similarity), "a long, b long")


def settle(met: DataFrame, verifier: Verifier) -> None:
    """Links the classes within each bucket of `met` (s, id, k, n), see step 6."""
    _compare_all(_mixed(met, verifier).filter(F.col("n") <= SMALL), verifier)
    large = _mixed(met.filter(F.col("n") > SMALL), verifier)
    if not large.isEmpty():
        verifier.add(_tiled(large, verifier))


def node_key(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)))


def text_key(text_col: str) -> list[Column]:
    """_x, _b, _m: what tells texts apart (two hashes and the length, so that no two texts meet by chance)."""
    return [F.xxhash64(text_col).alias("_x"), F.octet_length(text_col).alias("_b"), F.hash(text_col).alias("_m")]


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, sketches: int = SKETCHES, sampled: int = SAMPLED, similarity: float = SIMILARITY) -> DataFrame:
    """(_n, _x, _b, _m, id, class) for each text under each id (see node_key) once: id names its row, class is the smallest name of its class."""
    texts = docs.filter(F.col(text_col).isNotNull()).select(node_key(id_col, text_col).alias("_n"), *text_key(text_col), F.lower(text_col).alias("_l"))
    each = written(texts.mapInArrow(_sketch(k, sketches, sampled), "_n long, _x long, _b int, _m int, codes array<long>, k int"), "sketches")
    # a row is named by its id, unless that stands for several texts
    shared = each.groupBy("_n").agg((F.min("_x") != F.max("_x")).alias("several"))
    named = F.when(F.col("several"), F.xxhash64("_n", "_x")).otherwise(F.col("_n"))
    rows = written(each.join(shared, "_n").select(named.alias("name"), "_n", "_x", "_b", "_m", "codes", "k"), "named")
    nodes = written(rows.groupBy("_x", "_b", "_m").agg(F.min("name").alias("id"), F.min_by("codes", "name").alias("codes"), F.min_by("k", "name").alias("k")), "nodes")
    codes = nodes.filter("codes is not null").select("id", "k", "codes")
    held = codes.select("id", "k", F.explode("codes").alias("s")).select("s", "id", "k")
    met, pairs = starred(held)
    needed = met.select("id").distinct()
    words = texts.select(*("_x", "_b", "_m"), "_l").join(nodes.select("_x", "_b", "_m", "id").join(needed, "id").hint("merge"), ["_x", "_b", "_m"])
    words = written(words.select(F.col("id").alias("_n"), "_l").mapInArrow(_words, "id long, w binary").groupBy("id").agg(F.min("w").alias("w")), "words")
    verifier = Verifier(words, similarity)
    ends = pairs.select(F.col("a").alias("u"), "a", "b", "votes").unionByName(pairs.select(F.col("b").alias("u"), "a", "b", "votes"))
    best = ends.groupBy("u").agg(F.max(F.struct("votes", F.negate("a").alias("x"), F.negate("b").alias("y"))).alias("m")).select(F.negate("m.x").alias("a"), F.negate("m.y").alias("b")).distinct()
    best = written(best, "best")
    verifier.add(verifier.links(best))
    verifier.add(verifier.links(written(verifier.apart(pairs.join(best, ["a", "b"], "left_anti")), "pairs")))
    settle(met, verifier)
    named = nodes.select("_x", "_b", "_m", F.col("id").alias("node")).join(verifier.joined.withColumnRenamed("id", "node"), "node", "left")
    of = named.select("_x", "_b", "_m", F.coalesce("class", "node").alias("class"))
    return rows.select(F.col("name").alias("id"), "_n", "_x", "_b", "_m").distinct().join(of, ["_x", "_b", "_m"])


def _classed(docs: DataFrame, id_col: str, text_col: str, columns: list[Column]) -> DataFrame:
    """`columns` of each row of docs with its id and class; rows without a text have their own key as both."""
    rows = docs.select(*columns, node_key(id_col, text_col).alias("_n"), *text_key(text_col))
    found = classes(docs, id_col=id_col, text_col=text_col)
    joined = rows.join(found, ["_n", "_x", "_b", "_m"], "left")
    return joined.withColumn("class", F.coalesce("class", "_n")).withColumn("id", F.coalesce("id", "_n"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, is_kept (whether it represents its class)."""
    rows = _classed(docs, "doc_id", "text", [F.col("doc_id")])
    return rows.select("doc_id", F.col("class").alias("class_id"), (F.col("class") == F.col("id")).alias("is_kept"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that represent their classes, one row each; rows without a text all stay."""
    kept = classes(docs, id_col=id_col, text_col=text_col).filter("id = class").select("_n", "_x", "_b", "_m")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    texts = docs.filter(F.col(text_col).isNotNull()).select(node_key(id_col, text_col).alias("_n"), *text_key(text_col), row)
    # rows of one id and text are equal but for other columns
    one = texts.join(kept, ["_n", "_x", "_b", "_m"], "left_semi").dropDuplicates(["_n", "_x", "_b", "_m"])
    return one.select("_row.*").unionByName(docs.filter(F.col(text_col).isNull()))
