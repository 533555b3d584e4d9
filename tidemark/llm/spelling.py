"""Spelling variants: words one edit apart, by a rare-first prefix filter on positional bigrams.

1. Words are counted over all whole texts: runs of A-Z, a-z and U+00C0 to U+00FF,
   A-Z lower-cased. Each task counts a chunk of text at a time, so a hot word
   travels once a chunk and is summed before and after the shuffle.
2. Bigrams with their positions are ordered globally by frequency, rarest first. One
   edit spoils at most two bigrams of a word, so of two words one edit apart the
   first bigram that both keep is among the three rarest of either: only these join.
   Bigrams stand for their hash of GRAM_BITS bits; what one hash stands for counts
   as one bigram, which changes the order and no result. So a table of 2**GRAM_BITS
   counts is sent to the tasks, whatever the alphabet.
3. Position limits: words of equal length differ by a replacement and keep the
   bigram's position; of a word with one character more the position is equal or
   one higher. And the edit lies on one side of the shorter word's middle, so that
   the other half stands in both: the half belongs to the key, which divides the
   buckets of bigrams that many words have.
4. A pair that meets is verified: its sets of letters, then the edit distance.

A word's form is its near word of the largest count, if that is at least `ratio`
times its own; counts grow along forms, so the root is reached by pointer doubling,
in as many rounds as the logarithm of the longest possible chain.

The query's misspellings (see `words`) are derived from checksums of id and word.

Cases: null and empty texts have no words; a null id counts as an empty text in
checksums; repeated rows count as often as they occur; words of any length are
kept whole, those of fewer than 4 code points can't be asked for; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import binary_array, chunks, mix64, rolling, split_words, text_buffer
from tidemark.llm.checksums import crc32s
from tidemark.llm.shared import written

#: One word in SPOILT of a document loses a character.
SPOILT = 97
LEAST_CHARS = 5
LEAST_COUNT = 3
RATIO = 2
PREFIX = 3
CHUNK_BYTES = 1 << 22
GRAM_BITS = 16

LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: What _letters says of a byte.
INSIDE = np.array([False, True])
#: The first byte of U+00C0 to U+00FF in UTF-8; every byte that follows it is such a character's.
LATIN_LEAD = 0xC3


def _letters(raw: np.ndarray) -> np.ndarray:
    inside = LETTERS[raw]
    lead = raw == LATIN_LEAD
    inside |= lead
    inside[1:] |= lead[:-1]
    return inside


def _without(word: bytes, checksum: int) -> bytes:
    """The word without its code point at checksum % length."""
    text = word.decode()
    at = checksum % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _counts(spoilt: int, least_chars: int):
    """(word, n) of each chunk of text, at most one row a different word; spoilt 0: all words as they stand."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column("_t"))
            before = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column("_i").to_pylist()], dtype=np.uint32)
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                o = offsets[lo : hi + 1] - offsets[lo]
                low = LOWER[raw[offsets[lo] : offsets[hi]]]
                starts, ends, doc = split_words(_letters(low).view(np.uint8), o, INSIDE)
                leads = np.append(0, np.cumsum(low == LATIN_LEAD))
                kept = np.flatnonzero(ends - starts - leads[ends] + leads[starts] >= least_chars)
                starts, ends, doc = starts[kept], ends[kept], doc[kept]
                changed = np.zeros(len(starts), dtype=bool)
                extra = []
                if spoilt:
                    checksum = crc32s(low, starts, ends, before[lo:hi][doc])
                    changed = checksum % np.uint32(spoilt) == 0
                    extra = [_without(low[starts[i] : ends[i]].tobytes(), int(checksum[i])) for i in np.flatnonzero(changed).tolist()]
                words = pa.concat_arrays([binary_array(low, starts[~changed], ends[~changed]), pa.array(extra, pa.large_binary())])
                found = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])

    return run


def words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spoilt: int = SPOILT, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): all words of at least least_chars code points and least_count occurrences.

    Where `spoilt` divides the CRC-32 h of "id:word", the code point at h % length is left out first (0: nowhere).
    """
    if least_chars < 4:
        raise ValueError("two bigrams of a shorter word can both be spoilt")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_i"), F.col(text_col).alias("_t"))
    found = rows.mapInArrow(_counts(spoilt, least_chars), "word binary, n long").select(F.col("word").cast("string").alias("word"), "n").filter(F.char_length("word") >= least_chars)
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _bigrams(column: pa.Array):
    """(code points, first place of each word, length of each, bigram hash at each place) of a column of words."""
    raw = "".join(column.to_pylist()).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
    size = np.asarray(pc.utf8_length(column)).astype(np.int64)
    grams = mix64(codes[:-1] << np.uint64(32) | codes[1:]) >> np.uint64(64 - GRAM_BITS)
    return codes, np.cumsum(size) - size, size, grams.astype(np.int64)


def _frequencies(batches):
    held = np.zeros(1 << GRAM_BITS, dtype=np.int64)
    for batch in batches:
        _, first, size, grams = _bigrams(batch.column("word"))
        inside = np.ones(len(grams), dtype=bool)
        inside[first[1:] - 1] = False
        held += np.bincount(grams[inside], minlength=len(held))
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["g", "c"])


def _keys(place: np.ndarray, prefix: int):
    """A word's join keys as the shorter or equal one of a pair, and as the longer one; place: of each bigram in the global order."""

    def run(batches):
        for batch in batches:
            codes, first, size, grams = _bigrams(batch.column("word"))
            n = len(size)
            if not n:
                continue
            word = np.repeat(np.arange(n), size - 1)
            p = np.arange(len(word)) - (first - np.arange(n))[word]
            g = grams[first[word] + p]
            order = np.lexsort((p, place[g], word))
            nth = np.arange(len(word)) - np.repeat(np.cumsum(size - 1) - size + 1, size - 1)
            rare = order[nth < prefix]
            word, g, p = word[rare], g[rare], p[rare]
            text = rolling(mix64(codes + np.uint64(1)))
            stop = first + size

            def of(length: np.ndarray, shift: int, more: int) -> list[np.ndarray]:
                """Keys for the left and the right half, as of a word of that length that has the bigram `shift` places before."""
                half = length // 2
                halves = text(first, first + half), text(first + half + more, stop)
                pure = mix64((length[word] << 40 | p - shift + 1).astype(np.uint64) ^ g.astype(np.uint64) << np.uint64(24))
                return [mix64(pure + h[word] + np.uint64(side)) for side, h in enumerate(halves)]

            own, longer = of(size, 0, 0), [*of(size - 1, 0, 1), *of(size - 1, 1, 1)]
            many = np.bincount(word, minlength=n)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many * len(k))).astype(np.int32)), pa.array(np.stack(k, axis=1).ravel().view(np.int64))) for k in (own, longer)]
            bits = np.bitwise_or.reduceat(np.uint64(1) << codes % np.uint64(64), first)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(bits.view(np.int64)), *lists], names=["word", "n", "bits", "own", "longer"])

    return run


def near_pairs(vocabulary: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(a, na, b, nb): pairs of words that differ by one inserted, deleted or replaced code point, each once."""
    found = vocabulary.select("word").mapInArrow(_frequencies, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).toArrow()
    often = np.zeros(1 << GRAM_BITS, dtype=np.int64)
    often[np.asarray(found["g"])] = np.asarray(found["c"])
    place = np.argsort(np.lexsort((np.arange(len(often)), often))).astype(np.int32)
    rows = written(vocabulary.mapInArrow(_keys(place, prefix), "word string, n long, bits long, own array<long>, longer array<long>"), "keys")
    left = rows.select(F.explode("own").alias("k"), "word", "n", "bits")
    right = left.withColumn("longer", F.lit(False)).unionByName(rows.select(F.explode("longer").alias("k"), "word", "n", "bits", F.lit(True).alias("longer")))
    a, b = left.alias("a"), right.alias("b")
    met = a.join(b, F.expr("a.k = b.k and (b.longer or a.word < b.word) and bit_count(a.bits ^ b.bits) <= 2 and levenshtein(a.word, b.word, 1) = 1"))
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb")).distinct()


def forms(pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n_near, form, form_n) of each word with a near word."""
    both = pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col(f"n{x}").alias("n"), F.col(y).alias("near"), F.col(f"n{y}").alias("near_n")) for x, y in ("ab", "ba")))).alias("r")).select("r.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    chosen = -F.col("best.m") >= ratio * F.col("n")
    return best.select("word", "n_near", F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n"))


def roots(links: DataFrame, rounds: int) -> DataFrame:
    """(word, root) of links (word, form), whose chains have at most 2**rounds links: each round follows what is known twice."""
    links = links.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        links = written(links, "forms")
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return links


def groups(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocabulary = written(vocabulary, "words")
    found = written(forms(near_pairs(vocabulary), ratio), "near")
    # along a chain counts grow by `ratio` from link to link
    least, most = vocabulary.agg(F.min("n"), F.max("n")).first()
    longest = math.floor(math.log(most / least, ratio) + 1e-9) if most else 0
    ends = roots(found.filter("form is not null"), math.ceil(math.log2(longest)) if longest > 1 else 0)
    rows = vocabulary.join(found, "word", "left").join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The groups of the words of all documents."""
    return groups(words(docs))


ORACLE = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents)
  GROUP BY ALL
), summed AS (
  SELECT w, k, xor(4294967295, list_reduce(
    list_transform(range(1, strlen(doc_id || ':' || w) + 1), lambda i: CAST('0x' || substr(hex(encode(doc_id || ':' || w)), CAST(2 * i - 1 AS INT), 2) AS BIGINT)),
    lambda c, x: list_reduce(range(8), lambda s, j: xor(s >> 1, 3988292384 * (s & 1)), xor(c, x)), 4294967295::BIGINT)) AS h
  FROM runs
), changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w, k FROM summed
), words AS (
  SELECT w, CAST(sum(k) AS BIGINT) AS n FROM changed WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3
), holes AS (
  SELECT w, n, i, left(w, CAST(i - 1 AS INT)) || substr(w, CAST(i + 1 AS INT)) AS d FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)
), near AS (
  SELECT a.w AS w, a.n AS n, b.w AS v, b.n AS m FROM holes a JOIN holes b ON a.i = b.i AND a.d = b.d AND a.w <> b.w
  UNION SELECT a.w, a.n, b.w, b.n FROM holes a JOIN words b ON a.d = b.w
  UNION SELECT b.w, b.n, a.w, a.n FROM holes a JOIN words b ON a.d = b.w
), best AS (
  SELECT w, n, v, m, count(*) OVER (PARTITION BY w) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY w ORDER BY m DESC, v) = 1
), linked AS (
  SELECT w AS word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * words.n THEN v END AS form, CASE WHEN m >= 2 * words.n THEN m END AS form_n FROM words LEFT JOIN best USING (w)
), walk AS (
  SELECT word, word AS here, 0 AS steps FROM linked
  UNION ALL SELECT walk.word, linked.form, steps + 1 FROM walk JOIN linked ON linked.word = walk.here WHERE linked.form IS NOT NULL
)
SELECT linked.word, form, root, linked.n, n_near, form_n
FROM linked JOIN (SELECT word, max_by(here, steps) AS root FROM walk GROUP BY word) USING (word)
"""
