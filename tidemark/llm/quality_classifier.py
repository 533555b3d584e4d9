"""Quality: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE_WORDS words (or PASSAGE_BYTES, if words
are longer); only the document has a label.

1. Encoding: a passage's features are the shares of hashed byte trigrams and of
   pairs of byte classes (square roots, so that lengths are 1) and a few shares of
   its words (repeated, upper-case, ...). A layer h = tanh(x W + c) encodes them.
2. Gated attention: e = w . (tanh(h V) * sigmoid(h U)); a document's weights are the
   softmax of e over its passages. V, U and w are learned from document labels alone.
3. The weighted sum of encodings is scored by a logistic layer. As that is linear,
   a passage needs but its e and its score: texts of any length are scored in parts.

Training is on a bounded sample (documented parameters): of each class at most
docs_per_class different documents with passages_per_class passages in all and
passages_per_doc in each, taken whole, those of the smallest hashes of id and text;
equal rows are one with their number as weight. So at most 2 * passages_per_class
rows of features, two bytes a value, come to the driver. The bias is moved from the
sample's class shares to those of all labelled rows. Everything else reads all rows.

Cases: null and empty texts are one passage without features and get a score of
their own; rows with a null label don't train; without rows of both classes every
score is the share of label 1 (0 if none is labelled); repeated rows count as often
as they occur; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import BYTE_CODES, SPACES, chunks, rolling, split_words, text_buffer
from tidemark.llm.shared import written
from tidemark.llm.toxicity import BROADCAST_BYTES, held_out

PASSAGE_WORDS = 32
PASSAGE_BYTES = 2048
#: Passages whose features are held at once, and bytes of text of a chunk.
AT_ONCE = 1024
CHUNK_BYTES = 1 << 19
DOCS_PER_CLASS = 1500
PASSAGES_PER_CLASS = 12_000
PASSAGES_PER_DOC = 400
HIDDEN, ATTENTION = 48, 24
EPOCHS, BAGS, RATE, DECAY = 24, 32, 3e-3, 1e-4
THRESHOLD = 0.3

TRIGRAMS = 256
#: Classes of bytes: lower, upper, digit, space, line feed, ends of sentences, other signs, first bytes beyond ASCII, bytes that follow, control.
CLASSES = 10
CLASS = np.full(256, 9, dtype=np.int64)
CLASS[0x21:0x7F] = 6
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A] = 0, 1, 2
CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], CLASS[0x0A] = 3, 4
CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
CLASS[0xC0:], CLASS[0x80:0xC0] = 7, 8
SHAPES = 8
WIDTH = TRIGRAMS + CLASSES * CLASSES + SHAPES


def passages(raw: np.ndarray, offsets: np.ndarray):
    """(first byte, end, document) of the passages: at least one a document; together they are all bytes."""
    starts, _, doc = split_words(raw, offsets)
    size = np.bincount(doc, minlength=len(offsets) - 1)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(size) - size, size)
    cuts = starts[(nth % PASSAGE_WORDS == 0) & (nth > 0)]
    first = np.unique(np.concatenate([offsets[:-1], cuts]))
    first = first[first < len(raw)]
    end = np.append(first[1:], len(raw))
    # long words: the same passage in parts, cut before a character's first byte
    many = np.maximum(-(-(end - first) // PASSAGE_BYTES), 1)
    extra = np.repeat(first, many) + PASSAGE_BYTES * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
    for _ in range(3):
        extra -= ((raw[extra] & 0xC0) == 0x80) & (extra > 0) if len(extra) else 0
    first = np.unique(extra)
    # an empty document is an empty passage
    none = offsets[:-1][offsets[1:] == offsets[:-1]]
    owner = np.concatenate([np.searchsorted(offsets[1:], first, side="right"), np.flatnonzero(offsets[1:] == offsets[:-1])])
    order = np.argsort(owner, kind="stable")
    end = np.concatenate([np.append(first[1:], len(raw))[: len(first)], none])
    return np.concatenate([first, none])[order], end[order], owner[order]


def _shares(where: np.ndarray, what: np.ndarray, n: int, width: int) -> np.ndarray:
    """Square roots of the shares of `what` in each of n passages."""
    found = np.bincount(where * width + what, minlength=n * width).reshape(n, width)
    return np.sqrt(found / np.maximum(found.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def features(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row for each passage; the passages follow each other in raw, from first[0]."""
    n, base = len(first), first[0] if len(first) else 0
    own = raw[base : end[-1]] if n else raw[:0]
    size = end - first
    where = np.repeat(np.arange(n), size)
    wide = own.astype(np.uint32)
    gram = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(24)
    inside = where[2:] == where[:-2] if len(own) > 2 else np.zeros(0, dtype=bool)
    kind = CLASS[own]
    pair = where[1:] == where[:-1] if len(own) > 1 else np.zeros(0, dtype=bool)
    offsets = np.append(first - base, len(own))
    starts, stops, doc = split_words(own, offsets)
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    length = stops - starts
    code = rolling(BYTE_CODES[own])(starts, stops) if len(starts) else np.zeros(0, dtype=np.uint64)
    again = np.append(False, (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])) if len(code) else np.zeros(0, dtype=bool)
    order = np.lexsort((code, doc))
    new = np.append(True, (code[order][1:] != code[order][:-1]) | (doc[order][1:] != doc[order][:-1])) if len(code) else np.zeros(0, dtype=bool)
    per = lambda which, by: np.bincount(which, minlength=n) / by
    upper, sign = np.bincount(where, kind == 1, n), np.bincount(where, kind == 6, n)
    ends_in_sign = kind[stops - 1] == 6 if len(stops) else np.zeros(0, dtype=bool)
    bytes_ = np.maximum(size, 1)
    shape = np.stack([per(doc[again], count), per(doc[order][new], count), upper / bytes_, sign / bytes_, per(doc[ends_in_sign], count), np.minimum(np.bincount(doc, length, n) / count / 20, 1), np.minimum(count / PASSAGE_WORDS, 1), size == 0], axis=1)
    return np.concatenate([_shares(where[2:][inside], gram[inside].astype(np.int64), n, TRIGRAMS), _shares(where[1:][pair], (kind[:-1] * CLASSES + kind[1:])[pair], n, CLASSES * CLASSES), shape.astype(np.float32)], axis=1)


@dataclass
class Model:
    """The layers; without `encode` every score is the bias's."""

    bias: float
    encode: np.ndarray | None = None
    shift: np.ndarray | None = None
    look: np.ndarray | None = None
    gate: np.ndarray | None = None
    weigh: np.ndarray | None = None
    judge: np.ndarray | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def attended(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(attention before the softmax, score) of each passage's features."""
    h = np.tanh(x @ model.encode + model.shift)
    return (np.tanh(h @ model.look) * _sigmoid(h @ model.gate)) @ model.weigh, h @ model.judge


def pooled(e: np.ndarray, v: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The mean of v under the softmax of e, for each bag from start[i]; bags aren't empty."""
    size = np.diff(np.append(start, len(e)))
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
    return np.add.reduceat(a * v, start) / np.add.reduceat(a, start)


def fit(x: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on mini-batches of bags; bag i has the rows of x from start[i] on."""
    rng = np.random.default_rng(seed)
    size = np.diff(np.append(start, len(x)))
    weight = weight / weight.mean()
    p = [rng.normal(0, 1 / np.sqrt(n), (n, m)) for n, m in ((x.shape[1], HIDDEN), (HIDDEN, ATTENTION), (HIDDEN, ATTENTION))]
    p = [p[0] * 4, np.zeros(HIDDEN), p[1], p[2], rng.normal(0, 0.3, ATTENTION), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    p = [a.astype(np.float32) for a in p]
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    first, second, steps = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        shuffled = rng.permutation(len(y))
        for lo in range(0, len(y), BAGS):
            own = shuffled[lo : lo + BAGS]
            n = size[own]
            at = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            bag, cut = np.repeat(np.arange(len(own)), n), np.cumsum(n) - n
            rows = x[at].astype(np.float32)
            h = np.tanh(rows @ p[0] + p[1])
            t, g = np.tanh(h @ p[2]), _sigmoid(h @ p[3])
            e = (t * g) @ p[4]
            a = np.exp(e - np.maximum.reduceat(e, cut)[bag])
            a /= np.add.reduceat(a, cut)[bag]
            z = np.add.reduceat(a[:, None] * h, cut)
            d = (_sigmoid(z @ p[5] + p[6]) - y[own]) * weight[own] / len(own)
            dz = d[:, None] * p[5]
            da = (h * dz[bag]).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, cut)[bag])
            dt, dg = de[:, None] * p[4] * g * (1 - t * t), de[:, None] * p[4] * t * g * (1 - g)
            dh = (a[:, None] * dz[bag] + dt @ p[2].T + dg @ p[3].T) * (1 - h * h)
            grads = [rows.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ d, d.sum(keepdims=True)]
            steps += 1
            for i, grad in enumerate(grads):
                grad = grad + DECAY * p[i]
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                p[i] = p[i] - rate * first[i] / (1 - 0.9**steps) / (np.sqrt(second[i] / (1 - 0.999**steps)) + 1e-8)
    return Model(float(p[6][0]), *(a.astype(np.float32) for a in p[:6]))


def _sizes(batches):
    """Each text's number of passages."""
    for batch in batches:
        raw, offsets = text_buffer(batch.column("_t"))
        many = np.zeros(len(offsets) - 1, dtype=np.int64)
        for lo, hi in chunks(offsets, CHUNK_BYTES):
            _, _, owner = passages(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            many[lo:hi] = np.bincount(owner, minlength=hi - lo)
        yield pa.RecordBatch.from_arrays([batch.column("_p"), batch.column("_i"), batch.column("_y"), batch.column("_t"), batch.column("weight"), pa.array(many)], names=["_p", "_i", "_y", "_t", "weight", "many"])


def _encoded(batches):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("_t"))
        out = []
        for i in range(len(offsets) - 1):
            own = raw[offsets[i] : offsets[i + 1]]
            first, end, _ = passages(own, np.array([0, len(own)]))
            out.append(features(own, first, end).astype("<f2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("weight"), pa.array(out, pa.binary())], names=["y", "weight", "x"])


def drawn(rows: DataFrame, shares: dict[int, int], docs_per_class: int, passages_per_class: int, passages_per_doc: int) -> DataFrame:
    """(_t, _y, weight, many): the sample of each class, see the module."""
    place = F.pmod(F.xxhash64("_i", "_t", F.lit(29)), F.lit(1 << 40))
    enough = F.lit(float(1 << 40))
    for y, n in shares.items():
        # more than will be needed, so that few texts travel
        enough = F.when(F.col("_y") == y, min(1.0, 3 * docs_per_class / n + 60 / n) * (1 << 40)).otherwise(enough)
    each = rows.withColumn("_p", place).filter(F.col("_p") < enough).groupBy("_p", "_i", "_y", "_t").agg(F.count("*").alias("weight"))
    sized = written(each.mapInArrow(_sizes, "_p long, _i long, _y int, _t string, weight long, many long"), "sample").filter(F.col("many") <= passages_per_doc)
    picked = []
    for y in shares:
        few = sized.filter(F.col("_y") == y).select("_p", "_i", "many").orderBy("_p", "_i").limit(docs_per_class)
        picked.append(few.withColumn("_sum", F.sum("many").over(Window.orderBy("_p", "_i").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= passages_per_class).select("_p", "_i"))
    chosen = picked[0]
    for more in picked[1:]:
        chosen = chosen.unionByName(more)
    # at most 2 * docs_per_class rows of numbers
    return sized.withColumn("_k", F.coalesce("_i", F.lit(-1))).join(F.broadcast(chosen.select("_p", F.coalesce("_i", F.lit(-1)).alias("_k"))), ["_p", "_k"], "left_semi").select("_t", "_y", "weight", "many")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_class: int = DOCS_PER_CLASS, passages_per_class: int = PASSAGES_PER_CLASS, passages_per_doc: int = PASSAGES_PER_DOC, epochs: int = EPOCHS) -> Model:
    """The model of the labelled rows of docs. A document with several labels has the largest one."""
    known = labels.select(F.col(id_col).cast("long").alias("_i"), F.col(label_col).cast("int").alias("_y")).filter("_i is not null and _y in (0, 1)").groupBy("_i").agg(F.max("_y").alias("_y"))
    if known.count() * 64 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).cast("long").alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(known, "_i")
    shares = {r._y: r.n for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    if not n0 or not n1:
        share = min(max(n1 / max(n0 + n1, 1), 1e-9), 1 - 1e-9)
        return Model(float(np.log(share / (1 - share))))
    # sorted, so that the model doesn't depend on how rows lie
    sample = drawn(rows, shares, docs_per_class, passages_per_class, passages_per_doc).mapInArrow(_encoded, "y int, weight long, x binary").orderBy("y", F.xxhash64("x"), "weight").toArrow()
    y, weight = (np.asarray(sample[c], dtype=np.float64) for c in ("y", "weight"))
    if len(set(y.tolist())) < 2:
        return Model(float(np.log(n1 / n0)))
    each = [np.frombuffer(b, dtype="<f2").reshape(-1, WIDTH) for b in sample["x"].to_pylist()]
    size = np.array([len(b) for b in each])
    model = fit(np.concatenate(each), np.cumsum(size) - size, y, weight, epochs=epochs)
    model.bias += float(np.log(n1 / n0) - np.log(weight[y == 1].sum() / weight[y == 0].sum()))
    return model


def score(text: Column, model: Model) -> Column:
    """The probability of label 1 for a text column."""

    def run(series: pd.Series) -> pd.Series:
        out = np.full(len(series), model.bias)
        if model.encode is not None:
            raw, offsets = text_buffer(pa.array(series, pa.large_string()))
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                own = raw[offsets[lo] : offsets[hi]]
                first, end, owner = passages(own, offsets[lo : hi + 1] - offsets[lo])
                parts = [attended(model, features(own, first[i : i + AT_ONCE], end[i : i + AT_ONCE])) for i in range(0, len(first), AT_ONCE)]
                e, v = (np.concatenate(c) for c in zip(*parts, strict=True))
                out[lo:hi] += pooled(e, v, np.searchsorted(owner, np.arange(hi - lo)))
        return pd.Series(_sigmoid(out))

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; trained on labelled rows that aren't held out."""
    model = train(docs.filter(~held_out()), labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
