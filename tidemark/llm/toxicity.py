"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased, ASCII signs become spaces, and the n-grams of SIZES
characters are hashed into 2**BITS features; a document has a feature or not.

1. Over ALL training rows, the documents of either class that have a feature are
   counted; r = log((n1 + a) / (N1 + 2a)) - log((n0 + a) / (N0 + 2a)), moved
   towards 0 by `certainty` standard errors. Every feature whose r isn't 0 then
   stays, however many these are.
2. A logistic regression with an L2 penalty is fitted to a sample of at most
   `rows_per_class` different rows of each class (documented bound; those of the
   smallest hashes of id and text, equal rows as one with their number as weight),
   with values r instead of 1. Its bias is moved from the sample's class shares to
   those of all rows.
3. Every whole text is scored where it lies; there is no shuffle of texts.

Cases: null and empty texts have no features and get the bias's score; rows with
a null label don't train; without rows of both classes every score is the share
of toxic rows (0 if none is labelled); repeated rows count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import _BASE, _powers, mix64, text_buffer
from tidemark.llm.shared import written

SIZES = (3, 4, 5, 6)
BITS = 19
ROWS_PER_CLASS = 2500
CERTAINTY = 3.0
SMOOTH = 1.0
PENALTY = 1e-4
STEPS = 240
CHUNK_CHARS = 200_000
#: Labels of up to this size are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

ALNUM = np.zeros(128, dtype=bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    ALNUM[_a:_b] = True


def _parts(texts: list[str]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 2
    if texts:
        yield lo, len(texts)


class Grams:
    """The distinct features of each document, one after the other."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, dtype=np.int32)

    def of(self, texts: list[str]):
        """(place, features) of each of the lower-case texts."""
        for lo, hi in _parts(texts):
            yield from ((lo + d, f) for d, f in enumerate(self._part(texts[lo:hi])))

    def _part(self, texts: list[str]):
        length = np.array([len(t) + 2 for t in texts], dtype=np.int64)
        codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
        sign = codes < 128
        sign[sign] = ~ALNUM[codes[sign]]
        codes[sign] = 0x20
        up, down = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        down = down * _BASE  # the highest bits of an odd multiple are the feature
        hashed = [(((sums[n:] - sums[:-n]) * down[: len(sums) - n] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32) for n in SIZES]
        stop = np.cumsum(length)
        for a, b in zip((stop - length).tolist(), stop.tolist(), strict=True):
            f = np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(SIZES, hashed, strict=True)])
            at = np.arange(len(f), dtype=np.int32)
            self.last[f] = at
            yield f[self.last[f] == at]


def _counts(batches):
    """Of the task's rows: feature, documents of class 0 and of class 1; feature -1 stands for all."""
    held = np.zeros((2, 1 << BITS), dtype=np.int64)
    total = np.zeros(2, dtype=np.int64)
    grams = Grams()
    for batch in batches:
        toxic = np.asarray(batch.column("_y"), dtype=np.int64)
        total += np.bincount(toxic, minlength=2)
        toxic = toxic.tolist()
        for i, f in grams.of(batch.column("_t").to_pylist()):
            held[toxic[i]][f] += 1
    at = np.flatnonzero(held.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *(pa.array(np.append(held[c][at], total[c])) for c in (0, 1))], names=["f", "n0", "n1"])


def _sparse(wanted: np.ndarray):
    def run(batches):
        grams = Grams()
        for batch in batches:
            out = [f[wanted[f]].astype("<i4").tobytes() for _, f in grams.of(batch.column("_t").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("weight"), pa.array(out, pa.binary())], names=["y", "weight", "x"])

    return run


@dataclass
class Model:
    """Weights of all features and the bias."""

    weights: np.ndarray
    bias: float


def fit(start: np.ndarray, column: np.ndarray, y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; row i has the values ratio[column[start[i] : start[i + 1]]].

    Returns the weights of plain features and the bias.
    """
    n, share = len(y), weight / weight.sum()
    size = np.diff(start)
    parts = [(a, min(a + 256, n)) for a in range(0, n, 256)]

    def forward(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for a, b in parts:
            own = np.append(v[column[start[a] : start[b]]], 0.0)
            out[a:b] = np.add.reduceat(own, start[a:b] - start[a]) * (size[a:b] > 0)
        return out

    def back(e: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ratio))
        for a, b in parts:
            out += np.bincount(column[start[a] : start[b]], weights=np.repeat(e[a:b], size[a:b]), minlength=len(ratio))
        return out

    # the step bound: the largest eigenvalue, by power iteration
    v = np.abs(ratio)
    top = 1.0
    for _ in range(8):
        v /= float(np.linalg.norm(v)) or 1.0
        v = ratio * back(share * forward(v * ratio))
        top = float(np.linalg.norm(v)) or 1.0
    step = 1 / (0.25 * (1.1 * top + 1) + penalty)
    w, b = np.zeros(len(ratio)), 0.0
    w_ahead, b_ahead, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w_ahead * ratio) + b_ahead, -40, 40)))
        e = (p - y) * share
        w_new = w_ahead - step * (ratio * back(e) + penalty * w_ahead)
        b_new = b_ahead - step * float(e.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_ahead, b_ahead = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w * ratio, b


def shrunk_ratio(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int, certainty: float) -> np.ndarray:
    """Log-count ratios of features held by c0 of n0 and c1 of n1 documents, moved towards 0 by `certainty` standard errors."""
    ratio = np.log((c1 + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((c0 + SMOOTH) / (n0 + 2 * SMOOTH))
    error = np.sqrt(1 / (c1 + SMOOTH) + 1 / (c0 + SMOOTH) - 1 / (n1 + 2 * SMOOTH) - 1 / (n0 + 2 * SMOOTH))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - certainty * error, 0)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_i, _t, _y) of the rows of docs with a label. A document with several labels has the largest one."""
    known = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y")).filter("_i is not null and _y in (0, 1)").groupBy("_i").agg(F.max("_y").alias("_y"))
    if known.count() * 64 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    return docs.select(F.col(id_col).alias("_i"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t")).join(known, "_i")


def drawn(rows: DataFrame, n0: int, n1: int, rows_per_class: int) -> DataFrame:
    """(_t, _y, weight): at most rows_per_class different rows of each class, those of the smallest hashes; weight: how often each occurs."""
    place = F.pmod(F.xxhash64("_i", "_t", F.lit(17)), F.lit(1 << 40))
    # more than will be needed, so that few rows are sorted; repeated rows can only make it fewer, see below
    share = lambda n: min(1.0, 2 * rows_per_class / n + 50 / n)
    near = rows.withColumn("_p", place).filter(F.col("_p") < F.when(F.col("_y") == 1, share(n1)).otherwise(share(n0)) * (1 << 40))
    each = written(near.groupBy("_p", "_i", "_y", "_t").agg(F.count("*").alias("weight")), "sample")
    few = {r._y: r.n for r in each.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if any(few.get(y, 0) < rows_per_class and share(n) < 1 for y, n in ((0, n0), (1, n1))):
        # many repeated rows: all different ones
        each = written(rows.withColumn("_p", place).groupBy("_p", "_i", "_y", "_t").agg(F.count("*").alias("weight")), "sample")
    halves = [each.filter(F.col("_y") == y).orderBy("_p", "_i").limit(rows_per_class) for y in (0, 1)]
    return halves[0].unionByName(halves[1]).select("_t", "_y", "weight")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", certainty: float = CERTAINTY, rows_per_class: int = ROWS_PER_CLASS, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """The model of the labelled rows of docs."""
    rows = labelled(docs, labels, id_col, text_col, label_col)
    counts = rows.select("_t", "_y").mapInArrow(_counts, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # at most one row a feature
    held = counts.toArrow()
    f, c0, c1 = (np.asarray(held[c]) for c in ("f", "n0", "n1"))
    n0, n1 = (int(c[f < 0].sum()) for c in (c0, c1))
    ratio = np.zeros(1 << BITS)
    if not n0 or not n1:
        share = min(max(n1 / max(n0 + n1, 1), 1e-9), 1 - 1e-9)
        return Model(ratio, float(np.log(share / (1 - share))))
    own = f >= 0
    ratio[f[own]] = shrunk_ratio(c0[own], c1[own], n0, n1, certainty)
    sample = drawn(rows, n0, n1, rows_per_class).mapInArrow(_sparse(ratio != 0), "y int, weight long, x binary").toArrow()
    y, weight = (np.asarray(sample[c], dtype=float) for c in ("y", "weight"))
    parts = [text_buffer(x) for x in sample["x"].chunks]
    size = np.concatenate([np.zeros(0, dtype=np.int64), *(np.diff(o) // 4 for _, o in parts)])
    column = np.concatenate([np.zeros(0, dtype="<i4"), *(np.ascontiguousarray(raw).view("<i4") for raw, _ in parts)])
    del sample, parts
    weights, bias = fit(np.append(0, np.cumsum(size)), column, y, weight, ratio, penalty, steps)
    ones, zeros = weight[y == 1].sum(), weight[y == 0].sum()
    return Model(weights, bias + float(np.log(n1 / n0) - np.log(ones / zeros)))


def score(text: Column, model: Model) -> Column:
    """The probability of label 1 for a text column."""
    weights, bias = model.weights.astype(np.float32), model.bias

    def run(series: pd.Series) -> pd.Series:
        out = np.full(len(series), bias)
        for i, f in Grams().of(series.tolist()):
            out[i] += weights[f].sum(dtype=np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return F.pandas_udf(run, "double")(F.lower(F.coalesce(text, F.lit(""))))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, by the number of folds. A null id reads as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; trained on labelled rows that aren't held out."""
    model = train(docs.filter(~held_out()), labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
