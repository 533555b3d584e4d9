"""Quality rules by document and by host.

Every whole text gets its counts and the base rule's verdict. Hosts (a column,
here `source`) then aggregate the failures; their rates shrink towards the
corpus rate with an empirical beta prior (method of moments over hosts, weighted
by documents), and a host whose shrunken rate exceeds `max_rate` fails with all
its documents. Verdicts join back by host.

Cases: null texts have no words and so fail the base rule; rows without a host
are judged by the base rule alone; repeated rows count as often as they occur;
with no document or no spread between hosts all hosts get the corpus rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import SPACES, binary_array, chunks, split_words, text_buffer
from tidemark.llm.shared import written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
CHUNK_BYTES = 1 << 19
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _codes(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def metrics_of(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a buffer."""
    n = len(offsets) - 1
    starts, ends, doc = split_words(raw, offsets)
    words = np.bincount(doc, minlength=n)
    chars = _per_document(SPACES[raw] & ((raw & 0xC0) != 0x80), offsets)
    is_symbol = np.zeros(256, dtype=bool)
    is_symbol[list(SYMBOLS)] = True
    symbols = _per_document(is_symbol[raw], offsets)
    lines = np.zeros(n, dtype=np.int64)
    blob = raw.tobytes()
    for i in np.flatnonzero(_per_document(raw == 0x0A, offsets)).tolist():
        held = [x for x in blob[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i] = len(held) - len(set(held))
    repeats = np.zeros(n, dtype=np.int64)
    if len(doc) > 2:
        number = np.asarray(pc.dictionary_encode(binary_array(raw, starts, ends)).indices, dtype=np.int64)
        three = _codes((_codes((number[:-2] << 32) | number[1:-1]) << 32) | number[2:])
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        key = (doc[whole] << 32) | three[whole]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = whole[order[np.append(same, False) | np.append(False, same)]] if len(whole) else whole
        covered = np.zeros(len(doc), dtype=bool)
        for j in range(3):
            covered[again + j] = True
        repeats = np.bincount(doc[covered], minlength=n)
    return [words, chars, symbols, lines, repeats]


def _metrics(batches):
    for batch in batches:
        raw, offsets = text_buffer(batch.column("_t"))
        parts = [metrics_of(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets, CHUNK_BYTES)]
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * 5
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_host"), *(pa.array(c.astype(np.int64)) for c in cols)], names=["_id", "_host", *(x.split()[0] for x in METRICS.split(", "))])


def document_metrics(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """_id, _host, the counts and base_failed of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_t"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(_metrics, f"_id long, _host string, {METRICS}").withColumn("base_failed", failed)


def host_verdicts(metrics: DataFrame, *, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """_host, its documents, failures, shrunken failure rate and verdict host_ok."""
    hosts = metrics.filter("_host is not null").groupBy("_host").agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    # the moments are one row: numbers of hosts, documents, failures and the weighted squares of rates
    a = hosts.agg(F.count("*").alias("hosts"), F.sum("docs").alias("docs"), F.sum("failures").alias("failures"), F.sum(F.col("failures") * F.col("failures") / F.col("docs")).alias("squares")).first()
    alpha, beta = beta_prior(a.hosts, a.docs, a.failures, a.squares)
    rate = (F.col("failures") + F.lit(alpha)) / (F.col("docs") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= max_rate)


def beta_prior(hosts: int, docs: int | None, failures: int | None, squares: float | None, most: float = 1e6) -> tuple[float, float]:
    """Moments to (alpha, beta). squares: the sum over hosts of failures squared by documents."""
    if not docs:
        return 1.0, 1.0
    mean = failures / docs
    chance = mean * (1 - mean)
    between = squares / docs - mean * mean - chance * hosts / docs
    weight = min(most, max(1.0, chance / between - 1)) if between > 0 else most
    # a corpus without failures, or of failures alone, still leaves both sides possible
    return max(mean * weight, 1e-6), max((1 - mean) * weight, 1e-6)


def judged(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """_id, counts, base_failed, the host's rate and kept of each row of docs."""
    metrics = written(document_metrics(docs, id_col=id_col, host_col=host_col, text_col=text_col), "quality")
    verdicts = host_verdicts(metrics, max_rate=max_rate).select("_host", F.col("rate").alias("host_rate"), "host_ok")
    return metrics.join(verdicts, "_host", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True)))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, the four counts, base_failed, kept."""
    return judged(docs).select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
with t as (select doc_id, source, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select r, i, ws[i:i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
d as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
c as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from d) group by r),
m as (
  select doc_id, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join c using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (select source, count(*) as n, sum(base_failed::int) as f from b where source is not null group by source),
a as (select count(*) as hosts, sum(n) as docs, sum(f) / sum(n) as mean, sum(f * f / n) as squares from h),
p as (select mean, mean * (1 - mean) as chance, squares / docs - mean * mean - mean * (1 - mean) * hosts / docs as between_hosts from a),
q as (select mean, case when between_hosts > 0 then least(1e6, greatest(1.0, chance / between_hosts - 1)) else 1e6 end as weight from p),
v as (select source, (f + greatest(mean * weight, 1e-6)) / (n + greatest(mean * weight, 1e-6) + greatest((1 - mean) * weight, 1e-6)) <= 0.5 as ok from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(ok, true) as kept from b left join v using (source)
"""
