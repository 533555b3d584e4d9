"""WARC archives: written as monolithic gzip, normalised to one member a record, read by a sidecar index.

1. `write_archives`: equal payloads of `min_bytes` or more are grouped by SHA-1 and
   length; the row with the largest id is the response, others revisit it. Each
   task writes its records to archives of one gzip stream each.
2. `normalise`: each archive is inflated once as a stream; every record is written
   again as a gzip member of its own, and a sidecar index (JSON lines) gets its
   offset, length, id and type.
3. `read_archives`: records are read through the index, one member at a time.

Files are named by task attempt, and only those of successful attempts are in the
manifests, so a lost or repeated task leaves nothing that would be read.

Cases: null payloads are empty; a null id never is the largest one; rows with
equal ids and payloads are all responses when that id is the largest; null URLs
read `urn:unknown`; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh, written

MIN_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 18
#: The monolithic archives are read once and so pressed lightly.
FAST, SMALL = 1, 6
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "archive string, records long"


def _store(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _uri(url: str | None) -> str:
    return urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:unknown"


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the response refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(http) + len(payload)}\r\n\r\n"]).encode() + http + payload + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:]) if k}


def records(blocks):
    """(headers, whole record) of each record of an inflated stream that comes in blocks."""
    held = b""
    blocks = iter(blocks)
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            block = next(blocks, None)
            if block is None:
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
            held += block
        head = headers(held[:end])
        size = end + 4 + int(head["content-length"]) + 4
        parts, have = [held], len(held)
        while have < size:
            block = next(blocks, None)
            if block is None:
                raise ValueError("the archive ends within a record")
            parts.append(block)
            have += len(block)
        held = b"".join(parts)
        yield head, held[:size]
        held = held[size:]


def _inflated(stream):
    """The blocks of a gzip file of one member or more, of bounded size each."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(BLOCK):
        while data:
            out = inflate.decompress(data, BLOCK)
            if out:
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data
                inflate = zlib.decompressobj(31)
    if out := inflate.flush():
        yield out


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId():08d}"


def _write(out_dir: str):
    def run(batches):
        store, path = _store(out_dir)
        store.create_dir(path, recursive=True)
        task, n, made = _attempt(), 0, []
        name = sink = press = None
        count = size = 0

        def close():
            sink.write(press.flush())
            sink.close()
            made.append((name, count))

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("_id", "_url", "_digest", "_refers")), strict=True)
            for (page_id, url, digest, refers), text in zip(rows, batch.column("_t"), strict=True):
                if sink is None:
                    name, press, count, size = f"{path}/{task}-{n:04d}.warc.gz", zlib.compressobj(FAST, zlib.DEFLATED, 31), 0, 0
                    sink, n = store.open_output_stream(name, compression=None), n + 1
                raw = record(page_id, url, text.as_buffer().to_pybytes(), digest, refers)
                sink.write(press.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        scheme = out_dir[: len(out_dir) - len(path)] if out_dir.endswith(path) else ""
        yield pa.RecordBatch.from_arrays([pa.array([scheme + a for a, _ in made], pa.string()), pa.array([c for _, c in made], pa.int64())], names=["archive", "records"])

    return run


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives and returns their manifest: archive, records."""
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(payload_col), F.lit("")).alias("_t"))
    rows = rows.withColumn("_digest", F.sha1(F.encode("_t", "UTF-8"))).withColumn("_bytes", F.octet_length("_t"))
    copies = rows.filter(F.col("_bytes") >= min_bytes).groupBy("_digest", "_bytes").agg(F.max("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    other = F.col("_first").isNotNull() & ~F.coalesce(F.col("_id") == F.col("_first"), F.lit(False))
    tagged = rows.join(copies, ["_digest", "_bytes"], "left").withColumn("_refers", F.when(other, F.col("_first")))
    out = fresh(pages.sparkSession, "warc")
    return written(tagged.select("_id", "_url", "_t", "_digest", "_refers").mapInArrow(_write(out), MANIFEST), "warc-manifest")


def _normalise(batches):
    for batch in batches:
        out = [[], []]
        for uri in batch.column("archive").to_pylist():
            store, path = _store(uri)
            base = path.removesuffix(".warc.gz") + f".members-{_attempt()}"
            at = count = 0
            with store.open_input_stream(path, compression=None) as source, store.open_output_stream(f"{base}.warc.gz", compression=None) as sink, store.open_output_stream(f"{base}.index") as index:
                for head, raw in records(_inflated(source)):
                    press = zlib.compressobj(SMALL, zlib.DEFLATED, 31)
                    member = press.compress(raw) + press.flush()
                    sink.write(member)
                    index.write((json.dumps({"offset": at, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]}) + "\n").encode())
                    at, count = at + len(member), count + 1
            for col, v in zip(out, (uri.removesuffix(path) + f"{base}.warc.gz", count), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64())], names=["archive", "records"])


def normalise(archives: DataFrame) -> DataFrame:
    """Writes each archive again with one member a record, an index beside it, and returns their manifest."""
    return written(archives.repartition(_files(archives)).mapInArrow(_normalise, MANIFEST), "warc-members")


def _files(archives: DataFrame) -> int:
    """As many tasks as archives, up to the session's shuffle partitions."""
    return max(1, min(archives.count(), int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"


def _page(name: str | None):
    number = name[len("<urn:page:") : -1] if name else ""
    return int(number) if number else None


def _read(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = _store(uri)
                rows = []
                with store.open_input_file(path) as source, store.open_input_stream(path.removesuffix(".warc.gz") + ".index") as index:
                    for line in _lines(index):
                        entry = json.loads(line)
                        source.seek(entry["offset"])
                        raw = zlib.decompress(source.read(entry["length"]), 31)
                        end = raw.index(b"\r\n\r\n")
                        head = headers(raw[:end])
                        body = raw[end + 4 : -4]
                        cut = body.index(b"\r\n\r\n")
                        http, payload = headers(body[:cut]), body[cut + 4 :]
                        whole = head["warc-type"] == "response"
                        size = len(payload) if whole else int(http["content-length"])
                        digest = hashlib.sha1(payload).hexdigest() if whole else head["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], size, digest, _page(head.get("warc-refers-to")), payload.decode() if whole and with_payload else None))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _lines(stream):
    held = b""
    while block := stream.read(BLOCK):
        *whole, held = (held + block).split(b"\n")
        yield from whole
    if held:
        yield held


def read_archives(members: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """One row per record, read through the index: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    return members.repartition(_files(members)).mapInArrow(_read(with_payload), RECORDS)


def digest(pages: DataFrame) -> DataFrame:
    """One row per page, after a round through the archives."""
    back = read_archives(normalise(write_archives(pages)), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as payload_digest from p),
g as (select payload_digest, payload_bytes, max(page_id) as m from q where payload_bytes >= 1000 group by all having count(*) > 1)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when m is not null and page_id is distinct from m then 'revisit' else 'response' end as record_type,
  case when m is not null and page_id is distinct from m then m end as refers_to
from q left join g using (payload_digest, payload_bytes)
"""
