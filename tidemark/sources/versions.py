"""Tables whose readers see whole versions only: write, audit, publish.

A table is a folder with `versions/<id>` (Parquet, never changed once written),
`manifests/<id>.json` (rows, digest, files with their bytes and SHA-256, audit
results, the inputs' manifests) and CURRENT, which names the version that readers
follow. A version is written first, its counts are observed by the job that writes it,
they are audited, and only then is CURRENT put in place by one rename. Whatever
stops a writer before that, readers go on with the version before.

Snapshots (rows with a header) are appended the same way: the header comes last, and
rows without one are nobody's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sets import upserted
from tidemark.plans.audits import Check, failures, measures
from tidemark.sources.files import manifest as file_list

POINTER = "CURRENT"


class Folder:
    """Small files of a folder by Spark's own file systems, local or not."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        at = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else self.jvm.java.io.File(self.path).toURI(), spark._jsc.hadoopConfiguration())
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file is there whole or not at all: written beside, then renamed over what is there."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        over = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(over.getClass(), 1)
        options[0] = over
        self.context.rename(self._at(beside), self._at(name), options)

    def names(self, folder: str, suffix: str) -> list[str]:
        if not self.fs.exists(self._at(folder)):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self._at(folder))]
        return sorted(n.removesuffix(suffix) for n in found if n.endswith(suffix))


def current(spark: SparkSession, path: str) -> str | None:
    """The id of the version that readers follow."""
    return Folder(spark, path).read(POINTER)


def read(spark: SparkSession, path: str) -> DataFrame:
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no published version")
    return spark.read.parquet(f"{path.rstrip('/')}/versions/{version}")


def manifest(spark: SparkSession, path: str, version: str | None = None) -> dict | None:
    version = version or current(spark, path)
    text = version and Folder(spark, path).read(f"manifests/{version}.json")
    return json.loads(text) if text else None


def publish(df: DataFrame, path: str, checks: list[Check] = (), *, inputs: dict[str, str] | None = None, after: Callable[[str], None] = lambda step: None) -> dict:
    """Writes df as the next version of the table at path and returns its manifest; AuditFailed, and no new version, if a check fails.

    inputs: names and paths of published tables that df was made of; their versions and digests go into the manifest. after:
    called with the name of each step that is done (written, audited, described, published). The digest doesn't depend on the
    order of rows.
    """
    spark, at = df.sparkSession, path.rstrip("/")
    version = uuid.uuid4().hex
    # counts come from the job that writes, not from another one
    seen = Observation(f"publish-{version}")
    digest = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("hash_xor"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum")]
    df.observe(seen, *digest, *measures(checks)).write.parquet(f"{at}/versions/{version}")
    after("written")
    found = seen.get
    errors, warnings = failures(checks, found)
    after("audited")
    parts = file_list(spark, f"{at}/versions/{version}/*.parquet").orderBy("path").collect()
    sources = {n: {k: (manifest(spark, p) or {}).get(k) for k in ("version", "rows", "digest")} for n, p in (inputs or {}).items()}
    out = {
        "version": version,
        "previous": current(spark, path),
        "rows": found["rows"],
        "digest": f"{found['hash_xor'] & (1 << 64) - 1:016x}-{found['hash_sum']}",
        "columns": dict(df.dtypes),
        "files": [{"name": p.path.rpartition("/")[2], "bytes": p.bytes, "sha256": p.sha256} for p in parts],
        "invariants": {c.name: found[c.name] for c in checks},
        "warnings": warnings,
        "inputs": sources,
    }
    folder = Folder(spark, at)
    folder.put(f"manifests/{version}.json", json.dumps(out, ensure_ascii=False, sort_keys=True))
    after("described")
    if errors:
        from tidemark.plans.audits import AuditFailed

        raise AuditFailed(errors)
    folder.put(POINTER, version)
    after("published")
    return out


def upsert(path: str, new: DataFrame, keys: list[str], checks: list[Check] = (), **options) -> dict:
    """Keyed insert or update, as the table's next version; the first one if there is none."""
    old = current(new.sparkSession, path)
    return publish(new if old is None else upserted(read(new.sparkSession, path), new, keys), path, checks, **options)


def append_snapshot(rows: DataFrame, header: dict, path: str, *, after: Callable[[str], None] = lambda step: None) -> str:
    """Rows and their header together: the id of the snapshot. Readers see it once the header is there."""
    snapshot, at = uuid.uuid4().hex, path.rstrip("/")
    seen = Observation(f"snapshot-{snapshot}")
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{at}/rows/snapshot_id={snapshot}")
    after("written")
    Folder(rows.sparkSession, at).put(f"headers/{snapshot}.json", json.dumps({**header, "snapshot_id": snapshot, "rows": seen.get["rows"]}, ensure_ascii=False, sort_keys=True))
    after("published")
    return snapshot


def headers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per published snapshot: snapshot_id, rows and the header's fields of the schema."""
    at = path.rstrip("/")
    kind = f"snapshot_id string, rows long, {schema}"
    if not Folder(spark, at).names("headers", ".json"):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).json(f"{at}/headers/*.json")


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all published snapshots with their headers' fields."""
    known = headers(spark, path, schema)
    ids = [r.snapshot_id for r in known.select("snapshot_id").collect()]  # one a snapshot, as the folder has files
    if not ids:
        raise FileNotFoundError(f"{path} has no published snapshot")
    at = path.rstrip("/")
    rows = spark.read.option("basePath", f"{at}/rows").parquet(*(f"{at}/rows/snapshot_id={i}" for i in ids))
    return rows.join(F.broadcast(known.drop("rows")), "snapshot_id")
