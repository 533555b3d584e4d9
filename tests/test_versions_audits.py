import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import audits
from tidemark.plans.audits import AuditFailed, Check, Reference
from tidemark.sources import versions


class Stopped(Exception):
    pass


def stop_after(name):
    def after(step):
        if step == name:
            raise Stopped(step)

    return after


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id int, v string").repartition(2)


def ids(df):
    return sorted((r.id, r.v) for r in df.collect())


@pytest.mark.parametrize("step", ["written", "audited", "described"])
def test_a_writer_that_stops_leaves_the_version_before(spark, tmp_path, step):
    path = f"file://{tmp_path}/t"
    first = versions.publish(rows(spark, (1, "a"), (2, None)), path)
    with pytest.raises(Stopped):
        versions.upsert(path, rows(spark, (2, "b"), (3, "c")), ["id"], after=stop_after(step))
    assert versions.current(spark, path) == first["version"] and ids(versions.read(spark, path)) == [(1, "a"), (2, None)]
    second = versions.upsert(path, rows(spark, (2, "b"), (3, "c")), ["id"])
    assert second["previous"] == first["version"] and ids(versions.read(spark, path)) == [(1, "a"), (2, "b"), (3, "c")]


def test_manifest_has_rows_digest_files_and_inputs(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    one = versions.publish(rows(spark, (1, "a"), (2, "b"), (2, "b")), a)
    two = versions.publish(rows(spark, (2, "b"), (1, "a"), (2, "b")).coalesce(1), b, inputs={"a": a})
    three = versions.publish(rows(spark, (2, "b"), (1, "a")), c)
    assert one["rows"] == two["rows"] == 3 and one["digest"] == two["digest"] != three["digest"]
    assert two["inputs"] == {"a": {"version": one["version"], "rows": 3, "digest": one["digest"]}} and versions.manifest(spark, b) == json.loads(json.dumps(two))
    held = {f.name: f.stat().st_size for f in (tmp_path / "a" / "versions" / one["version"]).glob("*.parquet")}
    assert {f["name"]: f["bytes"] for f in one["files"]} == held and all(len(f["sha256"]) == 64 for f in one["files"])


def test_a_failing_audit_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    checks = [Check("empty_v", F.col("v").isNull(), "rows without v"), Check("high", F.col("id") > 5, "high ids", "warning", 1)]
    versions.publish(rows(spark, (1, "a"), (7, "x")), path, checks)
    with pytest.raises(AuditFailed) as e:
        versions.publish(rows(spark, (1, None), (7, "x"), (8, "y"), (2, None)), path, checks)
    assert e.value.errors == ["rows without v: 2"] and ids(versions.read(spark, path)) == [(1, "a"), (7, "x")]
    out = versions.publish(rows(spark, (7, "x"), (8, "y")), path, checks)
    assert out["warnings"] == ["high ids: 2"] and out["invariants"] == {"empty_v": 0, "high": 2}
    assert versions.publish(rows(spark).limit(0), str(tmp_path / "none"), checks)["rows"] == 0


def test_snapshots_need_their_header(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert versions.headers(spark, path, "cycle string").count() == 0
    first = versions.append_snapshot(rows(spark, (1, "a")), {"cycle": "x"}, path)
    with pytest.raises(Stopped):
        versions.append_snapshot(rows(spark, (9, "lost")), {"cycle": "y"}, path, after=stop_after("written"))
    second = versions.append_snapshot(rows(spark, (2, "b"), (3, "c")), {"cycle": "z"}, path)
    got = {(r.snapshot_id, r.cycle, r.id) for r in versions.snapshots(spark, path, "cycle string").collect()}
    assert got == {(first, "x", 1), (second, "z", 2), (second, "z", 3)}
    assert {(r.snapshot_id, r.rows) for r in versions.headers(spark, path, "cycle string").collect()} == {(first, 1), (second, 2)}


def test_reading_what_was_never_published(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "nothing"))


def test_observed_counts_need_no_job_of_their_own(spark, tmp_path):
    checks = [Check("empty_v", F.col("v").isNull(), "rows without v"), Check("low", F.col("id") < 2, "low ids", "warning")]
    df, seen = audits.observed(rows(spark, (1, "a"), (2, None), (None, "c")), checks)
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 3, "empty_v": 1, "low": 1}
    with pytest.raises(AuditFailed, match="rows without v: 1"):
        audits.demand(checks, seen)
    assert audits.demand(checks[1:], seen) == ["low ids: 1"]


def test_report_equals_plain_counts(spark):
    units = spark.createDataFrame([(1, 10), (2, 11), (2, 99), (3, None)], "unit int, university int")
    universities = spark.createDataFrame([(10,), (11,), (11,)], "university int")
    checks = [Reference.of("unit_universities", "university", universities, "university", "missing universities"), Check("twos", F.col("unit") == 2, "twos", "warning", 1), Check("fives", F.col("unit") == 5, "fives")]
    r = audits.report({"units": (units, checks), "universities": (universities, [Check("all", F.lit(True), "rows", "error", 3)])}).collect()
    assert len(r) == 1 and r[0].asDict() == {"status": "failed", "errors": ["units: missing universities: 1"], "warnings": ["units: twos: 2"], "rows": {"units": 4, "universities": 3}, "invariants": {"unit_universities": 1, "twos": 2, "fives": 0, "all": 3}}


def test_upsert_of_a_folder_recovers_what_a_stopped_call_moved_aside(spark, tmp_path):
    from tidemark.sources import files

    target, staged = tmp_path / "t", tmp_path / "s"
    rows(spark, (1, "a")).write.parquet(str(target))
    target.rename(tmp_path / "s-before")  # stopped between its two renames
    files.upsert(str(target), rows(spark, (2, "b")), ["id"], str(staged))
    assert ids(spark.read.parquet(str(target))) == [(1, "a"), (2, "b")] and not (tmp_path / "s-before").exists()
