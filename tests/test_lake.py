"""Landed files to tables: readers, replace-by-run writers, load, migrate, prune, receipts, streaming."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lakejobs.functions.naming import rename_if_present
from lakejobs.jobs import load, ops
from lakejobs.operators import coverage, runs
from lakejobs.operators.contract import Contract
from lakejobs.operators.coverage import KEYS
from lakejobs.sources import paths, raw, tables
from lakejobs.operators.staging import Adapt, staging_frame
from lakejobs.streaming.silver import read_silver, stream_silver, upsert

FATAL = Contract({"type": "object", "required": ["fatality_id"], "additionalProperties": False, "properties": {"fatality_id": {"type": "integer"}, "event_id": {"type": "integer"}, "fatality_type": {"type": ["string", "null"]}, "fatality_age": {"type": ["integer", "null"]}}})
LEVELS = Contract({"type": "object", "required": ["id", "level"], "properties": {"id": {"type": "string"}, "level": {"type": "string"}, "state": {"type": ["string", "null"]}}})


def land(root, day, run, name, data, committed=True, **manifest):
    folder = root / f"__interval_start_datetime=202608{day:02}T000000Z" / f"__interval_end_datetime=202608{day + 1:02}T000000Z" / f"__extract_run_datetime={run}"
    (folder / "data").mkdir(parents=True)
    (folder / "meta").mkdir()
    (folder / "data" / name).write_bytes(data)
    body = raw.manifest_row(source="s", extract_run_datetime=None, artifacts=[{"path": f"data/{name}", "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "format": "x"}], **manifest)
    (folder / "meta" / ("manifest.json" if committed else "manifest.json.tmp")).write_text(json.dumps(body))
    return folder


CSV = b'FATALITY_ID,EVENT_ID,FATALITY_TYPE,"FATALITY_AGE"\n1,10,"D, in\na car",51.00\nFATALITY_ID,EVENT_ID,FATALITY_TYPE,FATALITY_AGE\n2,11,,\n'


def test_committed_runs(spark, tmp_path):
    land(tmp_path, 1, "20260805T100000Z", "a.csv", CSV)
    land(tmp_path, 1, "20260805T110000Z", "b.csv", CSV, committed=False)
    (land(tmp_path, 2, "20260805T120000Z", "c.csv", CSV) / "meta" / "manifest.json").write_text("[]")
    land(tmp_path, 3, "20260805T130000Z", "d.csv", CSV, **{"wire_version": 2})
    got = raw.committed_runs(spark, str(tmp_path)).orderBy(KEYS[0]).collect()
    assert [(r[KEYS[0]].day, r[KEYS[2]].hour, r["wire_version"]) for r in got] == [(1, 10, 1), (3, 13, 2)]
    assert raw.committed_runs(spark, str(tmp_path), "2026-08-02", "2026-08-04").count() == 1
    assert raw.of_version(raw.committed_runs(spark, str(tmp_path)), 2).count() == 1
    committed = raw.committed_runs(spark, str(tmp_path))
    checked = raw.integrity(spark, raw.artifacts(committed), str(tmp_path))
    assert [r["ok"] for r in checked.collect()] == [True, True]
    assert {r["bytes"] for r in raw.artifact_bytes(committed).collect()} == {len(CSV)}


def test_csv_headers_of_different_order(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(CSV)
    with gzip.open(tmp_path / "b.csv.gz", "wb") as f:
        f.write(b"EVENT_ID,FATALITY_ID\n12,3\n")
    got = raw.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")]).orderBy("FATALITY_ID").collect()
    assert [(r["FATALITY_ID"], r["EVENT_ID"], r["FATALITY_TYPE"], r["__filename"]) for r in got] == [("1", "10", "D, in\na car", "a.csv"), ("2", "11", None, "a.csv"), ("3", "12", None, "b.csv.gz")]


def test_pages(spark, tmp_path):
    df = spark.createDataFrame([("p1", '{"data": {"events": [{"id": 1}, 5, {"id": 2}]}, "key": "/k"}'), ("p2", '[{"id": 3}]')], "page string, value string")
    assert sorted(r["record"] for r in raw.page_records(df, "data.events").collect()) == ['{"id":1}', '{"id":2}', '{"id":3}']
    with pytest.raises(Exception, match="no array"):
        raw.page_records(spark.createDataFrame([('{"data": {"events": 7}}',)], "value string"), "data.events").collect()
    keyed = raw.with_page_key(df.where("page = 'p1'"), "data.events", "key", "fallback")
    assert {r["subject_key"] for r in keyed.collect()} == {"/k"}
    back = raw.nested_pages(spark.createDataFrame([("p", '{"id":1}'), ("p", '{"id":2}')], "page string, record string"), "data.events").first()["value"]
    assert json.loads(back) == {"data": {"events": [{"id": 1}, {"id": 2}]}}


def test_yearly_files(spark):
    names = ["details_d2023_c1.csv.gz", "details_d2023_c2.csv.gz", "details_d2024_c1.csv.gz", "locations_d2023_c9.csv.gz", "details_d2022_c1.csv.gz", "details_d2023_c3.csv"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = raw.yearly_files(df, "details", "2023-05-01", "2024-01-01").collect()
    assert [(r["year"], r["name"]) for r in got] == [(2023, "details_d2023_c2.csv.gz")]


def test_load_is_idempotent_and_keeps_other_runs(spark, tmp_path):
    root, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    land(root, 1, "20260805T100000Z", "a.csv", CSV)
    stamp = load.load_run(spark, str(root), bronze, FATAL, load.Source("csv"), "2026-08-09 00:00:00")
    assert stamp["row_count"] == 2 and stamp["wire_version"] == 1
    land(root, 1, "20260805T110000Z", "b.csv", CSV)
    for _ in range(2):
        load.load_run(spark, str(root), bronze, FATAL, load.Source("csv"), "2026-08-09 00:00:00")
    got = tables.read_bronze(spark, bronze, FATAL)
    assert got.count() == 4 and got.where("fatality_age = 51").count() == 2
    assert got.select("__row_hash").distinct().count() == 2
    want = hashlib.sha256(json.dumps({"event_id": 11, "fatality_age": None, "fatality_id": 2, "fatality_type": None}, sort_keys=True).encode()).hexdigest()
    assert got.where("fatality_id = 2").first()["__row_hash"] == want
    assert [r[KEYS[2]].hour for r in tables.list_runs(spark, bronze).collect()] == [10, 11]
    assert tables.sample(got, 1)[1] is True
    load.prune(spark, bronze, 1)
    assert tables.list_runs(spark, bronze).count() == 2
    load.prune(spark, bronze, 1, dry_run=False)
    assert [r[KEYS[2]].hour for r in tables.list_runs(spark, bronze).collect()] == [11]


def test_a_bad_row_stops_the_load(spark, tmp_path):
    root, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    land(root, 1, "20260805T100000Z", "a.csv", CSV.replace(b"2,11", b"x,11"))
    with pytest.raises(Exception, match="cannot coerce x"):
        load.load_run(spark, str(root), bronze, FATAL, load.Source("csv"), "2026-08-09 00:00:00")
    assert not paths.exists(spark, bronze + "/_SUCCESS")
    plan = load.plan_runs(spark, str(root), FATAL, load.Source("csv"), "2026-08-09 00:00:00").first()
    assert (plan["rows"], plan["bad_rows"], plan["ok"]) == (2, 1, False) and "cannot coerce x" in plan["errors"][0]
    with pytest.raises(ValueError, match="no committed run"):
        load.load_run(spark, str(root), bronze, FATAL, load.Source("csv"), "2026-08-09 00:00:00", start="2026-08-20")


def test_migrate_with_a_mapper(spark, tmp_path):
    root, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    page = {"data": {"events": [{"id": "e1", "severity": "low", "state": " "}]}}
    land(root, 1, "20260805T100000Z", "a.json", json.dumps(page).encode())
    page["data"]["events"][0]["id"] = "e2"
    land(root, 2, "20260805T110000Z", "b.json", json.dumps(page).encode())

    def severity_to_level(df):
        has = F.get_json_object("record", "$.level").isNull()
        moved = F.regexp_replace("record", '"severity":', '"level":')
        return df.withColumn("record", F.when(has, moved).otherwise(F.col("record")))

    source = load.Source("json", "data.events", mapper=severity_to_level)
    for _ in range(2):
        assert load.migrate(spark, str(root), bronze, LEVELS, source, "2026-08-09 00:00:00", recreate=True, all_raw=True) == 2
    got = tables.read_bronze(spark, bronze, LEVELS).orderBy("id").collect()
    assert [(r["id"], r["level"], r["state"], r[KEYS[2]].hour) for r in got] == [("e1", "low", None, 10), ("e2", "low", None, 11)]
    with pytest.raises(ValueError, match="recreate"):
        load.migrate(spark, str(root), bronze, LEVELS, source, "2026-08-09 00:00:00", all_raw=True)
    assert load.migrate(spark, str(root), bronze, LEVELS, source, "2026-08-09 00:00:00", wire_version=3) == 0
    assert rename_if_present(spark.sql("select 1 as severity"), "severity", "level").columns == ["level"]


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_runs_that_share_a_file_name(spark, tmp_path, kind):
    root, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    for day, stamp, key in ((1, "20260805T100000Z", "e1"), (2, "20260805T110000Z", "e2")):
        page = json.dumps({"data": {"events": [{"id": key, "level": "low", "state": "x"}]}}).encode()
        land(root, day, stamp, "0001.json" if kind == "json" else "2026.csv", page if kind == "json" else f"id,level,state\n{key},low,x\n".encode())
    source = load.Source(kind, "data.events")
    plan = load.plan_runs(spark, str(root), LEVELS, source, "2026-08-09 00:00:00").collect()
    assert [(r["rows"], r["bad_rows"]) for r in plan] == [(1, 0), (1, 0)]
    assert load.migrate(spark, str(root), bronze, LEVELS, source, "2026-08-09 00:00:00", recreate=True, all_raw=True) == 2
    got = tables.read_bronze(spark, bronze, LEVELS).orderBy("id").collect()
    name = "0001.json" if kind == "json" else "2026.csv"
    assert [(r["id"], r[KEYS[2]].hour, r["__filename"]) for r in got] == [("e1", 10, name), ("e2", 11, name)]


def run_rows(spark, *stamps):
    df = spark.createDataFrame([("2026-08-01", "2026-08-02", s, i, None) for i, s in enumerate(stamps)], ", ".join(f"{k} string" for k in KEYS) + ", n int, e string")
    return df.select("n", "e", *[F.col(k).cast("timestamp").alias(k) for k in KEYS])


@pytest.mark.parametrize("profile", ["extract_run", "none"])
def test_profiles_replace_by_run(spark, tmp_path, profile):
    path = str(tmp_path / "t")
    assert tables.write_runs(run_rows(spark, "2026-08-05 10:00:00").where("n > 5"), path, profile) == 0
    assert not paths.exists(spark, path)
    for s in ("10", "11", "10"):
        tables.write_runs(run_rows(spark, f"2026-08-05 {s}:00:00"), path, profile)
    assert tables.read_bronze(spark, path).count() == 2 and tables.partitioned_by(spark, path) == profile
    with pytest.raises(ValueError, match="recreate"):
        tables.write_runs(run_rows(spark, "2026-08-05 10:00:00"), path, "none" if profile == "extract_run" else "extract_run")
    with pytest.raises(ValueError, match="run keys"):
        tables.write_runs(run_rows(spark, "2026-08-05 10:00:00", "2026-08-05 11:00:00"), path, profile)
    tables.delete_runs(spark, path, run_rows(spark, "2026-08-05 10:00:00"))
    assert [r[KEYS[2]].hour for r in tables.list_runs(spark, path).collect()] == [11]
    paths.purge(spark, path)
    assert not paths.exists(spark, path)


def test_deletes_stay_inside(spark, tmp_path):
    for bad in (str(tmp_path / "other"), str(tmp_path / "t" / ".." / "x"), str(tmp_path / "t")):
        with pytest.raises(ValueError, match="not inside"):
            paths.delete(spark, bad, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="root"):
        paths.purge(spark, "/tmp")


def test_json_runs_keep_nulls(spark, tmp_path):
    path = str(tmp_path / "j")
    tables.write_json_runs(run_rows(spark, "2026-08-05 10:00:00"), path)
    text = spark.read.option("recursiveFileLookup", "true").text(path).first()["value"]
    assert json.loads(text)["e"] is None and json.loads(text)["n"] == 0
    keys = dict(zip(tables.PARTITIONS, ("20260801T000000Z", "20260802T000000Z", "20260805T100000Z"), strict=True))
    tables.write_json_runs(run_rows(spark, "2026-08-05 10:00:00").where("false"), path, keys)
    assert not list((tmp_path / "j").rglob("part-*.txt"))


def receipt(tmp_path, day, name, body):
    folder = tmp_path / "runs" / f"dt={day}" / "p"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def test_receipts_replace_days(spark, tmp_path):
    base = {"pipeline": "p", "command": "load", "status": "ok", "duration_ms": 5}
    receipt(tmp_path, "2026-08-01", "a", base | {"attempt_id": "a", "started_at": "2026-08-01T01:00:00Z"})
    receipt(tmp_path, "2026-08-02", "b", base | {"attempt_id": "b", "started_at": "2026-08-02T01:00:00Z", "command": "extract"})
    receipt(tmp_path, "2026-08-02", "c", "{broken")
    receipt(tmp_path, "2026-08-02", "d", base | {"attempt_id": " ", "started_at": "2026-08-02T01:00:00Z"})
    target = str(tmp_path / "ops")
    assert ops.materialise(spark, str(tmp_path), target, "2026-08-01", "2026-08-03") == {"days": 2, "rows": 2, "skipped": 1}
    assert spark.read.parquet(target).count() == 2
    (tmp_path / "runs" / "dt=2026-08-01" / "p" / "a.json").unlink()
    assert ops.materialise(spark, str(tmp_path), target, "2026-08-01", "2026-08-03")["rows"] == 1
    assert [r["attempt_id"] for r in spark.read.parquet(target).collect()] == ["b"]
    found = raw.read_receipts(spark, str(tmp_path), "2026-08-01", "2026-08-03", command="extract")
    assert runs.normalise(found).count() == 1
    with pytest.raises(ValueError, match="status"):
        raw.read_receipts(spark, str(tmp_path), status="x")


def test_streamed_silver_is_the_batch_result(spark, tmp_path):
    bronze, target, check = (str(tmp_path / n) for n in ("bronze", "silver", "check"))
    order = [F.desc("run"), F.asc("v")]
    first = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, run int, v string")
    second = spark.createDataFrame([(1, 1, "late"), (2, 3, "d"), (3, 1, "e")], "k int, run int, v string")
    for part in (first, second):
        part.write.mode("append").parquet(bronze)
        stream_silver(spark, bronze, first.schema, target, check, ["k"], order).awaitTermination()
    got = sorted(map(tuple, read_silver(spark, target).collect()))
    assert got == [(1, 2, "b"), (2, 3, "d"), (3, 1, "e")]
    stream_silver(spark, bronze, first.schema, target, check, ["k"], order).awaitTermination()
    assert sorted(map(tuple, read_silver(spark, target).collect())) == got


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    target = str(tmp_path / "silver")
    order = [F.desc("run")]
    frame = lambda *rows: spark.createDataFrame(rows, "k int, run int, v string")
    upsert(frame(*[(k, 1, "a") for k in range(200)], (None, 1, "n")), target, ["k"], order, buckets=8)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "silver").rglob("*.parquet")}
    upsert(frame((5, 2, "b"), (None, 2, "m")), target, ["k"], order, buckets=4)  # the table keeps its eight
    left = {p for p in files if p.exists()}
    assert len({p.parent for p in files}) == 8 and len({p.parent for p in left}) in (6, 7)
    got = {r["k"]: (r["run"], r["v"]) for r in read_silver(spark, target).collect()}
    assert len(got) == 201 and got[5] == (2, "b") and got[None] == (2, "m") and got[6] == (1, "a")
    upsert(frame((5, 3, "c")).where("false"), target, ["k"], order)
    assert read_silver(spark, target).count() == 201


def test_gap_days(spark):
    landed = coverage.run_keys(run_rows(spark, "2026-08-05 10:00:00"))
    assert [str(r["day"]) for r in coverage.missing_days(landed, "2026-07-31", "2026-08-03").orderBy("day").collect()] == ["2026-07-31", "2026-08-02"]


def test_quoted_headers(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes(b'"a,b","say ""x""",c\n1,2,3\n')
    r = raw.read_csv(spark, [str(tmp_path / "q.csv")]).first()
    assert (r["a,b"], r['say "x"'], r["c"]) == ("1", "2", "3")


def test_a_swap_that_is_cut_short_is_mended(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for s in ("10", "11"):
        tables.write_runs(run_rows(spark, f"2026-08-05 {s}:00:00"), path, "none")
    # Ended after the old table was put aside.
    (tmp_path / "t").rename(tmp_path / "t__old_1")
    assert not paths.exists(spark, path)
    tables.write_runs(run_rows(spark, "2026-08-05 12:00:00"), path, "none")
    assert sorted(r[KEYS[2]].hour for r in tables.list_runs(spark, path).collect()) == [10, 11, 12]
    # Ended before what was put aside was deleted.
    (tmp_path / "t__old_2").mkdir()
    paths.recover(spark, path)
    assert not (tmp_path / "t__old_2").exists() and tables.list_runs(spark, path).count() == 3
    # The staged folder can't be renamed: the old table is put back.
    with pytest.raises(OSError, match="could not be renamed"):
        paths.swap(spark, str(tmp_path / "nothing"), path)
    assert tables.list_runs(spark, path).count() == 3


@pytest.mark.parametrize("profile", ["extract_run", "none"])
def test_a_batch_is_computed_once(spark, tmp_path, profile):
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    df = run_rows(spark, *["2026-08-05 10:00:00"] * 500).repartition(4)
    assert tables.write_runs(df.mapInArrow(count, df.schema), str(tmp_path / "t"), profile) == 500
    assert rows.value <= 500 + 200  # and the first row's task for its keys
    with pytest.raises(Exception, match="run keys must be present"):
        tables.write_runs(run_rows(spark, "2026-08-05 10:00:00", "2026-08-05 11:00:00"), str(tmp_path / "t"), profile)
    assert tables.read_bronze(spark, str(tmp_path / "t")).count() == 500


def test_a_bad_row_leaves_the_table_that_is_recreated(spark, tmp_path):
    root, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    source = load.Source("csv")
    land(root, 1, "20260805T100000Z", "a.csv", CSV)
    assert load.migrate(spark, str(root), bronze, FATAL, source, "2026-08-09 00:00:00", recreate=True, all_raw=True) == 2
    land(root, 2, "20260805T110000Z", "a.csv", CSV.replace(b"2,11", b"x,11"))
    with pytest.raises(Exception, match="cannot coerce x"):
        load.migrate(spark, str(root), bronze, FATAL, source, "2026-08-09 00:00:00", recreate=True, all_raw=True)
    assert tables.read_bronze(spark, bronze, FATAL).count() == 2


def test_diagnosis_puts_the_newest_raw_run_through_the_contract(spark, tmp_path):
    root, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    found = lambda: {r["code"]: (r["severity"], r["runs"]) for r in load.diagnose(spark, str(root), bronze, FATAL, load.Source("csv")).collect()}
    land(root, 1, "20260805T100000Z", "a.csv", CSV)
    assert found() == {"raw_without_bronze": ("warning", 1)}
    load.load_run(spark, str(root), bronze, FATAL, load.Source("csv"), "2026-08-09 00:00:00")
    assert found() == {"ok": ("info", 1)}
    land(root, 2, "20260805T110000Z", "a.csv", CSV.replace(b"2,11", b"x,11"))
    assert found() == {"schema_invalid": ("error", 1), "raw_without_bronze": ("warning", 1)}


def test_validation_stamps_are_a_table(spark, tmp_path):
    root, bronze, stamps = tmp_path / "raw", str(tmp_path / "bronze"), str(tmp_path / "validations")
    land(root, 1, "20260805T100000Z", "a.csv", CSV)
    for at in ("2026-08-09 00:00:00", "2026-08-10 00:00:00"):
        load.load_run(spark, str(root), bronze, FATAL, load.Source("csv"), at, validations=stamps, schema_path="s.yaml")
    land(root, 2, "20260805T110000Z", "a.csv", CSV.replace(b"2,11", b"x,11"))
    with pytest.raises(Exception, match="cannot coerce x"):
        load.load_run(spark, str(root), bronze, FATAL, load.Source("csv"), "2026-08-10 00:00:00", validations=stamps)
    (r,) = tables.read_bronze(spark, stamps).collect()
    assert (r["ok"], r["validated_at"], r["schema_path"], r["row_count"], r["wire_version"], r[KEYS[2]].hour) == (True, "2026-08-10 00:00:00", "s.yaml", 2, 1, 10) and len(r["schema_sha256"]) == 64


def test_historical_names_are_read_for_adaptations(spark, tmp_path):
    path = str(tmp_path / "t")
    old = run_rows(spark, "2026-08-05 10:00:00").select(F.lit("e0").alias("id"), F.lit("low").alias("severity"), *KEYS)
    new = run_rows(spark, "2026-08-05 11:00:00").select(F.lit("e1").alias("id"), F.lit("high").alias("level"), *KEYS)
    for df in (old, new):
        tables.write_runs(df, path)
    adapt = Adapt(coalesce={"level": ["level", "severity", "severity_level"]})
    wide = tables.read_bronze(spark, path, LEVELS, adapt)
    assert {"severity", "severity_level", "level", "state"} <= set(wide.columns) and wide.where("severity_level is not null").count() == 0
    levels = Contract({**LEVELS.schema, "properties": {**LEVELS.schema["properties"], "severity": {"type": ["string", "null"]}, "severity_level": {"type": ["string", "null"]}}})
    assert sorted((r["id"], r["level"]) for r in staging_frame(wide, levels, adapt).collect()) == [("e0", "low"), ("e1", "high")]


def test_steps_of_a_json_feed(spark):
    source = load.Source("json", "data.events")
    rows = spark.createDataFrame([('{"Id": 7, "Level": " low ", "moreData": 1}', "p.json")], "record string, __filename string").select("*", *[F.lit("2026-08-01").cast("timestamp").alias(k) for k in KEYS])
    step = lambda s: load.bronze_frame(rows, LEVELS, source, "2026-08-09 00:00:00", strict=False, stop_at=s).first()
    assert step("rows")["record"] == rows.first()["record"]
    assert json.loads(step("named")["record"]) == {"id": 7, "level": " low ", "more_data": 1}
    assert json.loads(step("coerced")["__canonical"]) == {"id": "7", "level": " low ", "more_data": 1}
