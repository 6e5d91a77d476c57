"""Runs without artifacts, paths with odd signs, windows that prune, headers found in tasks, hashes of large files, feeds that stop."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_lake import land

from lakejobs.jobs import load
from lakejobs.operators.contract import Contract
from lakejobs.operators.coverage import KEYS
from lakejobs.sources import paths, raw

ITEMS = Contract({"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "a": {"type": ["integer", "null"], "maximum": 5}, "k": {"type": ["string", "null"], "enum": ["x", None], "pattern": "^x"}, "n": {"type": ["integer", "null"]}}})


def page(*items):
    return json.dumps({"items": list(items)}).encode()


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_a_run_without_artifacts(spark, tmp_path, kind):
    root, bronze, stamps = tmp_path / "raw", str(tmp_path / "bronze"), str(tmp_path / "stamps")
    folder = land(root, 1, "20260805T100000Z", "a.csv", b"id\n1\n")
    manifest = folder / "meta" / "manifest.json"
    manifest.write_text(json.dumps(json.loads(manifest.read_text()) | {"artifacts": []}))
    source = load.Source(kind, "items")
    assert {r["code"]: r["severity"] for r in load.diagnose(spark, str(root), bronze, ITEMS, source).collect()} == {"raw_without_bronze": "warning"}
    stamp = load.load_run(spark, str(root), bronze, ITEMS, source, "2026-08-09 00:00:00", validations=stamps)
    assert stamp["row_count"] == 0 and not paths.exists(spark, bronze)
    assert load.plan_runs(spark, str(root), ITEMS, source, "2026-08-09 00:00:00").count() == 0
    assert load.migrate(spark, str(root), bronze, ITEMS, source, "2026-08-09 00:00:00") == 0
    assert load.run_rows(spark, raw.committed_runs(spark, str(root)), source).count() == 0


@pytest.mark.parametrize("name", ["a%41.json", "a%41 b+c.json", "ä b.json", "plain.json"])
def test_names_with_odd_signs(spark, tmp_path, name):
    root, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    land(root, 1, "20260805T100000Z", name, page({"id": 1}, {"id": 2}))
    assert load.load_run(spark, str(root), bronze, ITEMS, load.Source("json", "items"), "2026-08-09 00:00:00")["row_count"] == 2
    csv = tmp_path / "csv"
    land(csv, 1, "20260805T100000Z", name.replace("json", "csv"), b"id,a\n1,2\n")
    assert load.load_run(spark, str(csv), str(tmp_path / "b2"), ITEMS, load.Source("csv"), "2026-08-09 00:00:00")["row_count"] == 1


def test_a_file_of_no_run_is_an_error(spark, tmp_path, monkeypatch):
    root = tmp_path / "raw"
    land(root, 1, "20260805T100000Z", "a.json", page({"id": 1}))
    runs = raw.committed_runs(spark, str(root))
    real = raw.read_pages
    monkeypatch.setattr(raw, "read_pages", lambda *a, **b: real(*a, **b).withColumn("__file", F.concat("__file", F.lit("x"))))
    with pytest.raises(Exception, match="no run lists"):
        load.run_rows(spark, runs, load.Source("json", "items")).collect()


def test_json_feeds_stop_as_csv_feeds_do(spark, tmp_path):
    bad = [({"a": 9}, "against maximum 5"), ({"k": "zzz"}, "not one of"), ({"n": 3_000_000_000}, "beyond 32 bits")]
    for i, (item, message) in enumerate(bad):
        for kind, body in (("json", page({"id": "1", **item})), ("csv", ("id," + ",".join(item) + "\n1," + ",".join(map(str, item.values())) + "\n").encode())):
            root, bronze = tmp_path / f"raw{i}{kind}", str(tmp_path / f"b{i}{kind}")
            land(root, 1, "20260805T100000Z", f"a.{kind}", body)
            with pytest.raises(Exception, match=message if kind == "json" or i < 2 else "cannot coerce 3000000000 to integer"):
                load.load_run(spark, str(root), bronze, ITEMS, load.Source(kind, "items"), "2026-08-09 00:00:00")
            assert not paths.exists(spark, bronze) or not paths.children(spark, bronze)  # no run is there


def test_a_window_lists_its_intervals(spark, tmp_path, monkeypatch):
    for day in range(1, 29):
        land(tmp_path / "raw" / "feed", day, "20260805T100000Z", "a.json", page({"id": day}))
    root = str(tmp_path / "raw")
    listed = []
    real = paths.children
    monkeypatch.setattr(paths, "children", lambda spark, path: (listed.append(path), real(spark, path))[1])
    (only,) = raw.interval_folders(spark, root, "2026-08-07", "2026-08-08")
    assert "20260807T000000Z" in only and len(listed) == 2  # the root and the feed
    runs = raw.committed_runs(spark, root, "2026-08-07", "2026-08-09")
    assert sorted(r[KEYS[0]].day for r in runs.collect()) == [7, 8] and "2 paths" in runs._jdf.queryExecution().toString()
    assert raw.committed_runs(spark, root, "2027-01-01").count() == 0 and raw.committed_runs(spark, root).count() == 28
    assert raw.interval_folders(spark, str(tmp_path / "nothing"), "2026-01-01") is None


def test_headers_are_found_by_one_job(spark, tmp_path):
    files = []
    for i in range(300):
        head = ['id,"a,b"', "id,c", '"line\nend",id', "﻿id,c"][i % 4]
        (tmp_path / f"{i}.csv").write_bytes(f"{head}\r\n1,2\r\n".encode() if i % 2 else f"{head}\n1,2\n".encode())
        files.append(str(tmp_path / f"{i}.csv"))
    (tmp_path / "empty.csv").write_bytes(b"")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    found = raw.headers(spark, [*files, str(tmp_path / "empty.csv")])
    assert {h: len(f) for h, f in found.items()} == {("id", "a,b"): 75, ("id", "c"): 150, ("line\nend", "id"): 75}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(jobs) <= 3
    assert raw.read_csv(spark, files).count() == 300 and raw.read_csv(spark, []).columns == ["__filename"]
    assert raw.read_csv(spark, [str(tmp_path / "empty.csv")]).count() == 0


def test_large_files_are_hashed_as_streams(spark, tmp_path):
    folder = land(tmp_path, 1, "20260805T100000Z", "a.bin", b"small")
    big = folder / "data" / "big.bin"
    with big.open("wb") as f:
        f.truncate((3 << 30) + 5)  # over what one value can hold
    digest = hashlib.sha256()
    for _ in range(3 << 7):
        digest.update(bytes(8 << 20))
    digest.update(bytes(5))
    manifest = folder / "meta" / "manifest.json"
    body = json.loads(manifest.read_text())
    body["artifacts"].append(body["artifacts"][0] | {"path": "data/big.bin", "sha256": digest.hexdigest(), "bytes": (3 << 30) + 5})
    manifest.write_text(json.dumps(body))
    listed = raw.artifacts(raw.committed_runs(spark, str(tmp_path)))
    got = {r["file"].rsplit("/", 1)[1]: (r["ok"], r["found_bytes"]) for r in raw.integrity(spark, listed, str(tmp_path)).collect()}
    assert got == {"a.bin": (True, 5), "big.bin": (True, (3 << 30) + 5)}
