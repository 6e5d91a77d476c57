"""Silver tables by commits: crashes at every step, replays, readers during a change, increments that write."""

import json

import pytest
from pyspark.sql import functions as F

from lakejobs.jobs import silver as jobs
from lakejobs.operators import silver
from lakejobs.sources import commits, paths
from lakejobs.streaming.silver import read_silver, stream_silver, upsert

def order():
    return [F.desc("run")]


def frame(spark, *rows):
    return spark.createDataFrame(rows, "k int, run int, v string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(folder):
    return {str(p) for p in folder.rglob("*.parquet")}


@pytest.mark.parametrize("step", ["stage", "staged", "publish", "rename", "clean"])
def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    target = str(tmp_path / "silver")
    upsert(frame(spark, *[(k, 1, "a") for k in range(100)]), target, ["k"], order(), buckets=4, stream="s", batch_id=0)
    batch = frame(spark, *[(k, 2, "b") for k in range(0, 120, 7)])
    old, new = rows_of(read_silver(spark, target)), {k: (1, "a") for k in range(100)} | {k: (2, "b") for k in range(0, 120, 7)}

    class Crash(Exception):
        pass

    def crash(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        if step == "staged":
            real = commits.stage
            m.setattr(commits, "stage", lambda *a: (real(*a), crash())[0])
        elif step == "rename":
            m.setattr(paths, "rename_new", crash)
        else:
            m.setattr(commits, step, crash)
        with pytest.raises(Crash):
            upsert(batch, target, ["k"], order(), stream="s", batch_id=1)
    after = {k: (r, v) for k, r, v in rows_of(read_silver(spark, target))}
    assert after == new if step == "clean" else rows_of(read_silver(spark, target)) == old
    done = upsert(batch, target, ["k"], order(), stream="s", batch_id=1)  # the batch again
    assert done is (step != "clean")
    assert {k: (r, v) for k, r, v in rows_of(read_silver(spark, target))} == new
    upsert(frame(spark, (0, 3, "c")), target, ["k"], order(), stream="s", batch_id=2)
    live = {f"{target}/{f}" for f in commits.latest(spark, target).folders()}
    assert {f.rsplit("/", 1)[0] for f in files(tmp_path / "silver")} == live  # nothing that a crash left behind
    assert len(commits.versions(spark, target)) == 1


def test_a_reader_sees_one_whole_version(spark, tmp_path):
    target = str(tmp_path / "silver")
    upsert(frame(spark, *[(k, 1, "a") for k in range(50)]), target, ["k"], order(), buckets=4)
    before = read_silver(spark, target)
    upsert(frame(spark, *[(k, 2, "b") for k in range(50)]), target, ["k"], order(), keep=1)
    assert {r[2] for r in rows_of(before)} == {"a"} and {r[2] for r in rows_of(read_silver(spark, target))} == {"b"}
    upsert(frame(spark, (1, 3, "c")), target, ["k"], order(), keep=1)
    assert commits.versions(spark, target) == [2, 3]


def test_two_writers_of_one_version(spark, tmp_path):
    target = str(tmp_path / "silver")
    upsert(frame(spark, (1, 1, "a")), target, ["k"], order())
    live = commits.latest(spark, target)
    assert upsert(frame(spark, (1, 2, "b")), target, ["k"], order(), keep=1)
    with pytest.raises(commits.Conflict, match="another writer"):
        jobs.write(frame(spark, (1, 3, "c")), target, ["k"], "latest", order(), live)
    assert rows_of(read_silver(spark, target)) == [(1, 2, "b")]
    assert not [p for p in (tmp_path / "silver" / "_commits").iterdir() if p.name.startswith("_")]


def test_a_stream_skips_batches_that_are_there(spark, tmp_path):
    bronze, target, check = (str(tmp_path / n) for n in ("bronze", "silver", "check"))
    for i in range(2):
        frame(spark, (i, i, f"v{i}"), (9, i, f"w{i}")).write.mode("append").parquet(bronze)
        stream_silver(spark, bronze, frame(spark, (1, 1, "")).schema, target, check, ["k"], order()).awaitTermination()
    assert rows_of(read_silver(spark, target)) == [(0, 0, "v0"), (1, 1, "v1"), (9, 1, "w1")]
    assert commits.latest(spark, target).batches == {check: 1}
    assert not upsert(frame(spark, (5, 5, "x")), target, ["k"], order(), stream=check, batch_id=1)
    (tmp_path / "check" / "commits" / ".1.crc").unlink()
    (tmp_path / "check" / "commits" / "1").unlink()  # Spark doesn't know that the batch ended, and runs it again
    stream_silver(spark, bronze, frame(spark, (1, 1, "")).schema, target, check, ["k"], order()).awaitTermination()
    assert commits.latest(spark, target).version == 2


@pytest.mark.parametrize("strategy", jobs.STRATEGIES)
@pytest.mark.parametrize("lookback", [None, "2 DAYS"])
def test_increments_are_those_of_the_frames(spark, tmp_path, strategy, lookback):
    target = str(tmp_path / "silver")
    staged = lambda *rows: spark.createDataFrame(rows, "k string, at string, v int").withColumn("at", F.col("at").cast("timestamp"))
    slices = [
        staged(("a", "2026-01-01", 1), ("b", "2026-01-02", 2), ("b", "2026-01-01", 0), (None, "2026-01-02", 3)),
        staged(("a", "2026-01-03", 4), ("c", "2026-01-01", 5), (None, "2026-01-04", 6), ("d", "2026-01-04", 7)),
        staged(("e", "2025-01-01", 8)), staged(("a", "2026-01-09", 9)).where("false"), staged(("d", "2026-01-05", 10), ("d", "2026-01-06", 11)),
    ]
    want = slices[0].where("false")
    for n, rows in enumerate(slices):
        want = silver.incremental(want, rows, ["k"], "at", lookback, strategy=strategy)
        built = jobs.build(rows, target, ["k"], strategy, "at", lookback, buckets=4)
        got = read_silver(spark, target)
        assert rows_of(got.select("k", "at", "v")) == rows_of(want)
        assert (built is None) == (n in ((3,) if lookback and n != 2 else (2, 3))) or built.rows > 0
        want = spark.createDataFrame(want.collect(), want.schema)
    assert got.columns[-2:] == ["__silver_processed_at", "__silver_updated_at"]
    again = jobs.build(slices[0], target, ["k"], strategy, "at", full_refresh=True)
    assert again.rows == 3 and read_silver(spark, target).count() == 3


def test_an_increment_reads_and_writes_its_buckets_only(spark, tmp_path):
    target = str(tmp_path / "silver")
    staged = lambda n, day: spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit(day).cast("timestamp").alias("at"))
    jobs.build(staged(400, "2026-01-01"), target, ["k"], watermark="at", buckets=16)
    before = set(commits.latest(spark, target).folders())
    built = jobs.build(staged(2, "2026-01-02"), target, ["k"], watermark="at")
    after = commits.latest(spark, target)
    assert 1 <= built.buckets <= 2 and len(before & set(after.folders())) == 16 - built.buckets and read_silver(spark, target).count() == 400
    touched = {b for b, own in after.live.items() if not set(own) & before}
    plan = commits.read(spark, target, after, sorted(touched))._jdf.queryExecution().toString()
    assert plan.count("InMemoryFileIndex") == 1 and f"{len(touched)} paths" in plan
    # Appends read nothing, and bring folders together when a bucket has many.
    for i in range(jobs.COMPACT + 1):
        jobs.build(staged(1, f"2026-02-{i + 1:02d}"), target, ["k"], "append", "at")
    assert max(len(own) for own in commits.latest(spark, target).live.values()) <= jobs.COMPACT and read_silver(spark, target).count() == 400 + jobs.COMPACT + 1


def test_an_empty_table_and_odd_columns(spark, tmp_path):
    target = str(tmp_path / "silver")
    assert not upsert(frame(spark, (1, 1, "a")).where("false"), target, ["k"], order())
    with pytest.raises(FileNotFoundError):
        read_silver(spark, target)
    upsert(frame(spark, (1, 1, "a")), target, ["k"], order())
    upsert(frame(spark, (2, 1, "b")).withColumn("more", F.lit(5)), target, ["k"], order())
    assert {(r["k"], r["more"]) for r in read_silver(spark, target).collect()} == {(1, None), (2, 5)}
    text = json.loads((tmp_path / "silver" / "_commits" / f"{2:020d}.json").read_text())
    assert text["version"] == 2 and text["watermark"] is None


def test_all_checks_are_one_pass(spark):
    df = spark.createDataFrame([(i % 50 or None, i, "x" if i % 3 else "y", -0.0 if i % 2 else 0.0, [i % 7], "h") for i in range(400)], "a int, b int, c string, d double, e array<int>, hot string")
    plan = silver.Checks(["a", "b"], ["a", "b", "d", "e", "hot"], {"c": ["x"], "hot": ["h"]})
    out = silver.run_checks(df, plan)
    assert {(r["check"], r["column"]): r["failures"] for r in out.collect()} == {
        ("not_null", "a"): 8, ("not_null", "b"): 0, ("unique", "a"): 49, ("unique", "b"): 0, ("unique", "d"): 1, ("unique", "e"): 7, ("unique", "hot"): 1, ("accepted_values", "c"): 1, ("accepted_values", "hot"): 0,
    }
    assert {r["failures"] for r in silver.run_checks(df.where("false"), plan).collect()} == {0} and silver.run_checks(df, silver.Checks()).count() == 0
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.split("== Initial Plan ==")[0].count("Scan ExistingRDD[a#") == 1
