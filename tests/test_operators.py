import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.operators import contract as contracts
from lakejobs.operators import coverage, marts, profile, rows, runs, silver, staging
from lakejobs.operators.contract import Contract
from lakejobs.operators.coverage import KEYS

STORM = Contract({"type": "object", "required": ["event_id"], "additionalProperties": False, "properties": {"event_id": {"type": "integer"}, "state": {"type": ["string", "null"]}, "length": {"type": ["number", "null"]}, "ok": {"type": "boolean"}, "tags": {"type": "array", "items": {"type": "string"}}}})


def text_frame(spark, *records):
    return spark.createDataFrame([tuple(r) for r in records], "event_id string, state string, length string, ok string, tags string")


def test_contract_columns_and_unknown_keywords():
    assert [f.name for f in STORM.struct_type()][:5] == ["event_id", "state", "length", "ok", "tags"]
    assert STORM.struct_type()["tags"].dataType == T.StringType() and len(STORM.struct_type()) == 12
    with pytest.raises(ValueError, match="unsupported"):
        Contract({"type": "object", "properties": {"a": {"oneOf": []}}})
    assert Contract.parse('{"type": "object", "properties": {"a": {"type": "string"}}}').fields[0].name == "a"


def test_coercion_of_text(spark):
    df = text_frame(spark, ("51.00", " ", "3", "yes", "[]"), ("1.5", "TX", "x", "maybe", None), ("", None, "", "0", "[]"))
    got = contracts.with_errors(df, STORM).collect()
    assert (got[0]["event_id"], got[0]["state"], got[0]["length"], got[0]["ok"], got[0]["__errors"]) == (51, None, 3.0, True, [])
    assert sorted(e.split(":")[0] for e in got[1]["__errors"]) == ["event_id", "length", "ok"]
    assert [e.split(":")[0] for e in got[2]["__errors"]] == ["event_id"]


def test_validation_stops_the_job(spark):
    bad = text_frame(spark, ("x", None, None, "1", "[]"))
    with pytest.raises(Exception, match="cannot coerce x to integer"):
        contracts.validated(bad, STORM).collect()
    extra = text_frame(spark, ("1", None, None, "1", "[]")).withColumn("more", F.lit(1))
    assert [e for r in contracts.with_errors(extra, STORM).collect() for e in r["__errors"]] == ["more: unknown field"]
    assert contracts.with_errors(text_frame(spark, ("1", None, None, "1", "[]")).drop("event_id"), STORM).first()["__errors"] == ["event_id: required"]


def test_schema_evolution(spark):
    live = T.StructType([T.StructField("a", T.LongType()), T.StructField("old", T.StringType())])
    want = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    assert [f.name for f in contracts.evolve(live, want)] == ["b"]
    with pytest.raises(ValueError, match="can't become"):
        contracts.evolve(live, T.StructType([T.StructField("a", T.StringType())]))
    assert contracts.widened(spark.createDataFrame([(1, "x")], live), want).columns == ["a", "old", "b"]


def test_row_hash_is_that_of_sorted_json(spark):
    df = spark.sql("select 'é' as b, 1 as a, 51.0D as c, cast(null as string) as d, 9 as __meta")
    want = hashlib.sha256(json.dumps({"a": 1, "b": "é", "c": 51.0, "d": None}, sort_keys=True).encode()).hexdigest()
    assert rows.with_row_hash(df).first()["__row_hash"] == want


def test_json_records_are_renamed_coerced_and_checked(spark):
    schema = Contract({"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string"}, "items": {"type": "array", "items": {"type": "object", "properties": {"qty": {"type": "integer"}, "at": {"type": ["number", "null"]}}}}}})
    texts = ['{"Id": 7, "items": [{"Qty": "51.00", "at": " "}]}', '{"id": "a", "items": [{"qty": true}]}', '{"id": "a", "iD": "b"}', '{"items": []}', "nonsense", '{"id": "a", "x": 1}']
    got = rows.coerce_json(spark.createDataFrame([(t,) for t in texts], "record string"), schema).collect()
    assert json.loads(got[0]["__canonical"]) == {"id": "7", "items": [{"qty": 51, "at": None}]} and got[0]["__errors"] == []
    assert got[0]["__row_hash"] == hashlib.sha256(got[0]["__canonical"].encode()).hexdigest()
    assert got[1]["__errors"] == ["items[0].qty: a boolean is no integer"]
    assert got[2]["__errors"] == ["i_d: unknown field"]
    assert got[3]["__errors"] == ["id: required"] and got[4]["__errors"] == ["<root>: not JSON"] and got[5]["__errors"] == ["x: unknown field"]


def test_json_number_texts_hash_apart(spark):
    schema = Contract({"type": "object", "properties": {"n": {"type": "number"}}})
    got = rows.coerce_json(spark.createDataFrame([('{"n": "51"}',), ('{"n": "51.00"}',), ('{"n": 51}',)], "record string"), schema).collect()
    assert [r["__canonical"] for r in got] == ['{"n": 51}', '{"n": 51.0}', '{"n": 51}']


ORDER = Contract(
    {"type": "object", "required": ["id"], "properties": {
        "id": {"type": "string"}, "email": {"type": ["string", "null"]}, "tags": {"type": "array", "items": {"type": "string"}},
        "ship": {"type": "object", "properties": {"city": {"type": "string"}, "geo": {"type": "object", "properties": {"lat": {"type": "number"}}}}},
        "lines": {"type": "array", "items": {"type": "object", "properties": {"sku": {"type": "string"}, "qty": {"type": "integer"}, "taxes": {"type": "array", "items": {"type": "object", "properties": {"rate": {"type": "number"}}}}}}}}}
)


def test_flatten_plan_depth_and_collisions():
    assert [x.name for x in staging.flatten_plan(ORDER)] == ["ship__city", "ship__geo__lat"]
    assert [x.name for x in staging.flatten_plan(ORDER, depth=1)] == ["ship__city"]
    assert staging.flatten_plan(ORDER, exclude=["ship"]) == []
    with pytest.raises(ValueError, match="collide"):
        staging.check_collisions(["a", "a"], [])
    with pytest.raises(ValueError, match="meta"):
        staging.Adapt(exclude=["__row_hash"])


def test_scoped_adaptations():
    a = staging.Adapt.scoped("shipping_address", rename={"city": "ship_city"}, null_sentinels={"geo.lat": ["0"]})
    assert a.rename == {"shipping_address__city": "shipping_address__ship_city"} and a.null_sentinels == {"shipping_address__geo__lat": ["0"]}
    with pytest.raises(ValueError, match="repeats"):
        staging.Adapt.scoped("shipping_address", rename={"city": "shipping_address__city"})
    root = staging.Adapt(rename={"shipping_address__city": "town"})
    assert root.over(a).rename == {"shipping_address__city": "town"}


def test_relations(spark):
    order = {"id": "o1", "lines": [{"sku": "a", "qty": 1, "taxes": [{"rate": 0.1}, {"rate": 0.2}]}, {"sku": "b", "qty": "2"}], "tags": ["x", "y"]}
    df = spark.createDataFrame([("o1", json.dumps(order["lines"]), json.dumps(order["tags"])), ("o2", None, "[]")], "id string, lines string, tags string")
    lines = staging.relation_frame(df, ORDER, "lines", "id", ["lines", "lines.taxes"])
    assert sorted(map(tuple, lines.collect())) == [("o1", 1, "a", 1), ("o1", 2, "b", 2)]
    taxes = staging.relation_frame(df, ORDER, "lines.taxes", "id")
    assert taxes.columns == ["id", "__rel_index_0", "__rel_index_1", "rate"]
    assert sorted(map(tuple, taxes.collect())) == [("o1", 1, 1, 0.1), ("o1", 1, 2, 0.2)]
    assert sorted(map(tuple, staging.relation_frame(df, ORDER, "tags", "id").collect())) == [("o1", 1, "x"), ("o1", 2, "y")]
    assert staging.parent_key(ORDER) == "id" and staging.parent_key(ORDER, ["__x", "key"]) == "key"
    with pytest.raises(ValueError, match="no array"):
        staging.relation_frame(df, ORDER, "ship", "id")


def run_frame(spark, *stamps):
    rows_ = [("2026-08-01 00:00:00", "2026-08-02 00:00:00", f"2026-08-05 {h}:00:00", i) for i, h in enumerate(stamps)]
    df = spark.createDataFrame(rows_, ", ".join(f"{k} string" for k in KEYS) + ", n int")
    return df.select(*[F.col(k).cast("timestamp").alias(k) for k in KEYS], "n")


def test_retention_and_identity(spark):
    df = run_frame(spark, "10", "11", "12")
    plan = {r[KEYS[2]].hour: r["action"] for r in coverage.retention(df, 1).collect()}
    assert plan == {10: "remove", 11: "remove", 12: "keep"}
    with pytest.raises(ValueError, match="at least one"):
        coverage.retention(df, 0)
    assert not coverage.require_identity(df).first()["ok"]
    assert coverage.require_identity(df.where("n = 0")).first()["ok"] and coverage.require_identity(df.where("n = 9")).first()["ok"]
    assert coverage.newest_run(df).first()["n"] == 2
    assert [r["n"] for r in coverage.latest_committed(df, run="2026-08-05 11:00:00").collect()] == [1]
    assert coverage.latest_committed(df, every_run=True).count() == 3


def test_coverage_and_findings(spark):
    diff = coverage.diff_runs(run_frame(spark, "10", "11"), run_frame(spark, "10", "12"))
    assert sorted((r[KEYS[2]].hour, r["side"]) for r in diff.collect()) == [(10, "both"), (11, "only_raw"), (12, "only_bronze")]
    assert {r["code"] for r in coverage.findings(diff).collect()} == {"raw_without_bronze", "bronze_without_raw"}
    assert {r["code"] for r in coverage.findings(diff, F.lit(True)).collect()} == {"raw_without_bronze", "bronze_without_raw", "schema_invalid"}
    same = run_frame(spark, "10")
    assert [r["code"] for r in coverage.findings(coverage.diff_runs(same, same)).collect()] == ["ok"]
    none = same.where("false")
    assert [r["code"] for r in coverage.findings(coverage.diff_runs(none, none)).collect()] == ["empty_lake"]


def test_versions(spark):
    got = spark.createDataFrame([(None,), ("x",), ("0",), ("2",)], "v string").select(coverage.version_or_one(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in got] == [1, 1, 1, 2]


def test_receipt_summary(spark):
    raw = [(str(i), "p", "load", "error" if i == 4 else "ok", "2026-08-01T00:00:00Z", d, 2 if i < 4 else None, "http_error" if i == 4 else None) for i, d in enumerate([10, 20, 30, 40, 100])]
    df = runs.normalise(spark.createDataFrame(raw, "attempt_id string, pipeline string, command string, status string, started_at string, duration_ms int, rows int, error_code string"))
    assert tuple(df.columns) == runs.COLUMNS and len(runs.COLUMNS) == 22
    r = runs.summary(df).first()
    assert (r["attempts"], r["ok"], r["error"], r["p50_ms"], r["p95_ms"], r["rows"], r["error_codes"]) == (5, 4, 1, 30, 100, 8, {"http_error": 1})
    assert runs.daily(df, approximate=True).first()["attempts"] == 5


def test_expectation_rows():
    assert runs.expectation_rows("p", {"cadence": "daily"}) == [("p", "extract", "daily", 26, 24, None, None), ("p", "load", "daily", 26, 24, None, None)]
    assert runs.expectation_rows("p", {"recency_hours": 5, "extract": False, "load": {"p95_ms": 9}}) == [("p", "load", None, 5, 5, None, 9)]
    assert runs.expectation_rows("p", {"cadence": "weekly", "load": {"cadence": "hourly"}})[1][2:5] == ("hourly", 2, 24)
    with pytest.raises(ValueError, match="cadence"):
        runs.expectation_rows("p", {})


def test_metric_queries_refuse_unknown_names(spark):
    mart = spark.sql("select '2024' as event_year, 'TX' as state, 5.0D as total_property_damage")
    assert marts.YEARLY_DAMAGE.query(mart, ["total_property_damage"], ["state"]).first()[:] == ("TX", 5.0)
    for bad in ({"measures": []}, {"measures": ["x"]}, {"measures": ["total_property_damage"], "dimensions": ["x"]}, {"measures": ["total_property_damage"], "filters": [{"member": "state", "operator": "like"}]}):
        with pytest.raises(ValueError, match="needs|unknown"):
            marts.YEARLY_DAMAGE.query(mart, **bad)


def test_derived_checks(spark):
    plan = silver.Checks.derived(STORM, ["event_id"], accepted={"state": ["TX"]}, parent="order_id")
    assert plan.not_null == ["event_id", "__row_hash", "order_id"] and plan.unique == ["event_id"]
    assert silver.run_checks(spark.range(3), silver.Checks()).count() == 0


def test_watermark_edges(spark):
    new = spark.createDataFrame([(1, 5), (2, 6)], "k int, w int")
    empty = new.where("false")
    assert silver.after_watermark(new, empty, "w").count() == 2
    assert [r["k"] for r in silver.after_watermark(new, new.where("w = 5"), "w").collect()] == [2]
    with pytest.raises(ValueError, match="strategy"):
        silver.incremental(new, new, ["k"], "w", strategy="x")


def test_profile_and_drift(spark):
    texts = ['{"id": 1, "name": "a", "tags": [1, "x"], "o": {"z": true}, "__m": 1}', '{"id": 1.5, "name": null}', '{"id": 2, "name": "b"}']
    found = profile.profile(spark.createDataFrame([(t,) for t in texts], "record string"))
    got = {r["path"]: (r["types"], r["present"]) for r in found.collect()}
    assert got == {"id": (["number"], 3), "name": (["null", "string"], 3), "tags": (["array"], 1), "tags[]": (["integer", "string"], 2), "o": (["object"], 1), "o.z": (["boolean"], 1)}
    assert profile.draft_contract(found, 3)["required"] == ["id", "name"]
    frame = lambda d: spark.createDataFrame(list(d.items()), "name string, type string")
    changes = lambda a, b: {(r["change"], r["old_name"], r["new_name"]) for r in profile.drift_with_renames(frame(a), frame(b)).collect()}
    assert changes({"a": "string", "userId": "integer", "gone": "string"}, {"a": "number", "user_id": "integer", "fresh": "string"}) == {("type_change", "a", "a"), ("rename", "userId", "user_id"), ("rename", "gone", "fresh")}
    assert changes({"a": "string"}, {"b": "integer"}) == {("remove", "a", None), ("add", None, "b")}


def test_hash_columns_write_what_json_does(spark):
    texts = ["plain", 'a "b" \\ /', "é \U0001f389 \ud7ff \uffff", "\t\n\r\b\f\x00\x1f\x7f", "", None]
    df = spark.createDataFrame([(t, i, i % 2 == 0) for i, t in enumerate(texts)], "`b t` string, `A` long, c boolean")
    got = {r["A"]: r["__row_hash"] for r in rows.with_row_hash(df).collect()}
    assert got == {i: hashlib.sha256(json.dumps({"b t": t, "A": i, "c": i % 2 == 0}, sort_keys=True).encode()).hexdigest() for i, t in enumerate(texts)}
    assert "MapInArrow" not in rows.with_row_hash(df)._jdf.queryExecution().toString()


def test_outcome_of_a_check(spark):
    bad = contracts.with_errors(text_frame(spark, ("x", None, "3", "yes", "[]"), ("1", None, None, "1", "[]")), STORM)
    assert tuple(contracts.outcome(bad).first()) == (2, 1, 1, 0, False)
    assert contracts.outcome(bad.where("event_id is not null")).first()["ok"] is True
    assert contracts.outcome(bad.where("false")).first()["ok"] is False


def test_renames_in_frames_and_maps_agree(spark):
    cases = [
        ({"a": "string", "userId": "integer"}, {"a": "number", "user_id": "integer"}),
        ({"a": "string", "gone": "null,string"}, {"a": "string", "here": "string"}),
        ({"gone": "string"}, {"here": "number"}), ({"x": "string", "y": "string"}, {"z": "string"}), ({}, {"n": "string"}),
    ]
    frame = lambda d: spark.createDataFrame(list(d.items()), "name string, type string")
    got = [sorted((r["change"], r["old_name"], r["new_name"]) for r in profile.drift_with_renames(frame(a), frame(b)).collect()) for a, b in cases]
    assert got == [
        [("rename", "userId", "user_id"), ("type_change", "a", "a")], [("rename", "gone", "here")], [("add", None, "here"), ("remove", "gone", None)],
        [("add", None, "z"), ("remove", "x", None), ("remove", "y", None)], [("add", None, "n")],
    ]


def test_silver_stamps(spark):
    got = silver.stamped(spark.range(2)).first()
    assert got["__silver_processed_at"] is not None and got["__silver_processed_at"] == got["__silver_updated_at"]


def test_items_that_are_not_as_declared(spark):
    contract = Contract({"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "li": {"type": "array", "items": {"type": "object", "properties": {"a": {"type": "integer"}, "s": {"type": "object", "properties": {"f": {"type": "string"}}}, "t": {"type": "array", "items": {"type": "object", "properties": {"r": {"type": "number"}}}}}}}}})
    texts = ['[{"a":1,"s":{"f":"x"},"t":[{"r":1.50},{"r":"2"}]},"x",{"a":"2","s":"bad","t":[5,{"r":3}]},null,{"a":true,"t":{"r":4}}]', "[]", None, '{"a":1}', "nope", ' [{"a":10,"s":{"f":{"z":1}},"t":[]},[1]]']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, li string")
    got = sorted(map(tuple, staging.relation_frame(df, contract, "li", "id", ["li.t"]).collect()))
    assert got == [("0", 1, 1, "x"), ("0", 2, None, None), ("0", 3, 2, None), ("0", 4, None, None), ("0", 5, None, None), ("5", 1, 10, '{"z":1}'), ("5", 2, None, None)]
    assert sorted(map(tuple, staging.relation_frame(df, contract, "li.t", "id").collect())) == [("0", 1, 1, 1.5), ("0", 1, 2, 2.0), ("0", 3, 1, None), ("0", 3, 2, 3.0)]


def test_profiles_are_kept_by_run(spark, tmp_path):
    from lakejobs.operators.coverage import KEYS
    from lakejobs.sources import tables

    days = {1: ['{"a": 1, "userId": 2}', '{"a": 1.5}'], 2: ['{"a": "x", "user_id": 2}'], 3: ['{"user_id": 2, "o": {"z": 1}}']}
    rows = [(t, f"2026-08-{d:02}") for d, own in days.items() for t in own]
    records = spark.createDataFrame(rows, "record string, day string").select("record", *[F.col("day").cast("timestamp").alias(k) for k in KEYS])
    path = str(tmp_path / "profiles")
    for _ in range(2):  # a run that is loaded again replaces its profile
        tables.write_runs(profile.run_profiles(records), path, single=False)
    kept = tables.read_bronze(spark, path)
    got = {(r["path"], r["type"]): (r["present"], r["first_run"].day, r["last_run"].day) for r in profile.merged(kept).collect()}
    assert got == {("a", "integer"): (1, 1, 1), ("a", "number"): (1, 1, 1), ("a", "string"): (1, 2, 2), ("userId", "integer"): (1, 1, 1), ("user_id", "integer"): (2, 2, 3), ("o", "object"): (1, 3, 3), ("o.z", "integer"): (1, 3, 3)}
    between = lambda a, b: {(r["change"], r["old_name"], r["new_name"]) for r in profile.drift_between(kept, f"2026-08-{a:02}", f"2026-08-{b:02}").collect()}
    assert between(1, 2) == {("type_change", "a", "a"), ("rename", "userId", "user_id")} and between(2, 2) == set()
    assert between(1, 3) == {("remove", "a", None), ("rename", "userId", "user_id"), ("add", None, "o"), ("add", None, "o.z")}
    by_run = {(r["run"].day, r["path"], r["change"]) for r in profile.drift_by_run(kept).collect()}
    assert by_run == {(2, "a", "type_change"), (2, "userId", "remove"), (2, "user_id", "add"), (3, "a", "remove"), (3, "o", "add"), (3, "o.z", "add")}


def test_percentiles_without_buffers(spark):
    import random

    from lakejobs.operators import runs

    r = random.Random(2)
    rows = [(f"d{i % 3}", f"p{i % 4}", "load", "ok" if i % 5 else "error", r.choice([None, *range(0, 4000, r.choice((1, 7, 500)))]), i % 7 or None, None) for i in range(3000)] + [("d9", "only nulls", "load", "ok", None, None, None), (None, "one", "load", "ok", 5, 1, None)]
    df = spark.createDataFrame(rows, "attempt_date string, pipeline string, command string, status string, duration_ms long, rows long, error_code string")
    keys = ["attempt_date", "pipeline", "command"]
    want = df.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"), F.percentile("duration_ms", 0.5).alias("p50_ms"), F.percentile("duration_ms", 0.95).alias("p95_ms"), F.sum("rows").alias("rows"))
    out = runs.daily(df)
    assert out.columns == want.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY duration_ms)").cast("long")
    want = df.groupBy("pipeline").agg(disc(0.5).alias("a"), disc(0.95).alias("b"))
    assert sorted(map(tuple, runs.summary(df).select("pipeline", "p50_ms", "p95_ms").collect())) == sorted(map(tuple, want.collect()))
    assert "percentile(" not in out._jdf.queryExecution().toString()
