"""JSON and CSV records against contracts: every keyword at every depth, numbers as they were landed, jobs that stop."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from lakejobs.functions import jsontext
from lakejobs.operators import contract as contracts
from lakejobs.operators import rows
from lakejobs.operators.contract import Contract

DEEP = Contract(
    {
        "type": "object", "required": ["id"], "additionalProperties": False,
        "properties": {
            "id": {"type": "integer", "minimum": 1}, "kind": {"type": ["string", "null"], "enum": ["a", "b"]},
            "ship": {"type": "object", "required": ["city"], "additionalProperties": False, "properties": {"city": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"}, "geo": {"type": "object", "properties": {"lat": {"type": "number", "exclusiveMinimum": -90, "exclusiveMaximum": 90}}}}},
            "lines": {"type": "array", "items": {"type": "object", "properties": {"qty": {"type": "integer", "maximum": 5}, "tag": {"const": "x"}, "one": {"enum": [1, None, {"p": [True]}]}}}},
        },
    }
)


def errors_of(spark, contract, *records):
    df = spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "record string")
    return [r["__errors"] for r in rows.coerce_json(df, contract).collect()]


def test_every_keyword_at_every_depth(spark):
    got = errors_of(
        spark, DEEP,
        {"id": 1, "kind": "a", "ship": {"city": "oslo", "geo": {"lat": "59.9"}}, "lines": [{"qty": "5", "tag": "x", "one": {"p": [True]}}, {"one": 1.0}, {"one": None}]},
        {"id": 0, "kind": "c"}, {"id": 3_000_000_000}, {"id": 1, "kind": None}, {"id": 1, "ship": {"city": "o"}}, {"id": 1, "ship": {"city": "Oslonian"}}, {"id": 1, "ship": {"geo": {"lat": 90}, "more": 1}},
        {"id": 1, "lines": [{"qty": 6}, {"tag": "y"}, {"one": True}, {"one": {"p": [1]}}, 7]}, {"id": True}, {"id": 1, "ship": [1]}, {"Id": 1, "lines": [{"Qty": 1, "qTY": 2, "q_ty": 3}]}, "[1]", "{", "[" * 5000,
    )
    assert got == [
        [], ["id: against minimum 1", "kind: not one of ['a', 'b']"], ["id: beyond 32 bits"], ["kind: not one of ['a', 'b']"], ["ship.city: shorter than 2"], ["ship.city: longer than 4", "ship.city: doesn't match ^[a-z]+$"],
        ["ship.city: required", "ship.more: unknown field", "ship.geo.lat: against exclusiveMaximum 90"], ["lines[0].qty: against maximum 5", "lines[1].tag: not 'x'", "lines[2].one: not one of [1, None, {'p': [True]}]", "lines[3].one: not one of [1, None, {'p': [True]}]", "lines[4]: not of type ['object']"],
        ["id: a boolean is no integer"], ["ship: not of type ['object']"], ["lines[0]: several keys become 'q_ty'"], ["<root>: not of type ['object']"], ["<root>: not JSON"], got[-1],
    ]
    assert len(got[-1]) == 1 and got[-1][0].startswith("<root>: not")


def test_undeclared_parts_are_kept_and_not_judged(spark):
    df = spark.createDataFrame([('{"Free":{"aB":["", {"cD": 1.50}], "x": null}, "o": {"L": [" ", {"zZ": ""}]}}',)], "record string")
    got = rows.coerce_json(df, Contract({"properties": {"o": {"type": "object"}}})).first()
    assert got["__canonical"] == '{"free": {"a_b": ["", {"c_d": 1.5}], "x": null}, "o": {"l": [" ", {"z_z": ""}]}}' and got["__errors"] == []


def test_csv_and_json_judge_alike(spark):
    contract = Contract({"type": "object", "properties": {"n": {"type": ["number", "null"], "minimum": 2}, "k": {"type": ["string", "null"], "enum": ["x"]}, "c": {"type": ["integer", "null"], "const": 3}, "p": {"type": "string", "pattern": "^z"}}})
    cases = [("2", "x", "3", "z"), ("1.5", "y", "4", "q"), ("", "", "", "z"), ("x", "x", "x", "z")]
    csv = contracts.with_errors(spark.createDataFrame(cases, "n string, k string, c string, p string"), contract)
    want = [r["__errors"] for r in csv.collect()]
    got = errors_of(spark, contract, *[dict(zip("nkcp", c, strict=True)) for c in cases])
    plain = lambda e: sorted(x.replace("'", "") for x in e)
    assert [plain(e) for e in got] == [plain(e) for e in want] and len(want[1]) == 4 and len(want[2]) == 2 and len(want[3]) == 2


def test_nested_fields_of_csv_are_read(spark):
    texts = ['{"city":"oslo"}', '{"city":"o"}', "[1]", "nope", None, " ", '{"city":"oslo","more":1}']
    df = spark.createDataFrame([("1", t) for t in texts], "id string, ship string")
    got = [r["__errors"] for r in contracts.with_errors(df, Contract({"properties": {"id": DEEP.schema["properties"]["id"], "ship": DEEP.schema["properties"]["ship"] | {"type": ["object", "null"]}}})).collect()]
    assert got == [[], ["ship.city: shorter than 2"], ["ship: not of type ['object', 'null']"], ["ship: not JSON"], [], [], ["ship.more: unknown field"]]


def test_rules_for_additional_properties_are_refused():
    with pytest.raises(ValueError, match="additionalProperties"):
        Contract({"properties": {"a": {"type": "object", "additionalProperties": {"type": "string"}}}})


def test_numbers_are_written_as_json_does(spark):
    r = random.Random(1)
    xs = [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(50_000)]
    xs += [r.random() * 10 ** r.randrange(-8, 20) for _ in range(30_000)] + [round(r.random() * 1000, r.randrange(5)) for _ in range(15_000)] + [float(r.randrange(10 ** r.randrange(1, 20))) for _ in range(5_000)]
    xs += [2.0**k for k in range(-1074, 1024)] + [5e-324, 0.0, -0.0, 1e16, 1e15, 1e22, 1e23, float("nan"), float("inf"), -float("inf"), 2.2250738585072014e-308, 9007199254740993.0, 1e-4, 1e-5, -1.5e-7]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", jsontext.number_text(F.col("x")).alias("t"))
    assert [(r["i"], r["t"]) for r in df.collect() if r["t"] != json.dumps(xs[r["i"]])] == []
    assert "MapInArrow" not in rows.with_row_hash(spark.createDataFrame([(1.5, "a")], "x double, t string"))._jdf.queryExecution().toString()


def test_numbers_of_csv_and_json_hash_alike(spark):
    contract = Contract({"type": "object", "properties": {"n": {"type": ["number", "null"]}, "i": {"type": ["integer", "null"]}}})
    texts = ["51", "51.0", "051", "-0", "-7", "+5", "1e3", "1e-7", "0.1", " 12 ", "123456789012345678901", "", "1_000"]
    csv = contracts.with_errors(spark.createDataFrame([(t, None) for t in texts], "n string, i string"), contract, landed=True)
    landed = {"n": F.col("__landed_n")}
    got = [r["__row_hash"] for r in rows.with_row_hash(csv, landed=landed).collect()]
    told = rows.coerce_json(spark.createDataFrame([(json.dumps({"n": t, "i": None}),) for t in texts], "record string"), contract).collect()
    assert got == [r["__row_hash"] for r in told]
    assert [json.loads(r["__canonical"])["n"] for r in told] == [51, 51.0, 51, 0, -7, 5.0, 1000.0, 1e-7, 0.1, 12, 123456789012345678901, None, 1000.0]
    assert got[0] == hashlib.sha256(b'{"i": null, "n": 51}').hexdigest() and got[1] == hashlib.sha256(b'{"i": null, "n": 51.0}').hexdigest()


def test_errors_are_exploded_without_the_casts_in_a_filter(spark, capsys):
    """A filter on the errors before the explode repeats the casts of all projections, each within the next."""
    rules = {"type": "object", "properties": {"a": {"type": "integer", "maximum": 9}, "b": {"type": "number"}}}
    checked = contracts.with_errors(spark.createDataFrame([("1", "x"), ("12", None), ("3", "2"), ("y: z", "x")], "a string, b string"), Contract(rules))
    report = contracts.error_report(checked)
    assert sorted(map(tuple, report.collect())) == [("a", "against maximum 9", 1), ("a", "cannot coerce y: z to integer", 1), ("b", "cannot coerce x to number", 2), ("b", "empty value is not valid", 1)]
    texts = []
    for df in (checked, report):
        capsys.readouterr()
        df.explain("extended")
        texts.append(capsys.readouterr().out.partition("== Optimized Logical Plan ==")[2].count("infinity"))
    assert 0 < texts[1] <= 2 * texts[0]
