"""Row hashes, meta columns, and the helper that renames and coerces JSON records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.functions import jsontext, timekeys
from lakejobs.operators.checks import compile_check, compile_coercion
from lakejobs.operators.contract import Contract

META_COLUMNS = ("__row_hash", "__filename", "__extract_run_datetime", "__bronze_loaded_at", "__interval_start_datetime", "__interval_end_datetime", "__data_interval_date")


def canonical_text(record: dict[str, Any]) -> str:
    """The text that is hashed: sorted keys, ASCII escapes, a space after each separator."""
    return json.dumps(record, sort_keys=True, default=str)


#: Types whose JSON text column expressions can write; dates, decimals and nested values are written by Python.
_PLAIN = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.FloatType, T.DoubleType)


def canonical_column(fields: list[T.StructField], landed: dict[str, Column] | None = None) -> Column:
    """canonical_text() of the given columns. landed: the text that a number column was read from, by name; a number that
    was landed as a whole number is written as one (51 apart from 51.0)."""

    def text(f: T.StructField) -> Column:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.StringType):
            return jsontext.string_text(c)
        if not isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return c.cast("string")
        if f.name not in (landed or {}):
            return jsontext.number_text(c)
        t = F.trim(landed[f.name])
        return F.when(t.rlike(r"^-?\d+$"), jsontext.whole_text(t)).otherwise(jsontext.number_text(c))

    return jsontext.object_text([f.name for f in fields], [text(f) for f in fields])


def with_row_hash(df: DataFrame, into: str = "__row_hash", landed: dict[str, Column] | None = None) -> DataFrame:
    """df with the SHA-256 of each row's columns that don't start with __. Nested texts are hashed as text. Rows of texts,
    numbers and booleans are hashed by column expressions, others in Arrow batches. landed: see canonical_column()."""
    names = [c for c in df.columns if not c.startswith("__")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if all(isinstance(f.dataType, _PLAIN) for f in df.schema if f.name in names):
        return df.withColumn(into, F.sha2(canonical_column([f for f in df.schema if f.name in names], landed), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(batch.schema.names.index(n)).to_pylist() for n in names]
            hashes = [hashlib.sha256(canonical_text(dict(zip(names, row, strict=True))).encode()).hexdigest() for row in zip(*at, strict=True)]
            keep = [i for i, n in enumerate(batch.schema.names) if n != into]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(hashes, pa.string())], names=[*[batch.schema.names[i] for i in keep], into])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in df.columns if c != into], f"`{into}` string"])
    return df.mapInArrow(run, schema)


def attach_meta(df: DataFrame, filename: Column, run: Column, start: Column, end: Column | None, loaded_at: Column, hashed: bool = False) -> DataFrame:
    """df with the seven meta columns; run, start, end and loaded_at are timestamps. hashed: __row_hash is there.
    Columns __landed_<name> are the texts of number columns, for the hash."""
    texts = {c.removeprefix("__landed_"): F.col(f"`{c}`") for c in df.columns if c.startswith("__landed_")}
    out = df if hashed else with_row_hash(df, landed=texts)
    bound = timekeys.checked_end(start, end if end is not None else F.lit(None).cast("timestamp"))
    return out.withColumns(
        {
            "__filename": filename, "__extract_run_datetime": run, "__bronze_loaded_at": loaded_at, "__interval_start_datetime": start,
            "__interval_end_datetime": bound, "__data_interval_date": F.to_date(start),
        }
    )


class Checker:
    """A contract's coercion and checks of JSON texts."""

    def __init__(self, contract: Contract, rename: bool = True):
        self.coerce = compile_coercion(contract.schema, rename)
        self.check = compile_check(contract.schema | {"type": "object"} if contract.schema else {})
        self.narrow = [(f.name, compile_check({}, wide=False)) for f in contract.fields if isinstance(f.spark_type, T.IntegerType)]
        self.fields = [(f.name, f.spark_type) for f in contract.fields]

    def record(self, text: str) -> tuple[str, Any, list[str]]:
        """(canonical text, record, errors) of one JSON object. What it has against the rules is told if coercion is fine."""
        errors: list[str] = []
        try:
            out = self.coerce(json.loads(text), None, errors)
        except ValueError:
            return "{}", {}, ["<root>: not JSON"]
        except RecursionError:
            return "{}", {}, ["<root>: nested too deep"]
        if not errors:
            self.check(out, None, errors)
            for n, narrow in self.narrow:
                if isinstance(out, dict) and n in out:
                    narrow(out[n], (None, n), errors)
        return canonical_text(out), out if isinstance(out, dict) else {}, errors

    def column(self, name: str, kind: T.DataType, records: list[dict[str, Any]], fine: list[bool]) -> list:
        """The values of a field; nested ones are JSON text. Of records that aren't fine, those that fit."""
        out = []
        for r, ok in zip(records, fine, strict=True):
            v = r.get(name)
            if isinstance(kind, T.StringType):
                out.append(v if v is None or isinstance(v, str) else canonical_text(v))
            elif ok or v is None:
                out.append(float(v) if v is not None and isinstance(kind, T.DoubleType) else v)
            else:
                fits = {"int": isinstance(v, int) and not isinstance(v, bool) and -(1 << 31) <= v < 1 << 31, "double": isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": isinstance(v, bool)}
                out.append((float(v) if isinstance(kind, T.DoubleType) else v) if fits.get(kind.simpleString()) else None)
        return out


def renamed_json(df: DataFrame, column: str = "record", rename: bool = True) -> DataFrame:
    """df of JSON object texts with the names in snake case, values as they are; __errors has names that meet."""
    out = coerce_json(df, Contract({}), column, rename)
    return out.withColumn(column, F.col("__canonical")).drop("__canonical", "__row_hash", "__fields")


def coerce_json(df: DataFrame, contract: Contract, column: str = "record", rename: bool = True) -> DataFrame:
    """df of JSON object texts with __canonical, __row_hash, __errors and __fields, a struct of the contract's columns; other
    columns are kept."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fields = [(f.name, f.spark_type) for f in contract.fields]
    arrow = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    struct = T.StructType([T.StructField(n, t) for n, t in fields] or [T.StructField("__none", T.BooleanType())]).simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = Checker(contract, rename)
        for batch in batches:
            out = [checker.record(t or "") for t in batch.column(batch.schema.names.index(column)).to_pylist()]
            text, records, errors = zip(*out, strict=True) if out else ((), (), ())
            fine = [not e for e in errors]
            columns = [pa.array(checker.column(n, t, records, fine), arrow[t.simpleString()]) for n, t in fields] or [pa.nulls(len(out), pa.bool_())]
            values = pa.StructArray.from_arrays(columns, names=[n for n, _ in fields] or ["__none"])
            digest = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), digest, pa.array(errors, pa.list_(pa.string())), values], names=[*batch.schema.names, "__canonical", "__row_hash", "__errors", "__fields"])

    return df.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in df.columns], f"__canonical string, __row_hash string, __errors array<string>, __fields {struct}"]))
