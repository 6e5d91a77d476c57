"""Contracts: JSON Schema objects as coercion and validation expressions, and schema evolution."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.functions import casts
from lakejobs.operators.checks import nested_errors

_TYPES = {"integer": T.IntegerType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
_KNOWN = {"type", "required", "additionalProperties", "properties", "items", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "description", "title", "$schema", "$id", "format", "examples", "default"}
_FAMILIES = ({"tinyint", "smallint", "int", "bigint"}, {"float", "double"}, {"string", "char", "varchar"}, {"timestamp", "timestamp_ntz"}, {"date"}, {"boolean"}, {"binary"})
META = T.StructType(
    [T.StructField("__row_hash", T.StringType()), T.StructField("__filename", T.StringType()), *[T.StructField(n, T.TimestampType()) for n in ("__extract_run_datetime", "__bronze_loaded_at", "__interval_start_datetime", "__interval_end_datetime")], T.StructField("__data_interval_date", T.DateType())]
)


@dataclass(frozen=True)
class Field:
    name: str
    types: frozenset[str]
    rules: dict[str, Any]

    @property
    def nullable(self) -> bool:
        return not self.types or "null" in self.types

    @property
    def spark_type(self) -> T.DataType:
        for t in ("integer", "number", "boolean", "string"):
            if t in self.types:
                return _TYPES[t]
        return T.StringType()  # objects and arrays are JSON text; unknown types are text

    @property
    def nested(self) -> bool:
        return bool(self.types & {"object", "array"}) or "properties" in self.rules or "items" in self.rules


@dataclass(frozen=True)
class Contract:
    schema: dict[str, Any]

    @classmethod
    def parse(cls, source: str | dict[str, Any]) -> Contract:
        if isinstance(source, dict):
            return cls(source)
        try:
            import yaml

            return cls(yaml.safe_load(source))
        except ImportError:
            return cls(json.loads(source))

    def __post_init__(self) -> None:
        _refuse_unknown(self.schema, "")

    @property
    def fields(self) -> list[Field]:
        out = []
        for name, rules in (self.schema.get("properties") or {}).items():
            kind = rules.get("type")
            out.append(Field(name, frozenset([kind] if isinstance(kind, str) else kind or ()), rules))
        return out

    @property
    def required(self) -> list[str]:
        return list(self.schema.get("required") or ())

    @property
    def closed(self) -> bool:
        return self.schema.get("additionalProperties") is False

    def struct_type(self, meta: bool = True) -> T.StructType:
        """Columns in contract order, then the meta columns."""
        own = [T.StructField(f.name, f.spark_type) for f in self.fields]
        return T.StructType([*own, *(META.fields if meta else ())])


def _refuse_unknown(schema: dict[str, Any], path: str) -> None:
    unknown = set(schema) - _KNOWN
    if unknown:
        raise ValueError(f"unsupported keywords at {path or '<root>'}: {sorted(unknown)}")
    if isinstance(schema.get("additionalProperties"), dict):
        raise ValueError(f"additionalProperties with rules at {path or '<root>'}: only true and false are supported")
    for name, rules in (schema.get("properties") or {}).items():
        _refuse_unknown(rules, f"{path}.{name}".strip("."))
    if isinstance(schema.get("items"), dict):
        _refuse_unknown(schema["items"], f"{path}[]")


def _number(value: Column, field: Field) -> Column | None:
    """The text as a double, for fields that need it."""
    return casts.double(value) if {"integer", "number"} & field.types else None


def _coerced(value: Column, number: Column | None, field: Field) -> Column:
    """The typed value of a text; null if it is blank or can't be coerced."""
    t = F.trim(value)
    if "integer" in field.types:
        whole = (number == F.floor(number)) & number.between(-2147483648.0, 2147483647.0)
        out = F.when(t.rlike(r"^[+-]?\d{1,9}$"), t.try_cast("int")).otherwise(F.when(whole, number).cast("int"))
    elif "number" in field.types:
        out = number
    elif "boolean" in field.types:
        out = F.when(F.lower(t).isin("true", "1", "yes"), F.lit(True)).when(F.lower(t).isin("false", "0", "no"), F.lit(False))
    else:
        blank_text = F.when(t == "", F.lit("")) if field.types and not field.nullable else F.lit(None).cast("string")
        out = F.when(t != "", value).otherwise(blank_text)
    return out.cast(field.spark_type)


def _coercion_error(value: Column, out: Column, field: Field) -> Column:
    """What is wrong with a text whose typed value is out; null if nothing."""
    blank = value.isNull() | (F.trim(value) == "")
    kind = next((k for k in ("integer", "number", "boolean") if k in field.types), "string")
    failed = F.when(~blank & out.isNull(), F.concat(F.lit(f"{field.name}: cannot coerce "), value, F.lit(f" to {kind}")))
    if field.types and not field.nullable:
        return F.when(blank & out.isNull(), F.lit(f"{field.name}: empty value is not valid")).otherwise(failed)
    return failed


def _violations(value: Column, raw: Column, field: Field) -> list[Column]:
    """Errors of a coerced value against the rules of its field; raw is its text. A blank that counts as null has to be
    among the values of enum and const too."""
    r, name, out = field.rules, field.name, []
    null = value.isNull() & (raw.isNull() | (F.trim(raw) == "")) & F.lit(field.nullable)

    def bad(condition: Column, message: str) -> None:
        out.append(F.when(value.isNotNull() & condition, F.lit(f"{name}: {message}")))

    if "enum" in r:
        wrong = value.isNotNull() & ~value.isin([x for x in r["enum"] if x is not None])
        out.append(F.when(wrong if None in r["enum"] else wrong | null, F.lit(f"{name}: not one of {r['enum']}")))
    if "const" in r:
        out.append(F.when(value.isNotNull() if r["const"] is None else null | (value != F.lit(r["const"])), F.lit(f"{name}: not {r['const']!r}")))
    for key, test in (("minimum", lambda v, x: v < x), ("maximum", lambda v, x: v > x), ("exclusiveMinimum", lambda v, x: v <= x), ("exclusiveMaximum", lambda v, x: v >= x)):
        if key in r:
            bad(test(value, F.lit(r[key])), f"against {key} {r[key]}")
    if "minLength" in r:
        bad(F.char_length(value) < r["minLength"], f"shorter than {r['minLength']}")
    if "maxLength" in r:
        bad(F.char_length(value) > r["maxLength"], f"longer than {r['maxLength']}")
    if "pattern" in r:
        bad(~value.rlike(r["pattern"]), f"doesn't match {r['pattern']}")
    return out


def with_errors(df: DataFrame, contract: Contract, landed: bool = False) -> DataFrame:
    """df of text columns -> contract columns (coerced), other columns as they are, and __errors: array<string>.

    Presence is that of the column: a missing required column, or an unknown one in a closed contract, is an error of
    every row. Nested fields are taken as JSON text, which is read and checked by the rules of what is in it, but stays as
    it is. landed: also the texts of number columns, as __landed_<name>.
    """
    fields = {f.name: f for f in contract.fields}
    kept = [c for c in df.columns if c.startswith("__")]
    own = [c for c in df.columns if c in fields]
    plain = [c for c in own if not fields[c].nested]
    unknown = [c for c in df.columns if c not in fields and c not in kept]
    # Three projections, as later ones use what is costly more than once: numbers, values, errors.
    numbers = {c: n for c in plain if (n := _number(F.col(f"`{c}`"), fields[c])) is not None}
    base = df.select("*", *[n.alias(f"__number_{c}") for c, n in numbers.items()])
    typed = [_coerced(F.col(f"`{c}`"), F.col(f"`__number_{c}`") if c in numbers else None, fields[c]).alias(c) if c in plain else F.col(f"`{c}`") for c in own]
    values = base.select(*typed, *[F.col(f"`{c}`") for c in [*unknown, *kept]], *[F.col(f"`{c}`").alias(f"__raw_{c}") for c in plain])
    errors = []
    for c in plain:
        error = _coercion_error(F.col(f"`__raw_{c}`"), F.col(f"`{c}`"), fields[c])
        errors.append(error)
        if {"enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern"} & set(fields[c].rules):
            errors += _violations(F.col(f"`{c}`"), F.col(f"`__raw_{c}`"), fields[c])
    deep = [c for c in own if fields[c].nested]
    values = values.withColumns({f"__deep_{c}": nested_errors(c, fields[c].rules)(F.col(f"`{c}`").cast("string")) for c in deep})
    for name in contract.required:
        if name not in df.columns:
            errors.append(F.lit(f"{name}: required"))
    if contract.closed:
        errors += [F.lit(f"{c}: unknown field") for c in unknown]
    groups = [F.array_compact(F.array(*errors[i : i + 25])) for i in range(0, len(errors), 25)] or [F.array().cast("array<string>")]
    texts = [F.col(f"`__raw_{c}`").alias(f"__landed_{c}") for c in plain if isinstance(fields[c].spark_type, T.DoubleType)] if landed else []
    every = F.concat(*groups, *[F.col(f"`__deep_{c}`") for c in deep])
    return values.select(*[F.col(f"`{c}`") for c in [*own, *unknown, *kept]], *texts, every.alias("__errors"))


def validated(df: DataFrame, contract: Contract, landed: bool = False) -> DataFrame:
    """with_errors() that fails the job on the first bad row."""
    checked = with_errors(df, contract, landed)
    first = checked.columns[0]
    stop = F.raise_error(F.concat(F.lit("contract: "), F.concat_ws("; ", F.slice("__errors", 1, 10))))
    guard = F.when(F.size("__errors") > 0, stop.cast(checked.schema[first].dataType)).otherwise(F.col(f"`{first}`"))
    return checked.withColumn(first, guard).drop("__errors")


def exploded_errors(checked: DataFrame, *kept: str) -> DataFrame:
    """The errors of a with_errors() frame, a row each as e, with the columns kept. Rows without errors are dropped after the
    explode: a filter before it is pushed below the projections of with_errors(), which are then written out in it."""
    return checked.select(*kept, F.explode_outer("__errors").alias("e")).where(F.col("e").isNotNull())


def error_report(checked: DataFrame) -> DataFrame:
    """(path, message, rows) over all rows of a with_errors() frame. Errors are counted before they are taken apart."""
    e = exploded_errors(checked).groupBy("e").agg(F.count("*").alias("n"))
    return e.select(F.regexp_extract("e", "^([^:]*):", 1).alias("path"), F.regexp_replace("e", "^[^:]*: ", "").alias("message"), "n").groupBy("path", "message").agg(F.sum("n").alias("rows"))


#: How the messages of a value that can't be coerced begin; all others are of the rules.
_COERCION = r"^[^:]*: (cannot coerce|an empty value|empty value|a boolean is no)"


def outcome(checked: DataFrame) -> DataFrame:
    """One row of a frame with __errors: rows, bad rows, errors of coercion and of the rules, and ok: rows, and no errors."""
    coercion = F.size(F.filter("__errors", lambda e: e.rlike(_COERCION)))
    every = F.coalesce(F.sum(F.size("__errors")), F.lit(0))
    out = checked.agg(F.count("*").alias("rows"), F.count_if(F.size("__errors") > 0).alias("bad_rows"), F.coalesce(F.sum(coercion), F.lit(0)).alias("coerce_errors"), every.alias("errors"))
    return out.select("rows", "bad_rows", "coerce_errors", (F.col("errors") - F.col("coerce_errors")).alias("schema_errors"), ((F.col("rows") > 0) & (F.col("errors") == 0)).alias("ok"))


def compatible(live: T.DataType, expected: T.DataType) -> bool:
    a, b = live.simpleString(), expected.simpleString()
    return a == b or any(a in f and b in f for f in _FAMILIES)


def evolve(live: T.StructType, expected: T.StructType) -> list[T.StructField]:
    """Columns to add to a live table; incompatible families are an error, extra live columns are left."""
    have = {f.name: f.dataType for f in live}
    for f in expected:
        if f.name in have and not compatible(have[f.name], f.dataType):
            raise ValueError(f"column {f.name}: {have[f.name].simpleString()} can't become {f.dataType.simpleString()}")
    return [T.StructField(f.name, f.dataType, True) for f in expected if f.name not in have]


def widened(live: DataFrame, expected: T.StructType) -> DataFrame:
    return reduce(lambda d, f: d.withColumn(f.name, F.lit(None).cast(f.dataType)), evolve(live.schema, expected), live)
