"""Staging casts (bad text is null), JSON path casts, and small text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakejobs.functions.jsontext import let

_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+)?|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"


def text(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def double(value: Column) -> Column:
    """Numbers only: suffixes that the JVM would accept (5d, 5f) are null. Plain decimals are read at once."""
    t = text(value)
    return F.when(t.rlike(r"^[+-]?\d{1,18}(\.\d{1,18})?$"), t.try_cast("double")).when(t.isNotNull(), let(F.regexp_replace(t, r"(?<=\d)_(?=\d)", ""), _any_double))


def _any_double(t: Column) -> Column:
    return F.when(t.rlike(_NUMBER) | t.rlike(_SPECIAL), t.try_cast("double"))


def integer(value: Column) -> Column:
    """32-bit integers; fractions round half away from zero, as DuckDB does. Plain ones are read at once."""
    t = text(value)
    return F.when(t.rlike(r"^[+-]?\d{1,9}$"), t.try_cast("int")).when(t.isNotNull(), let(t, _any_integer))


def _any_integer(t: Column) -> Column:
    return let(F.round(F.when(t.rlike(_NUMBER), double(t)), 0), lambda x: F.when(x.between(-2147483648.0, 2147483647.0), x).cast("int"))


def boolean(value: Column) -> Column:
    return text(value).try_cast("boolean")


CASTS = {"string": text, "integer": integer, "number": double, "boolean": boolean}


def json_path(document: Column, path: str, kind: str = "string") -> Column:
    """A leaf of a JSON text by dotted path, cast as in staging; malformed JSON is null."""
    return CASTS[kind](F.get_json_object(document, f"$.{path}"))


def null_sentinels(value: Column, sentinels: list) -> Column:
    return reduce(lambda c, s: c if s is None else F.nullif(c, F.lit(s)), sentinels, value)


def value_map(value: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return value
    first, *rest = mapping.items()
    out = F.when(value == first[0], F.lit(first[1]))
    for k, v in rest:
        out = out.when(value == k, F.lit(v))
    return out.otherwise(value)


def damage_amount(damage: Column) -> Column:
    """Text such as 10.00K -> number. Letters are dropped, the last character is the unit, what is no number is 0."""
    t = F.lower(F.coalesce(damage, F.lit("")))
    number = F.coalesce(double(F.regexp_replace(t, "[a-z]", "")), F.lit(0.0))
    unit = F.right(t, F.lit(1))
    factor = F.when(unit == "h", 100.0).when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return number * factor


def optional_int(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast("long")


def optional_text(value: Column) -> Column:
    return text(value)


def scrub(message: Column, longest: int = 500) -> Column:
    """Mask user info and credential parameters of URIs in a text, then cut it."""
    masked = F.regexp_replace(message, r"""([A-Za-z][A-Za-z0-9+.\-]*://)[^/\s@"']+@""", "$1***@")
    masked = F.regexp_replace(masked, r"""(?i)([?&](?:password|token|api_key|secret)=)[^&\s"']+""", "$1***")
    return F.substring(F.when(message.contains("://"), masked).otherwise(message), 1, longest)


def array_length(value: Column) -> Column:
    """Length of a JSON array text: null counts 0, what is no array is null."""
    return F.when(value.isNull(), F.lit(0)).otherwise(F.json_array_length(value))
