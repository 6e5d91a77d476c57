"""JSON text of values as columns, in the form that row hashes are taken of: ASCII, shortest numbers, sorted names."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The short escapes of JSON.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
#: A public class whose static toString(double, fast) writes doubles.
_WRITER = "com.fasterxml.jackson.core.io.NumberOutput"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def string_text(value: Column) -> Column:
    """The JSON text of a string. Texts without anything to escape pass as they are."""

    def unit(x: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(code.between(32, 126) & ~c.isin('"', "\\"), c)
        for char, text in _ESCAPES.items():
            out = out.when(c == char, F.lit(text))
        pair = F.concat(unit(F.shiftright(code - 65536, 10) + 0xD800), unit((code - 65536).bitwiseAND(F.lit(1023)) + 0xDC00))
        return out.when(code > 65535, pair).otherwise(unit(code))

    escaped = F.array_join(F.transform(F.split(value, ""), one), "")
    return F.concat(F.lit('"'), F.when(value.rlike(r"^[ !#-\[\]-~]*$"), value).otherwise(escaped), F.lit('"'))


def number_text(value: Column) -> Column:
    """The shortest text that reads back as the double, with a fraction or an exponent: 51.0, 0.0001, 1e-05, 1e+16.

    Spark's own text of a double has a digit too many at times where Java is older than 19, so the digits are those of
    the writer of the JSON library that comes with Spark, which are the shortest on any.
    """

    def parsed(magnitude: Column) -> Column:
        parts = F.split(F.java_method(F.lit(_WRITER), F.lit("toString"), magnitude, F.lit(True)), "[.E]")
        fraction = F.regexp_replace(parts[1], "0+$", "")
        exponent = F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(3)).cast("int")).otherwise(0) - F.length(fraction)
        digits = F.concat(parts[0], fraction).cast("decimal(20,0)")
        return let(F.struct(digits.alias("d"), exponent.cast("int").alias("e"), magnitude.alias("v")), tiny)

    def tiny(found: Column) -> Column:
        """The writer gives the smallest doubles two digits, where one may do."""
        one = F.round(found["d"] / 10).cast("decimal(20,0)")
        fits = (found["v"] < 1e-321) & (F.concat(one.cast("string"), F.lit("E"), (found["e"] + 1).cast("string")).cast("double") == found["v"])
        return F.when(fits, F.struct(one.alias("d"), (found["e"] + 1).alias("e"))).otherwise(F.struct(found["d"].alias("d"), found["e"].alias("e")))

    def shown(found: Column) -> Column:
        whole = F.regexp_replace(found["d"].cast("string"), "(?<=.)0+$", "")
        return let(F.struct(whole.alias("s"), (found["e"] + F.length(found["d"].cast("string")) - 1).alias("x")), placed)

    def placed(f: Column) -> Column:
        s, x = f["s"], f["x"]  # digits, and the power of ten of the first one
        n = F.length(s)
        plain = F.when(x >= n - 1, F.concat(F.rpad(s, x + 1, F.lit("0")), F.lit(".0"))).when(x >= 0, F.concat(F.substring(s, F.lit(1), x + 1), F.lit("."), F.substring(s, x + 2, n)))
        plain = plain.otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -x - 1), s))
        power = F.concat(F.when(x < 0, "e-").otherwise("e+"), F.lpad(F.abs(x).cast("string"), F.greatest(F.lit(2), F.length(F.abs(x).cast("string"))), F.lit("0")))
        return F.when(x.between(-4, 15), plain).otherwise(F.concat(F.substring(s, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(s, F.lit(2), n))).otherwise(""), power))

    def text(v: Column) -> Column:
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        finite = let(parsed(F.abs(v)), shown)
        special = F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.concat(sign, F.lit("Infinity"))).when(v == 0, F.concat(sign, F.lit("0.0")))
        return F.when(v.isNotNull(), special.otherwise(F.concat(sign, finite)))

    return let(value.cast("double"), text)


def whole_text(digits: Column) -> Column:
    """The text of a whole number from a text of sign and digits: no plus, no leading zeros, no minus zero."""
    plain = F.regexp_replace(F.regexp_replace(digits, r"^\+|_", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(plain == "-0", "0").otherwise(plain)


def object_text(names: list[str], texts: list[Column]) -> Column:
    """The JSON text of an object with given names, sorted, and the JSON texts of their values (null: null)."""
    parts = []
    for i, (name, text) in enumerate(sorted(zip(names, texts, strict=True), key=lambda p: p[0])):
        parts += [F.lit((", " if i else "{") + json.dumps(name) + ": "), F.coalesce(text, F.lit("null"))]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
