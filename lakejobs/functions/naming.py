"""Column and key names in snake case."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def snake(name: str) -> str:
    """camelCase, kebab-case, spaces and upper case to snake_case; names that start with __ stay."""
    if name.startswith("__"):
        return name
    parts = re.split(_EDGE, name.replace('"', "").strip())
    return re.sub(r"[^a-z0-9]+", "_", "_".join(parts).lower()).strip("_")


def snake_column(name: Column) -> Column:
    """The same for name values."""
    text = F.regexp_replace(F.trim(F.replace(name, F.lit('"'), F.lit(""))), _EDGE, "_")
    text = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name.startswith("__"), name).otherwise(text)


def _unique(names: list[str], path: str, style: str) -> list[str]:
    out = [n if style == "identity" else snake(n) for n in names]
    for n, raw in zip(out, names, strict=True):
        if out.count(n) > 1:
            raise ValueError(f"naming collision at {path or '<root>'}: several keys become {n!r} (one is {raw!r})")
    return out


def _renamed(kind: T.DataType, path: str, style: str) -> T.DataType:
    if isinstance(kind, T.StructType):
        names = _unique([f.name for f in kind], path, style)
        return T.StructType([T.StructField(n, _renamed(f.dataType, f"{path}.{n}" if path else n, style), f.nullable) for n, f in zip(names, kind, strict=True)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType, f"{path}[]", style), kind.containsNull)
    return kind


def apply_naming(df: DataFrame, style: str = "snake_case") -> DataFrame:
    """Rename columns and the fields of structs in them; two names that become one are an error."""
    if style not in ("snake_case", "identity"):
        raise ValueError(f"unknown naming style {style!r}")
    kind = _renamed(df.schema, "", style)
    return df.select(*[F.col(f"`{old.name}`").cast(new.dataType).alias(new.name) if old.dataType != new.dataType else F.col(f"`{old.name}`").alias(new.name) for old, new in zip(df.schema, kind, strict=True)])


def rename_if_present(df: DataFrame, old: str, new: str) -> DataFrame:
    """Mapper: old becomes new only where old is there and new isn't."""
    return df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df
