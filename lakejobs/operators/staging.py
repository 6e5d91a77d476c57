"""Staging frames: typed columns, flattened leaves, adaptations, and relations of nested arrays."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.functions import casts
from lakejobs.operators.contract import Contract
from lakejobs.operators.rows import META_COLUMNS


def _kinds(rules: dict[str, Any]) -> set[str]:
    kind = rules.get("type")
    return {kind} if isinstance(kind, str) else set(kind or ())


def _cast_name(kinds: set[str]) -> str:
    return next((k for k in ("integer", "number", "boolean") if k in kinds), "string")


@dataclass(frozen=True)
class Leaf:
    root: str
    path: tuple[str, ...]
    kind: str

    @property
    def name(self) -> str:
        return "__".join((self.root, *self.path))


def flatten_plan(contract: Contract, depth: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None, relations: list[str] | None = None) -> list[Leaf]:
    """Scalar leaves below the contract's objects. Arrays and relation roots give none; depth limits object levels."""
    skipped = {r.split(".")[0] for r in relations or ()}
    leaves: list[Leaf] = []

    def walk(root: str, rules: dict[str, Any], path: tuple[str, ...], level: int) -> None:
        for name, own in (rules.get("properties") or {}).items():
            if "properties" in own or "object" in _kinds(own):
                if depth is None or level < depth:
                    walk(root, own, (*path, name), level + 1)
            elif "array" not in _kinds(own) and "items" not in own:
                leaves.append(Leaf(root, (*path, name), _cast_name(_kinds(own))))

    for f in contract.fields:
        if "properties" in f.rules and f.name not in skipped and (not include or f.name in include) and f.name not in (exclude or ()):
            walk(f.name, f.rules, (), 1)
    return leaves


def check_collisions(names: list[str], reserved: list[str]) -> None:
    twice = sorted({n for n in names if names.count(n) > 1} | set(names) & set(reserved))
    if twice:
        raise ValueError(f"flattened columns collide: {twice}")


@dataclass
class Adapt:
    """What is done to logical columns, in this order: coalesce, sentinels, map, rename, exclude."""

    coalesce: dict[str, list[str]] = field(default_factory=dict)
    null_sentinels: dict[str, list] = field(default_factory=dict)
    map: dict[str, dict[str, str]] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if meta := [x for x in self.exclude if x.startswith("__")]:
            raise ValueError(f"meta columns can't be excluded: {meta}")

    @classmethod
    def scoped(cls, scope: str, **knobs: Any) -> Adapt:
        """Knobs of relative dotted keys below a path; renamed columns keep the prefix."""
        prefix = scope.replace(".", "__") + "__"
        full = lambda k: prefix + k.replace(".", "__")
        for k in [*knobs.get("rename", {}), *knobs.get("rename", {}).values(), *knobs.get("map", {}), *knobs.get("null_sentinels", {})]:
            if k.startswith((prefix, scope + ".")):
                raise ValueError(f"{k} repeats its scope {scope}")
        return cls(
            {full(k): [full(x) for x in v] for k, v in knobs.get("coalesce", {}).items()}, {full(k): v for k, v in knobs.get("null_sentinels", {}).items()},
            {full(k): v for k, v in knobs.get("map", {}).items()}, {full(k): prefix + v for k, v in knobs.get("rename", {}).items()}, [full(k) for k in knobs.get("exclude", [])],
        )

    def over(self, other: Adapt) -> Adapt:
        """Both; where they differ, this one's."""
        return Adapt(other.coalesce | self.coalesce, other.null_sentinels | self.null_sentinels, other.map | self.map, other.rename | self.rename, [*other.exclude, *[x for x in self.exclude if x not in other.exclude]])


def adapted(columns: dict[str, Column], adapt: Adapt) -> list[Column]:
    """Select list of logical columns after adaptation; of equal output names the first stays."""
    logical = dict(columns)
    for name, sources in adapt.coalesce.items():
        found = [columns[s] for s in sources if s in columns]
        if found:
            logical[name] = F.coalesce(*found)
        for s in sources:
            if s != name:
                logical.pop(s, None)
    out: dict[str, Column] = {}
    for name, value in logical.items():
        if name in adapt.exclude:
            continue
        value = casts.null_sentinels(value, adapt.null_sentinels.get(name, []))
        value = casts.value_map(value, adapt.map.get(name, {}))
        out.setdefault(adapt.rename.get(name, name), value)
    return [v.alias(n) for n, v in out.items()]


def staging_frame(bronze: DataFrame, contract: Contract, adapt: Adapt | None = None, flatten: bool = True, relations: list[str] | None = None, **plan: Any) -> DataFrame:
    """One narrow select over a bronze frame: typed columns, flattened leaves, adaptations, meta columns."""
    adapt = adapt or Adapt()
    columns: dict[str, Column] = {}
    leaves = flatten_plan(contract, relations=relations, **plan) if flatten else []
    meta = [F.col(c) for c in META_COLUMNS if c in bronze.columns]
    # Leaf texts are taken out once, in a projection of their own; the casts look at a text more than once.
    found = [x for x in leaves if x.root in bronze.columns]
    bronze = bronze.select(*[F.col(f"`{f.name}`") for f in contract.fields if f.name in bronze.columns], *meta, *[F.get_json_object(f"`{x.root}`", "$." + ".".join(x.path)).alias(f"__leaf_{x.name}") for x in found])
    for f in contract.fields:
        if f.name in bronze.columns and not f.nested:
            columns[f.name] = casts.CASTS[_cast_name(set(f.types))](F.col(f"`{f.name}`"))
        elif f.name in bronze.columns and f.nested and not flatten:
            columns[f.name] = F.col(f"`{f.name}`").cast("string")
    check_collisions([x.name for x in leaves], [*columns, *META_COLUMNS])
    for leaf in found:
        columns[leaf.name] = casts.CASTS[leaf.kind](F.col(f"`__leaf_{leaf.name}`"))
    return bronze.select(*adapted(columns, adapt), *meta)


def widened_names(contract: Contract, adapt: Adapt) -> dict[str, str]:
    """Every name that a read needs, historical ones of the adaptations included, with its type name."""
    out = {f.name: f.spark_type.simpleString() for f in contract.fields}
    for name, sources in adapt.coalesce.items():
        for s in sources:
            out.setdefault(s, out.get(name, "string"))
    for name in [*adapt.coalesce, *adapt.exclude, *adapt.null_sentinels, *adapt.map, *adapt.rename]:
        out.setdefault(name, "string")
    return out


# -- relations


def parent_key(contract: Contract, unique: list[str] | None = None, explicit: str | None = None) -> str:
    own = lambda names: next((n for n in names or () if not n.startswith("__")), None)
    found = explicit or own(unique) or own(contract.required)
    if not found:
        raise ValueError("a relation needs a parent key")
    return found


def relation_rules(contract: Contract, path: str) -> dict[str, Any]:
    """Rules of the items of a (nested) array, by dotted path."""
    rules: dict[str, Any] = {"properties": {f.name: f.rules for f in contract.fields}}
    for part in path.split("."):
        rules = (rules.get("properties") or {}).get(part) or {}
        if not isinstance(rules.get("items"), dict):
            raise ValueError(f"{path} is no array of the contract")
        rules = rules["items"]
    return rules


def index_names(levels: int) -> list[str]:
    return ["__rel_index"] if levels == 1 else [f"__rel_index_{i}" for i in range(levels)]


def relation_frame(bronze: DataFrame, contract: Contract, path: str, key: str, nested: list[str] | None = None) -> DataFrame:
    """Child rows of a nested array: parent key, 1-based indexes, scalar leaves of the items, meta columns.

    Only the parent key, the array and the meta columns are carried through the explode. Null and empty arrays give no
    rows; elements that are no objects give their value.
    """
    parts = path.split(".")
    rules = relation_rules(contract, path)
    names = index_names(len(parts))
    meta = [c for c in META_COLUMNS if c in bronze.columns]
    plain = "properties" not in rules
    deeper = {p.split(".")[len(parts)] for p in nested or () if p.startswith(path + ".")}
    leaves = [] if plain else _item_leaves(rules, deeper)
    # One parse per level gives all that is needed of its items, leaves and deeper arrays as texts.
    last: T.DataType = T.StringType() if plain else _texts_at([where for where, _ in leaves])
    kinds = [*[_texts_at([(p,)]) for p in parts[1:]], last]
    key_column = F.col(f"`{key}`")
    now = bronze.select(key_column, F.col(f"`{parts[0]}`").cast("string").alias("__text"), *meta)
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        text = F.col("__text") if i == 0 else F.col(f"__item.`{parts[i]}`")
        now = now.select(key_column, *names[:i], F.posexplode(_items(text, kind)).alias("__at", "__next"), *meta)
        now = now.select(key_column, *names[:i], (F.col("__at") + 1).alias(name), F.col("__next").alias("__item"), *meta)
    if plain:
        return now.select(key_column, *names, casts.CASTS[_cast_name(_kinds(rules))](F.col("__item")).alias("value"), *meta)
    texts = now.select(key_column, *names, *[F.col("__item." + ".".join(f"`{p}`" for p in where)).alias("__leaf_" + "__".join(where)) for where, _ in leaves], *meta)
    return texts.select(key_column, *names, *[casts.CASTS[cast](F.col("`__leaf_" + "__".join(where) + "`")).alias("__".join(where)) for where, cast in leaves], *meta)


def _item_leaves(rules: dict[str, Any], deeper: set[str]) -> list[tuple[tuple[str, ...], str]]:
    """(path, cast) of the scalar leaves of a relation's items; deeper: names that are relations of their own."""
    out: list[tuple[tuple[str, ...], str]] = []

    def walk(own: dict[str, Any], at: tuple[str, ...]) -> None:
        for name, r in (own.get("properties") or {}).items():
            if not at and name in deeper:
                continue
            if "properties" in r:
                walk(r, (*at, name))
            elif "array" not in _kinds(r) and "items" not in r:
                out.append(((*at, name), _cast_name(_kinds(r))))

    walk(rules, ())
    return out


def _texts_at(paths: list[tuple[str, ...]]) -> T.StructType:
    """Structs with a text at each path."""
    below: dict[str, list[tuple[str, ...]]] = {}
    for head, *rest in paths:
        below.setdefault(head, []).append(tuple(rest))
    return T.StructType([T.StructField(n, _texts_at(rest) if rest[0] else T.StringType()) for n, rest in below.items()])


def _items(text: Column, kind: T.DataType) -> Column:
    """The items of a JSON array text. An item that is no object leaves the whole array unread; only then the items are
    read one by one, and such an item is null."""
    parsed = F.from_json(text, T.ArrayType(kind))
    if isinstance(kind, T.StructType):
        one_by_one = F.transform(F.from_json(text, "array<string>"), lambda x: F.from_json(x, kind))
        parsed = F.coalesce(parsed, one_by_one)
    return F.when(F.ltrim(text).startswith("["), parsed)


def explode_estimate(df: DataFrame, column: str, parent_limit: int = 500_000, child_limit: int = 2_000_000) -> DataFrame:
    """One row: parent rows, mean array length, child rows, and whether either is at its limit."""
    n = casts.array_length(F.col(column))
    out = df.agg(F.count("*").alias("parent_rows"), F.avg(n).alias("mean_length"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("child_rows"))
    return out.withColumns({"warn_parent": F.col("parent_rows") >= parent_limit, "warn_child": F.col("child_rows") >= child_limit})
