"""Schema profiles of JSON records, and drift between two of them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakejobs.functions.naming import snake_column
from lakejobs.operators.coverage import KEYS

_NUMBER_KINDS = {"BIGINT": "integer", "INT": "integer", "SMALLINT": "integer", "TINYINT": "integer", "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _kind(v: Column) -> Column:
    t = F.schema_of_variant(v)
    out = F.when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t.startswith("DECIMAL"), F.when(t.rlike(r",0\)$"), "integer").otherwise("number"))
    for k, name in _NUMBER_KINDS.items():
        out = out.when(t == k, name)
    return out.otherwise("string")


def kinds(records: DataFrame, column: str = "record", levels: int = 2, by: list[str] = ()) -> DataFrame:
    """(by, path, type, present) over all JSON object texts: how often each key has each type, and keys one level down (a.b),
    array items (a[]) and the items' keys (a[].b). Keys of the top level that start with __ are left out."""
    v = records.select(*by, F.try_parse_json(column).alias("v")).where(F.col("v").isNotNull())
    explode = lambda: v.sparkSession.tvf.variant_explode(F.col("v").outer())
    top = v.lateralJoin(explode()).select(*by, F.col("key").alias("path"), F.col("value").alias("v")).where(~F.col("path").startswith("__"))
    every = top
    below = top
    for _ in range(levels - 1):
        objects = below.where(_kind(F.col("v")) == "object")
        inner = objects.lateralJoin(explode()).select(*by, F.concat("path", F.lit("."), "key").alias("path"), F.col("value").alias("v"))
        arrays = below.where(_kind(F.col("v")) == "array")
        items = arrays.lateralJoin(explode()).select(*by, F.concat("path", F.lit("[]")).alias("path"), F.col("value").alias("v"))
        fields = items.where(_kind(F.col("v")) == "object").lateralJoin(explode()).select(*by, F.concat("path", F.lit("."), "key").alias("path"), F.col("value").alias("v"))
        below = inner
        every = every.unionByName(inner).unionByName(items).unionByName(fields)
    return every.groupBy(*by, "path", _kind(F.col("v")).alias("type")).agg(F.count("*").alias("present"))


def _typed(found: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, path, types, present) of rows of kinds(): the types of each path in order, integer left out beside number."""
    out = found.groupBy(*by, "path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("present").alias("present"))
    merged = F.when(F.array_contains("types", "number"), F.array_remove("types", "integer")).otherwise(F.col("types"))
    return out.select(*by, "path", merged.alias("types"), "present")


def profile(records: DataFrame, column: str = "record", levels: int = 2) -> DataFrame:
    """(path, types, present) over all JSON object texts, see kinds()."""
    return _typed(kinds(records, column, levels))


# -- profiles that are kept: a few rows per run, so that later questions read no records


def run_profiles(records: DataFrame, column: str = "record", levels: int = 2) -> DataFrame:
    """(run keys, path, type, present) of records with run keys: the rows that a load appends to a table of profiles
    (tables.write_runs, which replaces a run that is loaded again)."""
    return kinds(records, column, levels, KEYS)


def merged(profiles: DataFrame) -> DataFrame:
    """(path, type, present, first_run, last_run) over all runs of kept profiles."""
    return profiles.groupBy("path", "type").agg(F.sum("present").alias("present"), F.min(KEYS[2]).alias("first_run"), F.max(KEYS[2]).alias("last_run"))


def names_of_run(profiles: DataFrame, run: Any) -> DataFrame:
    """(name, type) of one run by its stamp, for the drift frames; several types are joined by commas."""
    own = profiles.where(F.col(KEYS[2]) == F.lit(run).cast("timestamp"))
    return _typed(own).select(F.col("path").alias("name"), F.concat_ws(",", "types").alias("type"))


def drift_between(profiles: DataFrame, old: Any, new: Any) -> DataFrame:
    """drift_with_renames() between any two runs of kept profiles."""
    return drift_with_renames(names_of_run(profiles, old), names_of_run(profiles, new))


def drift_by_run(profiles: DataFrame) -> DataFrame:
    """(run, path, old_type, new_type, change): what each run's names and types change against those of the run before, by
    the run stamp; renames not resolved. The list of runs is put in order as a whole, which is a row per run."""
    typed = _typed(profiles, [KEYS[2]]).select(F.col(KEYS[2]).alias("run"), "path", F.concat_ws(",", "types").alias("type"))
    runs = typed.select("run").distinct().withColumn("before", F.lag("run").over(Window.orderBy("run"))).where("before is not null")
    now = typed.join(runs.select("run"), "run").select("run", "path", F.col("type").alias("new_type"))
    then = typed.join(runs.select(F.col("run").alias("next"), F.col("before").alias("run")), "run").select(F.col("next").alias("run"), "path", F.col("type").alias("old_type"))
    j = then.join(now, ["run", "path"], "full_outer")
    change = F.when(F.col("old_type").isNull(), "add").when(F.col("new_type").isNull(), "remove").when(F.col("old_type") != F.col("new_type"), "type_change")
    return j.withColumn("change", change).where("change is not null").select("run", "path", "old_type", "new_type", "change")


def draft_contract(found: DataFrame, rows: int) -> dict[str, Any]:
    """Object contract of the top-level keys of a profile; keys present in all rows are required."""
    properties: dict[str, Any] = {}
    required = []
    for r in found.where(~F.col("path").rlike(r"[.\[]")).orderBy("path").collect():
        properties[r["path"]] = {"type": r["types"][0] if len(r["types"]) == 1 else r["types"]}
        if r["present"] == rows:
            required.append(r["path"])
    return {"type": "object", "required": required, "properties": properties}


def drift_frame(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old_type, new_type, change) of two (name, type) frames, renames not resolved: a full outer join."""
    j = old.select("name", F.col("type").alias("old_type")).join(new.select("name", F.col("type").alias("new_type")), "name", "full_outer")
    change = F.when(F.col("old_type").isNull(), "add").when(F.col("new_type").isNull(), "remove").when(F.col("old_type") != F.col("new_type"), "type_change")
    return j.withColumn("change", change).where("change is not null")


def drift_with_renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, old_name, new_name, old_type, new_type) of two (name, type) frames, renames resolved by joins.

    A name that is gone and a fresh one are a rename if they have one snake-case form (of several, the greatest names),
    or if they are all that is left on either side and of one type, null aside.
    """
    before, after = old.select(F.col("name").alias("old_name"), F.col("type").alias("old_type")), new.select(F.col("name").alias("new_name"), F.col("type").alias("new_type"))
    order = ["change", "old_name", "new_name", "old_type", "new_type"]
    named = lambda df, change: df.withColumn("change", F.lit(change)).select(*order)
    none = F.lit(None).cast("string")
    changed = before.join(after, F.col("old_name") == F.col("new_name")).where("old_type <> new_type")
    gone, fresh = before.join(after, F.col("old_name") == F.col("new_name"), "left_anti"), after.join(before, F.col("old_name") == F.col("new_name"), "left_anti")
    by_form = lambda df, side: df.groupBy(snake_column(F.col(f"{side}_name")).alias("form")).agg(F.max(F.struct(f"{side}_name", f"{side}_type")).alias(side))
    respelt = by_form(gone, "old").join(by_form(fresh, "new"), "form").select("old.*", "new.*")
    gone, fresh = gone.join(respelt.select("old_name"), "old_name", "left_anti"), fresh.join(respelt.select("new_name"), "new_name", "left_anti")
    bare = lambda c: F.array_sort(F.array_remove(F.split(c, ","), "null"))
    lone = lambda df, side: df.agg(F.count("*").alias(f"{side}s"), F.max(F.struct(f"{side}_name", f"{side}_type")).alias(side))
    one = lone(gone, "old").join(lone(fresh, "new"), F.lit(True)).where("olds = 1 and news = 1").select("old.*", "new.*")  # one row on either side
    one = one.where((bare("old_type") == bare("new_type")) & (F.size(bare("old_type")) > 0))
    gone, fresh = gone.join(one.select("old_name"), "old_name", "left_anti"), fresh.join(one.select("new_name"), "new_name", "left_anti")
    out = named(changed, "type_change").unionByName(named(respelt.unionByName(one), "rename"))
    out = out.unionByName(named(gone.withColumns({"new_name": none, "new_type": none}), "remove"))
    return out.unionByName(named(fresh.withColumns({"old_name": none, "old_type": none}), "add"))
