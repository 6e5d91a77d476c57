"""Silver builds: latest-run dedupe, incremental upserts, and data checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakejobs.operators.contract import Contract


def latest_run(df: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The first row of each key by the order (latest run first unless given). Add the columns that break ties."""
    order = order or [F.col("__extract_run_datetime").desc_nulls_last()]
    place = F.row_number().over(Window.partitionBy(*(keys or ["__row_hash"])).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def latest_run_by_aggregate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """latest_run() for many duplicates per key: a grouped maximum, combined before the shuffle. The order columns must
    be comparable and not null; larger is later."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def after_watermark(new: DataFrame, target: DataFrame, watermark: str, lookback: str | None = None) -> DataFrame:
    """Rows of the new frame that the target hasn't seen: later than its watermark, or not before it less the lookback.
    One scalar comes to the driver, so that the filter reaches the scan."""
    high = target.agg(F.max(watermark)).first()[0]
    if high is None:
        return new
    limit = F.lit(high)
    return new.where(F.col(watermark) > limit) if lookback is None else new.where(F.col(watermark) >= limit - F.expr(f"INTERVAL {lookback}"))


def replaced(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """target without the keys of the batch, and the batch. Null keys equal each other."""
    new = batch.select(*[F.col(k).alias(f"__new_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in keys])
    return target.join(new, same, "left_anti").unionByName(batch, allowMissingColumns=True)


def incremental(target: DataFrame, staged: DataFrame, keys: list[str], watermark: str = "__extract_run_datetime", lookback: str | None = None, order: list[Column] | None = None, strategy: str = "delete+insert") -> DataFrame:
    """The silver table after one incremental build; only the new slice is deduplicated."""
    if strategy not in ("delete+insert", "merge", "append"):
        raise ValueError(f"unknown strategy {strategy!r}")
    fresh = latest_run(after_watermark(staged, target, watermark, lookback), keys, order or [F.col(watermark).desc_nulls_last()])
    if strategy == "append":
        return target.unionByName(fresh, allowMissingColumns=True)
    return replaced(target, fresh, keys)


def stamped(df: DataFrame, at: Column | None = None) -> DataFrame:
    """df with the two stamps of a silver model, when its rows were processed and last updated: the time of the job."""
    now = at if at is not None else F.current_timestamp()
    return df.withColumns({"__silver_processed_at": now, "__silver_updated_at": now})


def relation_silver(relation: DataFrame, parent: str, indexes: list[str], order: list[Column] | None = None) -> DataFrame:
    return latest_run(relation, [parent, *indexes], order)


# -- checks


@dataclass
class Checks:
    not_null: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    accepted: dict[str, list] = field(default_factory=dict)

    @classmethod
    def derived(cls, contract: Contract, keys: list[str], not_null: list[str] = (), unique: list[str] = (), accepted: dict[str, list] | None = None, parent: str | None = None) -> Checks:
        """From keys, required fields and the row hash; a single key is unique; a relation's parent key is not null."""
        nulls = list(dict.fromkeys([*keys, *contract.required, "__row_hash", *([parent] if parent else []), *not_null]))
        return cls(nulls, list(dict.fromkeys([*(keys if len(keys) == 1 else []), *unique])), dict(accepted or {}))


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def unaccepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"))


def _exact(df: DataFrame, column: str) -> Column:
    """A value as a text that is equal where values are; minus zero is zero."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")
    return F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def run_checks(df: DataFrame, plan: Checks) -> DataFrame:
    """(check, column, failures): null rows, repeated values, unaccepted values. One pass, however many checks: each row gives
    what concerns a check as (check, column, value), and these are counted, combined before the shuffle, so that nulls and
    frequent values travel as one row a task."""
    spark = df.sparkSession
    of = lambda check, c, value: F.struct(F.lit(check).alias("check"), F.lit(c).alias("column"), value.alias("value"))
    found = [F.when(F.col(f"`{c}`").isNull(), of("not_null", c, F.lit(None).cast("string"))) for c in plan.not_null]
    found += [F.when(F.col(f"`{c}`").isNotNull(), of("unique", c, _exact(df, c))) for c in plan.unique]
    found += [F.when(F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").isin(values), of("accepted_values", c, _exact(df, c))) for c, values in plan.accepted.items()]
    if not found:
        return spark.createDataFrame([], "check string, column string, failures long")
    counted = df.select(F.explode(F.array_compact(F.array(*found))).alias("f")).groupBy("f.check", "f.column", "f.value").agg(F.count("*").alias("n"))
    failures = F.when(F.col("check") == "not_null", F.col("n")).when(F.col("check") == "unique", (F.col("n") > 1).cast("long")).otherwise(F.lit(1).cast("long"))
    planned = [("not_null", c) for c in plan.not_null] + [("unique", c) for c in plan.unique] + [("accepted_values", c) for c in plan.accepted]
    every = counted.select("check", "column", failures.alias("failures")).unionByName(spark.createDataFrame([(*p, 0) for p in planned], "check string, column string, failures long"))
    return every.groupBy("check", "column").agg(F.sum("failures").alias("failures"))
