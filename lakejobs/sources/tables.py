"""Bronze and ops tables on Parquet, partitioned by the three run keys or by day."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.functions import timekeys
from lakejobs.operators.contract import META, Contract, evolve
from lakejobs.operators.coverage import KEYS, without_runs
from lakejobs.operators.staging import Adapt, widened_names
from lakejobs.sources import paths

_BAD_KEYS = "run keys must be present and the same on all rows"
PARTITIONS = ["interval_start_key", "interval_end_key", "extract_run_key"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({p: timekeys.to_key(F.col(k)) for p, k in zip(PARTITIONS, KEYS, strict=True)})


def partitioned_by(spark: SparkSession, path: str) -> str | None:
    """extract_run, none, or None if there is no table."""
    paths.recover(spark, path)
    if not paths.exists(spark, path):
        return None
    return "extract_run" if any(c.startswith(f"{PARTITIONS[0]}=") for c in paths.children(spark, path)) else "none"


def read_bronze(spark: SparkSession, path: str, contract: Contract | None = None, adapt: Adapt | None = None) -> DataFrame:
    """Declared columns (or the table's own) without the partition keys, which filters on the run keys still prune.

    adapt: also the historical names that its knobs mention, so that older files give what coalesce and the like look
    for; names that no file has are null.
    """
    df = spark.read.option("mergeSchema", "true").parquet(path)
    out = df.drop(*PARTITIONS)
    if contract is None:
        return out
    have = {f.name for f in out.schema}
    want = {f.name: f.dataType.simpleString() for f in contract.struct_type(meta=False)} | (widened_names(contract, adapt) if adapt else {}) | {f.name: f.dataType.simpleString() for f in META}
    return out.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast(kind).alias(n) for n, kind in want.items()])


def write_runs(df: DataFrame, path: str, profile: str = "extract_run", single: bool = True) -> int:
    """Replace the runs of a batch: same keys are replaced, others stay; an empty batch writes nothing. Returns rows.

    Blank run keys, and keys of another run in a batch that is a single one, stop the write before anything is replaced.
    The batch is computed once: its keys are those of its first row, every row is held against them on its way to the
    files, and the rows are counted by an observation.
    """
    spark = df.sparkSession
    first = df.select(*KEYS).first()
    if first is None:
        return 0
    ok = reduce(lambda a, b: a & b, [F.trim(F.col(k).cast("string")) != "" for k in KEYS])
    if single:
        ok = ok & reduce(lambda a, b: a & b, [F.col(k) == F.lit(first[k]) for k in KEYS])
    stop = F.raise_error(F.concat(F.lit(f"{_BAD_KEYS}: "), F.to_json(F.struct(*KEYS))))
    rows = Observation(f"rows_{uuid.uuid4().hex}")
    df = df.withColumn(KEYS[0], F.when(F.coalesce(ok, F.lit(False)), F.col(KEYS[0])).otherwise(stop.cast(df.schema[KEYS[0]].dataType))).observe(rows, F.count(F.lit(1)).alias("n"))
    live = partitioned_by(spark, path)
    if live not in (None, profile):
        raise ValueError(f"the table is laid out as {live}, not {profile}; recreate it to change that")
    if live is not None:
        evolve(T.StructType([f for f in spark.read.parquet(path).schema if f.name not in PARTITIONS]), df.schema)
    try:
        _write(df, path, profile, single, live is not None)
    except PySparkException as error:
        if _BAD_KEYS in str(error):
            raise ValueError(f"{_BAD_KEYS}; nothing was replaced") from error
        raise
    return rows.get["n"]


def _write(df: DataFrame, path: str, profile: str, single: bool, live: bool) -> None:
    spark = df.sparkSession
    if profile == "extract_run":
        out = _keyed(df)
        if not single:
            out = out.hint("rebalance", *PARTITIONS)  # a run's rows come together; adaptive execution splits a large run
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    else:
        staged = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
        kept = without_runs(spark.read.parquet(path), df).unionByName(df, allowMissingColumns=True) if live else df
        kept.write.parquet(staged)
        paths.swap(spark, staged, path)


def write_json_runs(df: DataFrame, path: str, keys: dict[str, str] | None = None) -> None:
    """One JSON object per line, nulls included, below the run keys. An empty batch replaces its run too: name its keys."""
    spark = df.sparkSession
    if keys:
        folder = path.rstrip("/") + "".join(f"/{p}={keys[p]}" for p in PARTITIONS)
        paths.delete(spark, folder, path)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    _keyed(df).select(text.alias("value"), *PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).text(path)


def delete_runs(spark: SparkSession, path: str, removed: DataFrame) -> int:
    """Delete runs by exact keys: their folders, or a rewrite without them. removed: a retention plan, a row per run."""
    layout = partitioned_by(spark, path)
    if layout is None:
        return 0
    if layout == "none":
        staged = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
        without_runs(spark.read.parquet(path), removed).write.parquet(staged)
        paths.swap(spark, staged, path)
        return removed.count()
    n = 0
    for r in _keyed(removed.select(*KEYS)).select(*PARTITIONS).toLocalIterator():
        n += paths.delete(spark, path.rstrip("/") + "".join(f"/{p}={r[p]}" for p in PARTITIONS), path)
    return n


def list_runs(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct run keys from the partition columns: no data column is read."""
    df = spark.read.parquet(path)
    if all(p in df.columns for p in PARTITIONS):
        df = df.select(*PARTITIONS).distinct().select(*[timekeys.from_key(F.col(p)).alias(k) for p, k in zip(PARTITIONS, KEYS, strict=True)])
    else:
        df = df.select(*[F.date_trunc("second", k).alias(k) for k in KEYS]).distinct()
    out = df.where(timekeys.in_window(F.col(KEYS[0]), start, end)).orderBy(*KEYS)
    return out if limit is None else out.limit(limit)


def sample(df: DataFrame, limit: int, start: str | None = None, end: str | None = None, run: str | None = None) -> tuple[DataFrame, bool]:
    """First rows by run and row hash, and whether there are more."""
    rows = df.where(timekeys.in_window(F.col(KEYS[0]), start, end))
    rows = rows.where(F.col(KEYS[2]) == F.lit(run).cast("timestamp")) if run else rows
    order = [KEYS[2], "__row_hash"]
    return rows.orderBy(*order).limit(limit), rows.orderBy(*order).limit(limit + 1).count() > limit


def replace_days(df: DataFrame, path: str, since: str, until: str, day: str = "attempt_date", order: str = "attempt_id") -> dict[str, int]:
    """Replace each day of [since, until): days without rows lose their partition, rows of other days aren't written."""
    spark = df.sparkSession
    a, b = timekeys.attempt_window(since, until)
    own = df.where((F.col(day) >= F.lit(a)) & (F.col(day) < F.lit(b)))
    counts = {str(r[day]): r["count"] for r in own.groupBy(day).count().collect()}
    if counts:
        own.hint("rebalance", day).sortWithinPartitions(day, order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    days = (b - a).days
    for name in paths.children(spark, path):
        value = name.removeprefix(f"{day}=")
        if name.startswith(f"{day}=") and str(a) <= value < str(b) and value not in counts:
            paths.delete(spark, f"{path.rstrip('/')}/{name}", path)
    return {"days": days, "rows": sum(counts.values())}
