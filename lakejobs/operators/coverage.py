"""Runs as keys: listings, coverage of raw and bronze, gaps, retention, and the runs to rebuild."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakejobs.functions import timekeys

KEYS = ["__interval_start_datetime", "__interval_end_datetime", "__extract_run_datetime"]


def run_keys(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct run keys at whole seconds; the window is on the interval start and reaches the scan."""
    rows = df.where(timekeys.in_window(F.col(KEYS[0]), start, end)).select(*[F.date_trunc("second", c).alias(c) for c in KEYS])
    return rows.distinct()


def diff_runs(raw: DataFrame, bronze: DataFrame) -> DataFrame:
    """Every run key with its side: only_raw, only_bronze or both."""
    left, right = raw.select(*KEYS).distinct().withColumn("__l", F.lit(True)), bronze.select(*KEYS).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__r").isNull(), "only_raw").when(F.col("__l").isNull(), "only_bronze").otherwise("both")
    return left.join(right, KEYS, "full_outer").select(*KEYS, side.alias("side"))


def only_left(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS).distinct().exceptAll(b.select(*KEYS).distinct())


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS).intersect(b.select(*KEYS))


def missing_days(landed: DataFrame, start: str, end: str) -> DataFrame:
    """Days of [start, end) without a landed run of just that day."""
    spark = landed.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 1), F.expr("INTERVAL 1 DAY"))).alias("day"))
    have = landed.where(F.col(KEYS[1]) == F.col(KEYS[0]) + F.expr("INTERVAL 1 DAY")).where(F.col(KEYS[0]) == F.date_trunc("day", KEYS[0])).select(F.to_date(KEYS[0]).alias("day")).distinct()
    return days.join(have, "day", "left_anti")


def retention(runs: DataFrame, keep: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """Run keys with an action: of each interval the newest runs are kept, the rest removed."""
    if keep < 1:
        raise ValueError("at least one run must be kept")
    place = F.row_number().over(Window.partitionBy(*KEYS[:2]).orderBy(F.desc(KEYS[2])))
    return run_keys(runs, start, end).withColumn("action", F.when(place <= keep, "keep").otherwise("remove"))


def latest_committed(runs: DataFrame, every_run: bool = False, run: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The newest run of each interval, or every run, or the one named."""
    rows = runs.where(timekeys.in_window(F.col(KEYS[0]), start, end))
    if run is not None:
        return rows.where(F.col(KEYS[2]) == F.lit(run).cast("timestamp"))
    if every_run:
        return rows
    place = F.row_number().over(Window.partitionBy(*KEYS[:2]).orderBy(F.desc(KEYS[2])))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def newest_run(runs: DataFrame) -> DataFrame:
    """The newest run of all; no run is an error of whoever collects it."""
    return runs.orderBy(F.desc(KEYS[2]), F.desc(KEYS[0])).limit(1)


def without_runs(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows whose three keys aren't among the removed ones."""
    gone = removed.select(*[F.col(k).alias(f"__gone_{k}") for k in KEYS]).distinct()
    same = reduce(lambda a, b: a & b, [F.date_trunc("second", k) == F.col(f"__gone_{k}") for k in KEYS])
    return df.join(gone, same, "left_anti")


def require_identity(df: DataFrame) -> DataFrame:
    """One row: rows, rows with a missing key, distinct keys; ok for an empty batch or one key on all rows."""
    blank: Column = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in KEYS])
    out = df.agg(F.count("*").alias("rows"), F.count_if(blank).alias("blank"), F.count_distinct(F.struct(*KEYS)).alias("identities"))
    return out.withColumn("ok", (F.col("rows") == 0) | ((F.col("blank") == 0) & (F.col("identities") == 1)))


def newest_only_raw(diff: DataFrame) -> DataFrame:
    """The newest run of a diff_runs() frame that bronze hasn't: one row or none."""
    return newest_run(diff.where("side = 'only_raw'").select(*KEYS))


def findings(diff: DataFrame, invalid: Column | None = None) -> DataFrame:
    """Diagnosis of a diff_runs() frame: (code, severity, runs). invalid: whether the newest raw-only run fails its contract."""
    n = diff.agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("only_raw", "only_bronze", "both")])
    bad = invalid if invalid is not None else F.lit(False)
    total = F.col("only_raw") + F.col("only_bronze") + F.col("both")
    row = lambda code, severity, runs: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), runs.cast("long").alias("runs"))
    found = F.array_compact(
        F.array(
            F.when(total == 0, row("empty_lake", "error", total)), F.when(bad & (F.col("only_raw") > 0), row("schema_invalid", "error", F.lit(1))), F.when(F.col("only_raw") > 0, row("raw_without_bronze", "warning", F.col("only_raw"))),
            F.when(F.col("only_bronze") > 0, row("bronze_without_raw", "warning", F.col("only_bronze"))), F.when((total > 0) & (total == F.col("both")), row("ok", "info", F.col("both"))),
        )
    )
    return n.select(F.explode(found).alias("f")).select("f.*")


def version_or_one(value: Column) -> Column:
    """Manifest versions: missing, unreadable or under one count as one."""
    v = F.trim(value.cast("string")).try_cast("int")
    return F.when(v >= 1, v).otherwise(F.lit(1))
