"""Ops refresh: receipts to a day-partitioned table, the daily roll-up, and the service-level rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.operators import runs
from lakejobs.sources import raw, tables


def materialise(spark: SparkSession, lake: str, target: str, since: str, until: str) -> dict[str, int]:
    """Replace the days of the window by the receipts found; returns days, rows and skipped receipts."""
    found = raw.read_receipts(spark, lake, since, until)
    counts = runs.skipped(found).first()
    return tables.replace_days(runs.normalise(found), target, since, until) | {"skipped": counts["skipped"]}


def service_levels(receipts: DataFrame, expected: DataFrame, as_of: str) -> DataFrame:
    """(check, pipeline, command, detail): everything that fails at an instant."""
    now, mart = F.lit(as_of).cast("timestamp"), runs.daily(receipts)
    row = lambda df, name, detail: df.select(F.lit(name).alias("check"), "pipeline", "command", detail.cast("string").alias("detail"))
    out = row(runs.error_rate_failures(expected, mart, now), "error_rate", F.col("error_rate"))
    out = out.unionByName(row(runs.p95_failures(expected, mart, now), "p95", F.col("observed_p95_ms")))
    out = out.unionByName(row(runs.recency_failures(expected, receipts, now), "recency", F.col("last_ok_at")))
    return out.unionByName(row(runs.fail_closed(expected, receipts, now), "fail_closed", F.col("attempt_id")))
