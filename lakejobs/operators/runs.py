"""Run receipts: normalisation, summaries, the daily roll-up, and service-level checks. as_of is always a parameter."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakejobs.functions import casts, timekeys

RECEIPT_VERSION = 1
#: Error codes that are never tolerated.
FAIL_CLOSED = ("schema_invalid", "integrity_error", "secret_not_set")
#: Hours of recency and of scoring by cadence.
CADENCES = {"daily": (26, 24), "weekly": (192, 168), "hourly": (2, 24)}
_TEXT = ("interval_start", "interval_end", "extract_run_datetime", "finished_at", "destination", "schema_sha256", "error_code", "error_class")
_INT = ("wire_version", "duration_ms", "artifacts", "raw_bytes", "rows")
COLUMNS = (
    "receipt_version", "attempt_id", "attempt_date", "pipeline", "command", "interval_start", "interval_end", "extract_run_datetime", "wire_version", "status", "started_at",
    "finished_at", "duration_ms", "owner", "destination", "artifacts", "raw_bytes", "rows", "schema_sha256", "error_code", "error_class", "error_message",
)


def usable(raw: DataFrame) -> Column:
    """Whether a raw receipt has its identity and a start that can be read."""
    named = [casts.optional_text(F.col(c)).isNotNull() for c in ("attempt_id", "pipeline", "command", "status")]
    out = timekeys.instant(F.col("started_at").cast("string")).isNotNull()
    for c in named:
        out = out & c
    return out


def normalise(raw: DataFrame) -> DataFrame:
    """Usable receipts in the 22 columns; what is missing in the input is null."""
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None)
    out = {c: casts.optional_text(have(c)) for c in ("attempt_id", "pipeline", "command", "status", *_TEXT)} | {c: casts.optional_int(have(c)) for c in _INT}
    out["receipt_version"] = F.coalesce(casts.optional_int(have("receipt_version")), F.lit(RECEIPT_VERSION).cast("long"))
    out["started_at"] = F.col("started_at").cast("string")
    out["attempt_date"] = F.to_date(timekeys.instant(out["started_at"]))
    out["owner"] = F.coalesce(casts.optional_text(have("owner")), F.lit(""))
    out["error_message"] = casts.scrub(have("error_message").cast("string"))
    return raw.where(usable(raw)).select(*[out[c].alias(c) for c in COLUMNS])


def skipped(raw: DataFrame) -> DataFrame:
    """One row: receipts, and those of them that are not usable."""
    return raw.agg(F.count("*").alias("receipts"), F.count_if(~F.coalesce(usable(raw), F.lit(False))).alias("skipped"))


def newest(receipts: DataFrame, limit: int = 200) -> DataFrame:
    return receipts.orderBy(F.desc_nulls_last("started_at"), "attempt_id").limit(max(1, limit))


_COUNTS = ("attempts", "ok", "error", "rows")


def _ranked(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, duration_ms, counts, upto, all): the receipts counted by duration, which combines before the shuffle, with the
    number of those that have a duration up to this one and of all that have one. Groups are sorted, not held."""
    by_value = receipts.groupBy(*keys, "duration_ms").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"), F.sum("rows").alias("rows"))
    timed = F.when(F.col("duration_ms").isNotNull(), F.col("attempts")).otherwise(0)
    group = Window.partitionBy(*keys)
    upto = F.sum(timed).over(group.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0))
    return by_value.withColumns({"upto": upto, "all": F.sum(timed).over(group)})


def _at(rank: Column) -> Column:
    """The value of a rank, counted from 0, as an aggregate over the rows of _ranked()."""
    return F.min(F.when(F.col("upto") > rank, F.col("duration_ms")))


def _summed() -> list[Column]:
    return [F.sum(c).alias(c) for c in _COUNTS]


def _interpolated(ranked: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Sums and interpolated percentiles per group: between the values of the two ranks next to share * (all - 1)."""
    place = {name: F.lit(q) * (F.col("all") - 1) for name, q in shares.items()}
    low = [_at(F.floor(x)).alias(f"{name}_low") for name, x in place.items()]
    high = [_at(F.ceil(x)).alias(f"{name}_high") for name, x in place.items()]
    out = ranked.groupBy(*keys).agg(*_summed(), F.max("all").alias("all"), *low, *high)
    value = lambda n, x: F.when(F.floor(x) == F.ceil(x), F.col(f"{n}_low").cast("double")).otherwise((F.ceil(x) - x) * F.col(f"{n}_low") + (x - F.floor(x)) * F.col(f"{n}_high"))
    return out.select(*keys, *_COUNTS, *[value(n, x).alias(n) for n, x in place.items()])


def summary(receipts: DataFrame) -> DataFrame:
    """By pipeline and command: counts, error codes, nearest-rank percentiles, rows."""
    keys = ["pipeline", "command"]
    nearest = lambda percent: _at(F.floor((F.col("all") * percent + 99) / 100) - 1)
    base = _ranked(receipts, keys).groupBy(*keys).agg(*_summed(), nearest(50).alias("p50_ms"), nearest(95).alias("p95_ms"))
    base = base.select(*keys, "attempts", "ok", "error", "p50_ms", "p95_ms", F.coalesce("rows", F.lit(0)).alias("rows"))
    codes = receipts.where("status = 'error'").groupBy("pipeline", "command", F.coalesce(F.nullif("error_code", F.lit("")), F.lit("unknown")).alias("code")).agg(F.count("*").alias("n"))
    codes = codes.groupBy("pipeline", "command").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("error_codes"))
    none = F.array().cast("array<struct<code:string,n:bigint>>")
    return base.join(codes, ["pipeline", "command"], "left").withColumn("error_codes", F.map_from_entries(F.coalesce("error_codes", none)))


def daily(receipts: DataFrame, approximate: bool = False) -> DataFrame:
    """The roll-up by day, pipeline and command, with interpolated percentiles (approximate on demand)."""
    keys = ["attempt_date", "pipeline", "command"]
    if not approximate:
        found = _interpolated(_ranked(receipts, keys), keys, {"p50_ms": 0.5, "p95_ms": 0.95})
        return found.select(*keys, "attempts", "ok", "error", "p50_ms", "p95_ms", "rows")
    p = lambda q: F.percentile_approx("duration_ms", q, 10_000).cast("double")
    return receipts.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), F.sum("rows").alias("rows"),
    )


# -- expectations


def expectation_rows(pipeline: str, slo: dict[str, Any]) -> list[tuple]:
    """(pipeline, command, cadence, recency_hours, score_hours, max_error_rate, p95_ms) per command. A command's own
    settings replace the shared ones that they set; False leaves the command out."""
    shared = {k: slo.get(k) for k in ("cadence", "recency_hours", "score_hours", "max_error_rate", "p95_ms")}
    if shared["cadence"] is None and shared["recency_hours"] is None:
        raise ValueError("an expectation needs a cadence or recency hours")
    rows = []
    for command in ("extract", "load"):
        own = slo.get(command)
        if own is False:
            continue
        x = shared | {k: v for k, v in (own or {}).items() if v is not None}
        recency, score = CADENCES.get(x["cadence"], (None, None))
        recency = x["recency_hours"] if x["recency_hours"] is not None else recency
        score = x["score_hours"] if x["score_hours"] is not None else score if score is not None else recency
        rows.append((pipeline, command, x["cadence"], recency, score, None if x["max_error_rate"] is None else float(x["max_error_rate"]), x["p95_ms"]))
    return rows


EXPECTATION = "pipeline string, command string, cadence string, recency_hours int, score_hours int, max_error_rate double, p95_ms int"


def expectations(spark: SparkSession, slos: dict[str, dict[str, Any]]) -> DataFrame:
    return spark.createDataFrame([r for p, s in slos.items() for r in expectation_rows(p, s)], EXPECTATION)


def expectation_coverage(expected: DataFrame, receipts: DataFrame) -> DataFrame:
    """Expectations against the pipelines and commands of which there are receipts, with attempts and the side: both,
    only_expected (configured, never run) or only_receipts (run, but nothing is expected of it)."""
    ran = receipts.groupBy("pipeline", "command").agg(F.count("*").alias("attempts"))
    j = expected.withColumn("wanted", F.lit(True)).join(ran, ["pipeline", "command"], "full_outer")
    side = F.when(F.col("attempts").isNull(), "only_expected").when(F.col("wanted").isNull(), "only_receipts").otherwise("both")
    return j.select(*expected.columns, F.coalesce("attempts", F.lit(0)).alias("attempts"), side.alias("side"))


def _windowed(expected: DataFrame, mart: DataFrame, as_of: Column) -> DataFrame:
    """Expectations (a row per configured pipeline and command) left-joined with the mart's days in their window."""
    e, d = expected.alias("e"), mart.alias("d")
    since = F.to_date(timekeys.hours_before(as_of, F.col("e.score_hours")))
    return e.join(d, (F.col("d.pipeline") == F.col("e.pipeline")) & (F.col("d.command") == F.col("e.command")) & (F.col("d.attempt_date") >= since), "left")


def error_rate_failures(expected: DataFrame, mart: DataFrame, as_of: Column) -> DataFrame:
    w = _windowed(expected.where("max_error_rate is not null"), mart, as_of).groupBy("e.pipeline", "e.command", "e.max_error_rate")
    out = w.agg(F.coalesce(F.sum("d.attempts"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("d.error"), F.lit(0)).alias("errors"))
    out = out.withColumn("error_rate", F.when(F.col("attempts") > 0, F.col("errors").cast("double") / F.col("attempts")))
    return out.where(F.col("error_rate").isNull() | (F.col("error_rate") > F.col("max_error_rate")))


def p95_failures(expected: DataFrame, mart: DataFrame, as_of: Column) -> DataFrame:
    w = _windowed(expected.where("p95_ms is not null"), mart, as_of).groupBy("e.pipeline", "e.command", F.col("e.p95_ms").alias("max_p95_ms"))
    return w.agg(F.max("d.p95_ms").alias("observed_p95_ms")).where("observed_p95_ms is null or observed_p95_ms > max_p95_ms")


def latest_ok(receipts: DataFrame) -> DataFrame:
    return receipts.where("status = 'ok'").groupBy("pipeline", "command").agg(F.max(timekeys.instant(F.col("started_at").cast("string"))).alias("last_ok_at"))


def recency_failures(expected: DataFrame, receipts: DataFrame, as_of: Column) -> DataFrame:
    j = expected.select("pipeline", "command", "recency_hours").join(latest_ok(receipts), ["pipeline", "command"], "left")
    return j.where(F.col("last_ok_at").isNull() | (F.col("last_ok_at") < timekeys.hours_before(as_of, F.col("recency_hours"))))


def fail_closed(expected: DataFrame, receipts: DataFrame, as_of: Column) -> DataFrame:
    """Receipts of codes that are never tolerated, in the score window of a configured pair."""
    j = receipts.where(F.col("error_code").isin(*FAIL_CLOSED)).join(expected.select("pipeline", "command", "score_hours"), ["pipeline", "command"])
    recent = timekeys.instant(F.col("started_at").cast("string")) >= timekeys.hours_before(as_of, F.col("score_hours"))
    return j.where(recent).select("pipeline", "command", "attempt_id", "error_code", "started_at")
