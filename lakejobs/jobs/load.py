"""Raw to bronze: one run, or all of them again with a new contract."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.functions import timekeys
from lakejobs.functions.naming import apply_naming
from lakejobs.operators import coverage
from lakejobs.operators.contract import Contract, exploded_errors, outcome, validated, with_errors
from lakejobs.operators.coverage import KEYS
from lakejobs.operators.rows import attach_meta, coerce_json, renamed_json
from lakejobs.sources import paths, raw, tables

Mapper = Callable[[DataFrame], DataFrame]


@dataclass
class Source:
    """How a feed's artifacts are read: csv, or JSON pages with a record path."""

    kind: str
    record_path: str = ""
    style: str = "snake_case"
    mapper: Mapper | None = None

    def read(self, spark: SparkSession, files: list[str], located: bool = False) -> DataFrame:
        return raw.read_csv(spark, files, located) if self.kind == "csv" else raw.read_pages(spark, files, self.record_path, located)


def bronze_frame(rows: DataFrame, contract: Contract, source: Source, loaded_at: str, strict: bool = True, stop_at: str | None = None) -> DataFrame:
    """Names, mapper, coercion, validation and meta columns over raw rows that carry the run keys and __filename.
    stop_at: "rows", "named" or "coerced" (of JSON, the record text is that of the step). Not strict: bad rows stay, with __errors."""
    if stop_at == "rows":
        return rows
    if source.kind != "csv" and stop_at == "named":
        return renamed_json(source.mapper(rows) if source.mapper else rows, rename=source.style != "identity")
    if source.kind != "csv":
        checked = coerce_json(source.mapper(rows) if source.mapper else rows, contract, rename=source.style != "identity")
        if stop_at == "coerced":
            return checked
        own = checked
        if strict:
            stop = F.raise_error(F.concat(F.lit("contract: "), F.concat_ws("; ", F.slice("__errors", 1, 10)))).cast("string")
            own = own.withColumn("__row_hash", F.when(F.size("__errors") > 0, stop).otherwise(F.col("__row_hash")))
        columns = own.select(*[F.col(f"__fields.`{f.name}`").alias(f.name) for f in contract.fields], "__filename", *KEYS, "__row_hash", *([] if strict else ["__errors"]))
        hashed = True
    else:
        named = apply_naming(rows, source.style)
        named = source.mapper(named) if source.mapper else named
        if stop_at == "named":
            return named
        columns = validated(named, contract, stop_at is None) if strict else with_errors(named, contract, stop_at is None)
        hashed = False
        if stop_at == "coerced":
            return columns
        order = [f.name for f in contract.fields if f.name in columns.columns]
        columns = columns.select(*order, *[c for c in columns.columns if c.startswith("__")])
    out = attach_meta(columns, F.col("__filename"), F.col(KEYS[2]), F.col(KEYS[0]), F.col(KEYS[1]), F.lit(loaded_at).cast("timestamp"), hashed)
    have = set(out.columns)
    return out.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in contract.struct_type()], *[c for c in ("__errors",) if c in have])


def run_rows(spark: SparkSession, runs: DataFrame, source: Source) -> DataFrame:
    """Rows of all artifacts of the given runs, with their run keys; the runs are read in one job. The file list is that of
    the chosen runs' manifests, and each row meets its run by the whole path; a row of no run is an error. Runs without artifacts
    have no rows."""
    listed = raw.artifacts(runs)
    files = [r["file"] for r in listed.select("file").toLocalIterator()]
    keys = listed.select(raw.same_file(F.col("file")).alias("__file"), *KEYS, F.lit(True).alias("__listed"))
    rows = source.read(spark, files, located=True).join(keys, "__file", "left")
    lost = F.raise_error(F.concat(F.lit("no run lists "), F.col("__file"))).cast("timestamp")
    return rows.withColumn(KEYS[0], F.when(F.col("__listed"), F.col(KEYS[0])).otherwise(lost)).drop("__file", "__listed")


def load_run(spark: SparkSession, raw_root: str, bronze_path: str, contract: Contract, source: Source, loaded_at: str, run: str | None = None, start: str | None = None, end: str | None = None, validations: str | None = None, schema_path: str = "") -> dict:
    """Load one committed run (the newest of the window unless named) and return its validation stamp. validations: a table
    that gets the stamp, a row per run, once the rows are written; a run without one was never proven."""
    runs = coverage.newest_run(coverage.latest_committed(raw.committed_runs(spark, raw_root, start, end), run=run))
    chosen = runs.first()
    if chosen is None:
        raise ValueError("no committed run")
    frame = bronze_frame(run_rows(spark, runs, source), contract, source, loaded_at)
    n = tables.write_runs(frame, bronze_path)
    stamp = {"ok": True, "validated_at": loaded_at, "row_count": n, "wire_version": chosen["wire_version"], **{k: chosen[k] for k in KEYS}}
    stamp |= {"schema_path": schema_path, "schema_sha256": hashlib.sha256(json.dumps(contract.schema, sort_keys=True).encode()).hexdigest()}
    if validations is not None:
        tables.write_runs(spark.createDataFrame([stamp], VALIDATION), validations)
    return stamp


def plan_runs(spark: SparkSession, raw_root: str, contract: Contract, source: Source, loaded_at: str, **select) -> DataFrame:  # noqa: ANN003
    """Dry run: per raw run the rows, the bad ones, and up to 20 messages. Nothing is written."""
    runs = coverage.latest_committed(raw.committed_runs(spark, raw_root), **select)
    checked = bronze_frame(run_rows(spark, runs, source), contract, source, loaded_at, strict=False)
    bad = F.size("__errors") > 0
    per_run = checked.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad_rows"))
    messages = exploded_errors(checked, *KEYS).groupBy(*KEYS, "e").agg(F.count("*").alias("n"))
    top = messages.groupBy(*KEYS).agg(F.slice(F.array_sort(F.collect_list("e")), 1, 20).alias("errors"))
    return per_run.join(top, KEYS, "left").withColumn("ok", F.col("bad_rows") == 0)


def migrate(spark: SparkSession, raw_root: str, bronze_path: str, contract: Contract, source: Source, loaded_at: str, start: str | None = None, end: str | None = None, wire_version: int | None = None, recreate: bool = False, all_raw: bool = False, all_raw_runs: bool = False) -> int:
    """Rebuild bronze from raw in one job; the run stamp of a row is its manifest's. all_raw rebuilds everything. A table
    that is recreated is built beside the old one, which is replaced only by a complete new one."""
    if all_raw and (not recreate or start or end):
        raise ValueError("all raw needs a recreate and no window")
    runs = raw.of_version(raw.committed_runs(spark, raw_root, start, end), wire_version)
    runs = coverage.latest_committed(runs, every_run=all_raw_runs)
    frame = bronze_frame(run_rows(spark, runs, source), contract, source, loaded_at)
    if not recreate:
        return tables.write_runs(frame, bronze_path, single=False)
    staged = f"{bronze_path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    n = tables.write_runs(frame, staged, single=False)
    if n:
        paths.swap(spark, staged, bronze_path)
    else:
        paths.purge(spark, bronze_path)  # nothing landed: the table that is asked for is empty
    return n


def diagnose(spark: SparkSession, raw_root: str, bronze_path: str, contract: Contract, source: Source, start: str | None = None, end: str | None = None) -> DataFrame:
    """Findings (code, severity, runs) on the runs of raw and bronze. The newest run that is in raw alone is put through
    the contract; if it can't be read or a row fails, that is a finding of its own."""
    committed = raw.committed_runs(spark, raw_root, start, end)
    have = tables.list_runs(spark, bronze_path, start, end) if paths.exists(spark, bronze_path) else committed.limit(0)
    diff = coverage.diff_runs(coverage.run_keys(committed), have)
    newest = coverage.newest_only_raw(diff).first()
    invalid = False
    if newest is not None:
        same = reduce(lambda a, b: a & b, [F.date_trunc("second", k) == F.lit(newest[k]) for k in KEYS])
        try:
            checked = bronze_frame(run_rows(spark, committed.where(same), source), contract, source, "1970-01-01 00:00:00", strict=False)
            told = outcome(checked).first()
            invalid = told["coerce_errors"] + told["schema_errors"] > 0  # a run without rows breaks no rule
        except PySparkException:
            invalid = True
    return coverage.findings(diff, F.lit(invalid))


def prune(spark: SparkSession, bronze_path: str, keep: int, start: str | None = None, end: str | None = None, dry_run: bool = True) -> DataFrame:
    """Retention plan of a bronze table, applied unless dry; raw is never touched."""
    plan = coverage.retention(tables.list_runs(spark, bronze_path), keep, start, end)
    if not dry_run:
        removed = [r.asDict() for r in plan.where("action = 'remove'").collect()]  # a row per removed run
        if removed:
            tables.delete_runs(spark, bronze_path, spark.createDataFrame(removed))
    return plan


#: Columns of the validations table.
VALIDATION = ", ".join(f"{k} timestamp" for k in KEYS) + ", ok boolean, validated_at string, schema_path string, schema_sha256 string, row_count long, wire_version int"


__all__ = ["VALIDATION", "Source", "bronze_frame", "diagnose", "load_run", "migrate", "plan_runs", "prune", "run_rows", "timekeys"]
