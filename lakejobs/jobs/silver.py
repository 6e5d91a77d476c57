"""Silver tables as jobs that write: full builds and increments, by key buckets, every change one commit.

The target lies by a hash of the key (sources.commits). An increment takes the staged rows above the watermark of the
table's commit file, so nothing of the target is read for it; then it reads and writes only the buckets that its keys fall
in. Appending reads none of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakejobs.operators.silver import latest_run, replaced, stamped
from lakejobs.sources import commits
from lakejobs.sources.commits import BUCKET, BUCKETS, Commit

STRATEGIES = ("delete+insert", "merge", "append")
#: Folders of a bucket from which on an append brings them together.
COMPACT = 16


@dataclass
class Built:
    version: int
    rows: int
    buckets: int


def read_silver(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the newest version."""
    commit = commits.latest(spark, target)
    df = commits.read(spark, target, commit) if commit else None
    if df is None:
        raise FileNotFoundError(f"{target} has no rows that are committed")
    return df


def write(batch: DataFrame, target: str, keys: list[str], strategy: str, order: list[Column], live: Commit | None, buckets: int = BUCKETS, watermark: str | None = None, batches: dict[str, int] | None = None, keep: int = 0, replace: bool = False) -> Built | None:
    """Commit a batch on top of a version; None if it has no rows and the table needs no new version.

    The batch's rows become one per key first (append keeps them as they are). latest: per key the first row by the order,
    over the table's and the batch's; delete+insert and merge: the batch's row in place of the table's; append: beside it.
    replace: the batch is all that the table has from now on.
    """
    spark = batch.sparkSession
    number, version = (live.buckets, live.version + 1) if live else (buckets, 1)
    fresh = batch if strategy == "append" else latest_run(batch, keys, order)
    fresh = commits.bucketed(fresh, keys, number)
    old = live.live if live and not replace else {}
    rewritten: list[int] = []
    if old and strategy == "append":
        rewritten = [b for b, own in old.items() if len(own) >= COMPACT]
    elif old:
        rewritten = [r[BUCKET] for r in fresh.select(BUCKET).distinct().collect() if r[BUCKET] in old]  # at most a row per bucket
    out = fresh
    if rewritten:
        have = commits.bucketed(commits.read(spark, target, live, rewritten), keys, number)
        if strategy == "latest":
            out = latest_run(have.unionByName(fresh, allowMissingColumns=True), keys, order)
        elif strategy == "append":
            out = have.unionByName(fresh, allowMissingColumns=True)
        else:
            out = replaced(have, fresh, keys)
    seen, stats = Observation(f"silver_{uuid.uuid4().hex}"), [F.count(F.lit(1)).alias("n")]
    if watermark:
        stats.append(F.max(F.unix_micros(F.col(watermark).cast("timestamp"))).alias("high"))
    staged = commits.stage(out.observe(seen, *stats), target, version)
    found = seen.get
    if not staged and not replace and not (live and batches):
        return None
    kept = {b: own for b, own in old.items() if b not in rewritten}
    new = {b: [*kept.get(b, []), f] for b, f in staged.items()}
    highs = [h for h in (found.get("high"), live.watermark if live else None) if h is not None]
    commit = Commit(version, number, kept | new, (live.batches if live else {}) | (batches or {}), max(highs, default=None))
    commits.publish(spark, target, commit)
    commits.clean(spark, target, keep)
    return Built(version, found["n"], len(staged))


def build(staged: DataFrame, target: str, keys: list[str], strategy: str = "delete+insert", watermark: str = "__extract_run_datetime", lookback: str | None = None, order: list[Column] | None = None, full_refresh: bool = False, buckets: int = BUCKETS, keep: int = 2) -> Built | None:
    """One build of a silver model from its staged rows: all of them the first time and on a full refresh, else those above
    the table's watermark, or not below it less the lookback. Rows get the two stamps of a silver model. None if nothing is new."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    live = commits.latest(staged.sparkSession, target)
    rows = staged
    if live is not None and live.watermark is not None and not full_refresh:
        high, at = F.timestamp_micros(F.lit(live.watermark)), F.col(watermark)
        rows = staged.where(at > high) if lookback is None else staged.where(at >= high - F.expr(f"INTERVAL {lookback}"))
    order = order or [F.col(watermark).desc_nulls_last()]
    # Appends are reduced to one row per key within the slice, like the others, but stand beside what is there.
    slice_ = stamped(latest_run(rows, keys, order))
    return write(slice_, target, keys, strategy, order, live, buckets, watermark, keep=keep, replace=full_refresh)
