"""Silver by micro-batches: each new set of bronze files is upserted; replayed batches change nothing.

A silver table lies in folders by a hash bucket of its keys, with a commit file per version (sources.commits). A batch reads
the buckets that its keys fall in, writes them anew beside the old ones, and becomes visible with its commit file, which
also has the number of the batch: a batch that is run again after a crash is either not there yet, or left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakejobs.jobs import silver as jobs
from lakejobs.sources import commits
from lakejobs.sources.commits import BUCKETS

#: Versions before the newest one that stay readable while a stream writes.
KEEP = 2


def read_silver(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the newest version of a table that upsert() or jobs.silver keeps."""
    return jobs.read_silver(spark, target)


def upsert(batch: DataFrame, target: str, keys: list[str], order: list[Column], buckets: int = BUCKETS, stream: str | None = None, batch_id: int | None = None, keep: int = 0) -> bool:
    """The latest row of each key over target and batch, in the buckets that the batch touches. The batch's rows are
    reduced to one per key first; null keys equal each other. A batch of a stream whose number isn't above the last one
    that was committed is left out. keep: earlier versions that stay readable. Returns whether there is a new version."""
    spark = batch.sparkSession
    live = commits.latest(spark, target)
    if stream is not None and live is not None and batch_id <= live.batches.get(stream, -1):
        return False
    done = {stream: batch_id} if stream is not None else {}
    return jobs.write(batch, target, keys, "latest", order, live=live, buckets=buckets, batches=done, keep=keep) is not None


def stream_silver(spark: SparkSession, bronze: str, schema: T.StructType, target: str, checkpoint: str, keys: list[str], order: list[Column], buckets: int = BUCKETS) -> StreamingQuery:
    """Everything available, then stop; the checkpoint remembers the files, the table the last batch of the checkpoint."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(bronze)
    write = lambda batch, n: upsert(batch, target, keys, order, buckets, checkpoint, n, KEEP)
    return rows.writeStream.foreachBatch(lambda batch, n: (write(batch, n), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
