"""Helpers shared by the operators: scratch tables, hashing folds, Arrow batch slicing, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one numpy step works on at a time; a single longer text is a step of its own.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset: a temporary folder in local mode,
    else a folder in the warehouse, which all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _scratch.get(spark.sparkContext.applicationId)
    if found:
        return found
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-lakejobs-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    _scratch[spark.sparkContext.applicationId] = found
    return found


#: Scratch folders by application, where the setting names none.
_scratch: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> tuple[str, object, object]:
    """The application's folder of saved frames, with its file system and path."""
    folder = f"{scratch_dir(spark)}/lakejobs/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return folder, path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def saved_names(spark: SparkSession) -> set[str]:
    """The folders of the frames that saved() has written in this application."""
    _, fs, path = _own_folder(spark)
    return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()


def release(spark: SparkSession, before: set[str] = frozenset(), keep: str = "/") -> None:
    """Delete the frames that saved() has written in this application, but for those named before and those whose label
    is to keep. Call it when what stems from them is written; what is left goes when the application ends."""
    folder, fs, _ = _own_folder(spark)
    for name in saved_names(spark) - before:
        if not name.startswith(f"{keep}-"):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet into the shared scratch folder and read it back. This cuts the lineage at a
    place that survives lost executors, and pins the row order decisions of whatever made the frame."""
    conf, clean = df.sparkSession.conf, "spark.sql.shuffleDependency.fileCleanup.enabled"
    folder, fs, root = _own_folder(df.sparkSession)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    before = conf.get(clean, None)
    conf.set(clean, "true")  # the shuffle files of this write aren't needed after it
    try:
        df.write.parquet(path)
        fs.deleteOnExit(root)
    finally:
        conf.unset(clean) if before is None else conf.set(clean, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_place(df: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named by their place, c0, c1, ..., so that no name that an operator adds is among them, and
    the new names of the columns named."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = {c.lower(): n for c, n in zip(df.columns, names, strict=True)}
    return df.toDF(*names), [at[n.lower()] for n in named]


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id folds as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most limit bytes each, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def smallest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of smallest hash of a key (ties by the row). A count and a bound on the hash come first, so that about
    1.5 n rows take part in the sort, however many tasks read the table."""
    rows = df.count()
    share = 1.5 * n / rows + 100 / rows if rows else 1.0
    if share < 1:
        df = df.where(F.xxhash64(key) <= int(-(1 << 63) + share * (1 << 64)))
    return df.orderBy(F.xxhash64(key), *df.columns).limit(n)


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, v) undirected edges of non-null longs -> (node, component), component the smallest node reached.

    Alternating large-star and small-star passes: each is a grouped minimum, which Spark combines before the
    shuffle, and a join. Every pass is written to the shared scratch folder, so nothing is collected but the
    two checksums that tell convergence. Nodes without edges are not returned; self loops are ignored.
    """
    spark = edges.sparkSession
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")

    def checksum(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = checksum(now)
    for _ in range(rounds):
        if not last[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("u").alias("b"), "m")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("b").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        if (this := checksum(now)) == last:
            break
        last = this
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots) if last[0] else spark.createDataFrame([], "node long, component long")
