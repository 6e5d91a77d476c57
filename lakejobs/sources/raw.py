"""Raw landings: run manifests, CSV and JSON page artifacts."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakejobs.functions import timekeys
from lakejobs.operators.coverage import KEYS, version_or_one
from lakejobs.sources import paths

#: Files up to so many bytes are hashed as one value; of larger ones so many bytes are read at a time.
WHOLE, CHUNK = 256 << 20, 8 << 20
#: Levels of folders below a root on which interval folders are looked for.
_LEVELS = 6
#: Blocks of at least so many bytes are never packed with other files.
_ALONE = 64 << 20

ARTIFACT = "struct<path:string,origin:string,sha256:string,bytes:string,format:string,content_encoding:string,format_check:string>"
MANIFEST = f"source string, interval_start string, interval_end string, extract_run_datetime string, wire_version string, lake_layout string, artifacts array<{ARTIFACT}>"
_KEY_PATTERN = "/__interval_start_datetime=([^/]+)/__interval_end_datetime=([^/]+)/__extract_run_datetime=([^/]+)/"


def interval_folders(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> list[str] | None:
    """The interval folders below a root whose start lies in the window, found by listing names level by level down to
    them; nothing below a folder outside of the window is listed. None if there are none to tell by."""
    level = [root.rstrip("/")]
    for _ in range(_LEVELS):
        below = [f"{folder}/{name}" for folder in level for name in paths.children(spark, folder)]
        own = [f for f in below if f.rsplit("/", 1)[1].startswith(f"{KEYS[0]}=")]
        if own:
            names = spark.createDataFrame([(f, f.rsplit("=", 1)[1]) for f in own], "folder string, key string")
            key = timekeys.from_key(F.coalesce(F.try_url_decode("key"), "key"))
            return sorted(r["folder"] for r in names.where(timekeys.in_window(key, start, end) & key.isNotNull()).select("folder").collect())
        level = below
    return None


def committed_runs(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per committed run below a raw root: the run keys, its folder and its manifest. A run is committed if its
    meta/manifest.json is a JSON object; temporary files never count. A window lists the folders of its intervals only."""
    chosen = interval_folders(spark, root, start, end) if start or end else None
    wanted = [root] if chosen is None else chosen
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "manifest.json", "wholetext": "true"}
    if wanted:
        text = spark.read.options(**options).text(wanted).select("value", F.col("_metadata.file_path").alias("file"))
    else:
        text = spark.createDataFrame([], "value string, file string")
    rows = text.where(F.col("file").rlike("/meta/manifest\\.json$") & F.trim("value").startswith("{")).withColumn("file", file_path("file"))
    rows = rows.select(F.from_json("value", MANIFEST + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("m"), "file").where("m is not null and m._corrupt is null")
    decoded = F.coalesce(F.try_url_decode("file"), "file")
    key = [timekeys.from_key(F.regexp_extract(decoded, _KEY_PATTERN, i)) for i in (1, 2, 3)]
    stamp = F.coalesce(timekeys.instant(F.col("m.extract_run_datetime")), key[2])
    out = rows.select(key[0].alias(KEYS[0]), key[1].alias(KEYS[1]), stamp.alias(KEYS[2]), F.regexp_extract("file", "^(.*)/meta/manifest\\.json$", 1).alias("folder"), "m.source", version_or_one(F.col("m.wire_version")).alias("wire_version"), version_or_one(F.col("m.lake_layout")).alias("lake_layout"), "m.artifacts")
    return out.where(timekeys.in_window(F.col(KEYS[0]), start, end)).where(F.col(KEYS[0]).isNotNull())


def of_version(runs: DataFrame, version: int | None) -> DataFrame:
    return runs if version is None else runs.where(F.col("wire_version") == version)


def artifacts(runs: DataFrame) -> DataFrame:
    """One row per artifact with the run's keys; bytes that are no number are null."""
    a = runs.select(*KEYS, "folder", F.explode("artifacts").alias("a"))
    return a.select(*KEYS, F.concat("folder", F.lit("/"), F.regexp_replace("a.path", "^/", "")).alias("file"), "a.sha256", F.expr("try_cast(a.bytes AS BIGINT)").alias("bytes"), "a.format", "a.content_encoding")


def artifact_bytes(runs: DataFrame) -> DataFrame:
    return artifacts(runs).groupBy(*KEYS).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("artifacts"))


def integrity(spark: SparkSession, listed: DataFrame, root: str, whole: int = WHOLE) -> DataFrame:
    """Artifacts with what is found: (file, sha256, bytes, found_sha256, found_bytes, ok). Files are hashed where they are
    read: up to whole bytes as one value, larger ones as streams, a file a task, of which a task holds CHUNK bytes (their store
    has to be one that Arrow opens: local, HDFS, S3, GCS)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = files.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("found_sha256"), F.col("length").alias("found_bytes"))
    large = files.where(F.col("length") > whole).select("path", "length").repartition(_file_tasks(spark), "path")
    found = small.unionByName(large.mapInArrow(_streamed, "path string, found_sha256 string, found_bytes long"))
    found = found.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "found_sha256", "found_bytes")
    want = listed.withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    j = want.join(found, "file", "left")
    return j.withColumn("ok", F.coalesce((F.col("sha256") == F.col("found_sha256")) & (F.col("bytes") == F.col("found_bytes")), F.lit(False)))


def _file_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 and length of each file, read in chunks."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, place = pafs.FileSystem.from_uri(path if "://" in path else "file://" + re.sub("^file:/*", "/", path))
            digest, n = hashlib.sha256(), 0
            with fs.open_input_stream(place) as f:
                while chunk := f.read(CHUNK):
                    digest.update(chunk)
                    n += len(chunk)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()]), pa.array([n])], names=["path", "found_sha256", "found_bytes"])


def file_path(column: str) -> Column:
    """The path of a file of _metadata.file_path, which is told as a URI: percent escapes are decoded, plus signs stay."""
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def same_file(path: Column) -> Column:
    """A file's path in one form, for joins."""
    return F.regexp_replace(path, "^file:/+", "/")


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, head) of rows (value, file, start, length) of text files, in order: the first record of each file, which may
    go on over line ends in quotes. The rest of a large block isn't read: such a block has its task for itself."""
    held: dict[str, str] = {}
    done: set[str] = set()
    for batch in batches:
        values, names, starts, lengths = (batch.column(i) for i in range(4))
        files, heads, alone = [], [], False
        at = np.flatnonzero(np.append(True, np.array(names.to_pylist()[1:], dtype=object) != np.array(names.to_pylist()[:-1], dtype=object))) if batch.num_rows else []
        for a, b in zip(at, [*at[1:], batch.num_rows], strict=False):
            file = names[a].as_py()
            alone = lengths[a].as_py() >= _ALONE
            if starts[a].as_py() or file in done:
                continue
            for i in range(a, b):
                text = values[i].as_py()
                held[file] = f"{held[file]}\n{text}" if file in held else text
                if held[file].count('"') % 2 == 0:
                    done.add(file), files.append(file), heads.append(held.pop(file))
                    break
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(heads, pa.string())], names=["file", "head"])
        if alone and not held:
            return


def headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each different header, the first record of a file, parsed as CSV. One job finds them; files without a
    line have none."""
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_block_length")]
    heads = spark.read.text(files).select("value", *meta).mapInArrow(_first_records, "file string, head string")
    out: dict[tuple[str, ...], list[str]] = {}
    for r in heads.groupBy("head").agg(F.collect_list(file_path("file")).alias("files")).collect():
        names = next(csv.reader(io.StringIO(r["head"].removeprefix("\ufeff").removesuffix("\r"))), [])
        out.setdefault(tuple(n.strip() for n in names), []).extend(r["files"])
    return out


def read_csv(spark: SparkSession, files: list[str], located: bool = False) -> DataFrame:
    """CSV artifacts as text columns and __filename (located: and __file, the path): one read per different header, then a union by name. Quoted line ends
    are part of values, short rows are filled with null, repeated header rows are dropped. Without files or lines there are no
    columns of rows, and no rows."""
    parts = []
    for names, own in sorted(headers(spark, files).items()) if files else ():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', enforceSchema=True, mode="PERMISSIVE").csv(own)
        parts.append(drop_header_rows(df).withColumn("__filename", F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)))
        if located:
            parts[-1] = parts[-1].withColumn("__file", same_file(file_path("_metadata.file_path")))
    if not parts:
        return spark.createDataFrame([], "__filename string" + ", __file string" * located)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_header_rows(df: DataFrame) -> DataFrame:
    """df without rows that repeat the header in every cell."""
    same = reduce(lambda a, b: a & b, [F.trim(F.col("`" + c.replace("`", "``") + "`")).eqNullSafe(F.lit(c.strip())) for c in df.columns if not c.startswith("__")])
    return df.where(~same)


def _dig(document: Column, path: str) -> Column:
    """The array at a dotted path of a variant, or the document itself if it is one and the path isn't there."""
    found = F.try_variant_get(document, "$." + path, "array<variant>") if path else F.lit(None).cast("array<variant>")
    return F.coalesce(found, F.try_variant_get(document, "$", "array<variant>"))


def page_records(pages: DataFrame, path: str, text: str = "value", keep: list[str] = ()) -> DataFrame:
    """(keep columns, record): the JSON objects at a path of page texts, as JSON text; items that are no objects are left
    out, a page without such an array is an error."""
    v = pages.select(*keep, F.parse_json(text).alias("__v")).withColumn("__items", _dig(F.col("__v"), path))
    stop = F.raise_error(F.lit(f"a page has no array at {path!r}")).cast("array<variant>")
    rows = v.select(*keep, F.explode(F.coalesce("__items", stop)).alias("__x"))
    return rows.where(F.schema_of_variant("__x").startswith("OBJECT")).select(*keep, F.to_json("__x").alias("record"))


def read_pages(spark: SparkSession, files: list[str] | str, path: str, located: bool = False) -> DataFrame:
    """JSON page artifacts: (record, __filename); located: and __file, the path."""
    if not files:
        return spark.createDataFrame([], "__filename string" + ", __file string" * located + ", record string")
    pages = spark.read.text(files, wholetext=True).select("value", F.col("_metadata.file_name").alias("__filename"), same_file(file_path("_metadata.file_path")).alias("__file"))
    return page_records(pages, path, keep=["__filename", *(["__file"] if located else [])])


def with_page_key(pages: DataFrame, path: str, key: str, fallback: str, text: str = "value") -> DataFrame:
    """page_records() with subject_key: the page's own key if that is a string, else the configured one."""
    v = F.parse_json(text)
    own = F.when(F.schema_of_variant(F.variant_get(v, f"$.{key}", "variant")) == "STRING", F.variant_get(v, f"$.{key}", "string"))
    marked = pages.withColumn("subject_key", F.coalesce(own, F.lit(fallback)))
    return page_records(marked, path, text, [c for c in marked.columns if c != text])


def nested_pages(records: DataFrame, path: str, page: str = "page", record: str = "record") -> DataFrame:
    """The inverse: records (JSON text) of each page under a dotted path, as (page, value)."""
    head = "".join(f'{{"{p}":' for p in path.split(".")) if path else ""
    tail = "}" * len(path.split(".")) if path else ""
    return records.groupBy(page).agg(F.concat(F.lit(head + "["), F.concat_ws(",", F.array_sort(F.collect_list(record))), F.lit("]" + tail)).alias("value"))


def yearly_files(listing: DataFrame, part: str, start: str, end: str, name: str = "name") -> DataFrame:
    """Of a file listing, per year that [start, end) touches, the greatest *.csv.gz name with the part and _dYYYY_."""
    year = F.regexp_extract(name, r"_d(\d{4})_", 1).try_cast("int")
    last = F.year(F.lit(end).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))
    rows = listing.where(F.col(name).endswith(".csv.gz") & F.col(name).contains(part)).withColumn("year", year)
    return rows.where(F.col("year").between(F.year(F.lit(start).cast("timestamp")), last)).groupBy("year").agg(F.max(name).alias(name))


def read_receipts(spark: SparkSession, root: str, since: str | None = None, until: str | None = None, status: str | None = None, command: str | None = None) -> DataFrame:
    """Receipt objects below root/runs, by day folder (dt=...); unreadable ones are left out. The days prune folders."""
    if status not in (None, "ok", "error") or command not in (None, "extract", "load"):
        raise ValueError("status is ok or error, command is extract or load")
    names = ["receipt_version", "attempt_id", "pipeline", "command", "interval_start", "interval_end", "extract_run_datetime", "wire_version", "status", "started_at", "finished_at", "duration_ms", "owner", "destination", "artifacts", "raw_bytes", "rows", "schema_sha256", "error_code", "error_class", "error_message"]
    schema = ", ".join(f"{n} string" for n in names) + ", _corrupt string, dt date"
    base = root.rstrip("/") + "/runs"
    rows = spark.read.option("basePath", base).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").schema(schema).json(base + "/dt=*")
    a, b = timekeys.attempt_window(since, until)
    rows = rows.where((F.col("dt") >= F.lit(a)) & (F.col("dt") < F.lit(b))).where("_corrupt is null")
    for c, v in (("status", status), ("command", command)):
        rows = rows.where(F.col(c) == v) if v else rows
    return rows.drop("_corrupt")


def latest_by_interval(runs: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*KEYS[:2]).orderBy(F.desc(KEYS[2])))
    return runs.withColumn("__place", place).where("__place = 1").drop("__place")


def manifest_row(**values: Any) -> dict[str, Any]:
    """A manifest as landed; for tests and examples."""
    return {"wire_version": 1, "lake_layout": 1, "artifacts": []} | values
