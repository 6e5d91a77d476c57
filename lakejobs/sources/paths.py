"""Folders by the file system of their URI: existence, listing of partitions, guarded deletes and swaps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name for a table that goes when the application ends: below spark.checkpoint.dir, or where that is
    unset in a temporary folder in local mode, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = "file://" + tempfile.mkdtemp(prefix="spark-lakejobs-") if local else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/lakejobs-{label}-{uuid.uuid4().hex}"
    fs, p = _at(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none if there is no folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that isn't there yet."""
    fs, p = _at(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename_new(spark: SparkSession, path: str, new: str) -> bool:
    """Give a file a name that isn't taken; whether it got it."""
    fs, p = _at(spark, path)
    _, place = _at(spark, new)
    return not fs.exists(place) and bool(fs.rename(p, place))


def delete(spark: SparkSession, path: str, inside: str) -> bool:
    """Delete a folder that lies inside a data set; anything else is refused."""
    base, own = inside.rstrip("/") + "/", path.rstrip("/")
    if not own.startswith(base) or ".." in own.split("/"):
        raise ValueError(f"{path} is not inside {inside}")
    fs, p = _at(spark, own)
    return bool(fs.delete(p, True)) if fs.exists(p) else False


def purge(spark: SparkSession, path: str) -> None:
    """Remove a whole data set; no error if there is none."""
    if len([x for x in path.split("://")[-1].split("/") if x]) < 2:
        raise ValueError(f"{path} is too near the root to be a data set")
    fs, p = _at(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def _aside(spark: SparkSession, target: str) -> list[str]:
    """Folders that swaps have put aside for a target, by name."""
    parent, name = target.rstrip("/").rsplit("/", 1)
    return [f"{parent}/{x}" for x in children(spark, parent) if x.startswith(f"{name}__old_")]


def recover(spark: SparkSession, target: str) -> None:
    """Undo or finish a swap that was cut short: a missing target gets back what was put aside, else that is deleted."""
    for old in reversed(_aside(spark, target)):
        fs, p = _at(spark, old)
        if exists(spark, target) or not fs.rename(p, _at(spark, target)[1]):
            fs.delete(p, True)


def swap(spark: SparkSession, staged: str, target: str) -> None:
    """Put a complete staged folder in the target's place. The old one is put aside by a rename and deleted last, so that
    at every moment one of them is there in whole; recover() mends a swap that was cut short."""
    recover(spark, target)
    fs, new = _at(spark, staged)
    _, place = _at(spark, target)
    _, old = _at(spark, f"{target.rstrip('/')}__old_{uuid.uuid4().hex}")
    if not fs.exists(new):
        raise OSError(f"{staged} could not be renamed to {target}: it isn't there")
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"{target} could not be put aside")
    try:
        done = fs.rename(new, place)
    finally:
        if had and not fs.exists(place):
            fs.rename(old, place)
    if not done:
        raise OSError(f"{staged} could not be renamed to {target}")
    if had:
        fs.delete(old, True)
