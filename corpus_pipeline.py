"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, tokens; each stage is an operator.

Stages map (spark, documents, folder of the tables) to a frame; each frame is written as Parquet and read again as the
next stage's documents. Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common, decontaminate, pieces, quality, secrets, simhash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones among those that come in."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id."""
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked and the number of characters as it is then."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, and their number, in place of columns of these names."""
    plain, (text,) = common.by_place(docs, "text")
    out = pieces.encode(plain, pieces.PieceModel.load(), text, into="ids")
    kept = [F.col(c).alias(n) for c, n in zip(plain.columns, docs.columns, strict=True) if n not in ("n_tokens", "ids")]
    return out.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", encoded),
]

#: Classifier, fingerprints and piece model are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. When a stage's documents are written, all that this run wrote before them goes."""
    docs, before = common.table(spark, sf_dir, "documents"), common.saved_names(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.saved(docs, f"stage-{name}")
            common.release(spark, before, keep=f"stage-{name}")
    return docs
