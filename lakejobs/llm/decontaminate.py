"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows against all document words.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. A benchmark item gives its
windows of 13 consecutive words; a shorter item, if it has words at all, is one window. Document words inside any
occurrence of a window are hit. The scan is one narrow pass over the documents: words are numbered by the benchmark
vocabulary, only stretches of known words are hashed, and each hash hit is verified word by word.

The window set is broadcast only up to MAX_WORDS words and MAX_BYTES bytes of item text, both counted first. A larger
benchmark is cut into stretches of items that overlap by a window less one word, so that a long item is no exception,
and the stretches are dealt into blocks below those bounds (the sizes of the blocks are counted too). The documents are
then scanned once per block, one block is held at a time, and the hits are merged per document.

Defined cases: null and empty texts (documents or items) have no words, so no hits and no windows. Null item ids
count as items but add nothing to the list of ids. Repeated items with one id count once; repeated documents are
rows of their own. An empty benchmark leaves all documents clean. Extra columns of any name are kept by decontaminate(),
and by hits() but for those named like one that it adds, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common

N = 13
#: Words and bytes of item text behind one broadcast set. A word costs at most a window (13 numbers of 4 bytes, key, owner:
#: 68 bytes) and an entry of the vocabulary (about 130 bytes and the word), so a set is below 500,000 * 200 + 16 MB = 116 MB.
MAX_WORDS, MAX_BYTES = 500_000, 16 << 20
#: Window starts of a document that are looked up at a time.
STARTS = 1 << 16

_ASCII_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _ASCII_WORD else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class WindowSet:
    """Windows of some benchmark items, by their length: sorted hashes, the words' numbers, and the items of each."""

    def __init__(self, items: Iterable[tuple[int | None, bytes]], n: int = N):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        place: dict[int | None, int] = {}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], dtype=np.int32)
            if not len(numbers):
                continue
            at = place.setdefault(item_id, len(self.ids))
            if at == len(self.ids):
                self.ids.append(item_id)
            length = min(n, len(numbers))
            found.setdefault(length, []).append((np.lib.stride_tricks.sliding_window_view(numbers, length), at))
        #: By length: sorted keys, the windows' word numbers, and the items of each window (from one offset to the next).
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, parts in found.items():
            rows = np.concatenate([w for w, _ in parts])
            owner = np.repeat(np.array([at for _, at in parts], dtype=np.int32), [len(w) for w, _ in parts])
            keys = self._hash(rows)
            order = np.lexsort((owner, keys))
            keys, rows, owner = keys[order], rows[order], owner[order]
            same = (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1]).all(axis=1)
            first, fresh = np.append(True, ~same), np.append(True, ~same | (owner[1:] != owner[:-1]))
            offsets = np.append(np.cumsum(fresh)[first] - 1, fresh.sum())
            self.by_length[length] = (keys[first], rows[first], offsets, owner[fresh])

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        key = np.zeros(len(rows), dtype=np.uint64)
        for column in rows.T:
            key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit stretches of words (start, end), numbers of the items with occurring windows."""
        numbers = np.fromiter(map(self.vocabulary.get, found := words(text), repeat(-1)), dtype=np.int32, count=len(found))
        unknown = np.zeros(len(numbers) + 1, dtype=np.int32)
        np.cumsum(numbers < 0, out=unknown[1:])
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for length, (keys, rows, offsets, owners) in self.by_length.items():
            if len(numbers) < length:
                continue
            every = np.flatnonzero(unknown[length:] == unknown[:-length])
            hit: set[int] = set()
            for c in range(0, len(every), STARTS):
                starts = every[c : c + STARTS]
                got = numbers[starts[:, None] + np.arange(length)]
                hashes = self._hash(got)
                at = np.searchsorted(keys, hashes)
                for i in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == hashes):
                    k = at[i]
                    while k < len(keys) and keys[k] == hashes[i]:  # equal hashes of unequal windows lie side by side
                        if (rows[k] == got[i]).all():
                            spans.append((int(starts[i]), int(starts[i]) + length))
                            hit.add(int(k))
                        k += 1
            for k in hit:
                items.update(owners[offsets[k] : offsets[k + 1]].tolist())
        return len(found), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_ADDED = "__n_words long, __spans array<struct<start:int,end:int>>, __items array<long>, __n_items long"
_NAMES = ["__n_words", "__spans", "__items", "__n_items"]


def _scan(docs: DataFrame, shared: Broadcast, text: str, only_hits: bool = False) -> DataFrame:
    """docs and what the scan with a broadcast window set finds; only_hits: without the text and rows without hits."""
    fields = [f for f in docs.schema if f.name not in _NAMES and not (only_hits and f.name == text)]
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.scan(t) for t in common.texts(batch, text)]
            if only_hits:
                hit = [i for i, x in enumerate(found) if x[1]]
                batch, found = batch.take(pa.array(hit, pa.int64())), [found[i] for i in hit]
            new = [
                pa.array([n for n, _, _ in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans, _ in found], pa.list_(kind)),
                pa.array([[x for i in sorted(items) if (x := own.ids[i]) is not None] for _, _, items in found], pa.list_(pa.int64())), pa.array([len(items) for _, _, items in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(f.name)) for f in fields], *new], names=[*[f.name for f in fields], *_NAMES])

    return docs.mapInArrow(run, ", ".join([*[f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields], _ADDED]))


def _stretches(benchmark: DataFrame, n: int, size: int) -> DataFrame:
    """(item_id, words, n_words, n_bytes): the items' words in stretches of at most about size words, each with the n - 1
    words that follow it, so that every window of an item lies in a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), common.texts(batch, "text"), strict=True):
                found = words(text)
                cut = [found[i : i + size + n - 1] for i in range(0, max(len(found) - n + 1, 1), size)] if found else []
                joined = [b" ".join(c) for c in cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(cut), pa.int64()), pa.array(joined, pa.binary()), pa.array([len(c) for c in cut], pa.int64()), pa.array([len(j) for j in joined], pa.int64())],
                    names=["item_id", "words", "n_words", "n_bytes"],
                )

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id long, words binary, n_words long, n_bytes long")


def _blocks(benchmark: DataFrame, n: int, max_words: int, max_bytes: int) -> Iterator[WindowSet]:
    """Window sets of the benchmark's parts, each below the bounds (unless a single stretch isn't: one very long word)."""
    parts = common.saved(_stretches(benchmark, n, max(n, max_words // 16)), "stretches")
    sums = parts.agg(F.sum("n_words").alias("w"), F.sum("n_bytes").alias("b"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(sums["w"] or 0) // max_words), -(-(sums["b"] or 0) // max_bytes))
    numbers = [0]
    while blocks > 1:
        dealt = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
        sizes = dealt.groupBy("block").agg(F.sum("n_words").alias("w"), F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()  # a row per block
        numbers = sorted(r["block"] for r in sizes)
        if blocks > 4 * sums["n"] or all(r["n"] == 1 or r["w"] <= max_words and r["b"] <= max_bytes for r in sizes):
            break
        blocks *= 2
    for i in numbers:
        own = parts if blocks == 1 else dealt.where(F.col("block") == i)
        yield WindowSet(((r["item_id"], bytes(r["words"])) for r in own.select("item_id", "words").collect()), n)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES, text: str = "text") -> DataFrame:
    """docs with columns __n_words, __spans (hit word stretches), __items (ids of the items hit) and __n_items added."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    benchmark = benchmark.where(F.length("text") > 0)
    send = docs.sparkSession.sparkContext.broadcast
    if (benchmark.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) <= min(max_bytes, max_words):  # a word is a byte at least
        return _scan(docs, send(WindowSet(((r["item_id"], r["text"].encode()) for r in benchmark.collect()), n)), text)
    sets = _blocks(benchmark, n, max_words, max_bytes)
    first, second = next(sets), next(sets, None)
    if second is None:
        return _scan(docs, send(first), text)
    # Each block gives its own hits by row; they are united, and the words are counted by a scan for nothing.
    plain, (body,) = common.by_place(docs, text)
    base = common.saved(plain.withColumn("row", F.monotonically_increasing_id()), "documents")
    found = None
    for one in chain((first, second), sets):
        shared = send(one)
        own = common.saved(_scan(base.select("row", F.col(body).alias("text")), shared, "text", only_hits=True), "hits")
        shared.destroy()
        found = own if found is None else found.unionByName(own)
    united = found.groupBy("row").agg(
        F.flatten(F.collect_list("__spans")).alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("all_items"), F.max(F.col("__n_items") - F.size("__items")).alias("none")
    )
    counted_words = _scan(base.withColumnRenamed("row", "row_"), send(WindowSet(())), body).drop(*_NAMES[1:])
    joined = counted_words.join(united, F.col("row_") == F.col("row"), "left")
    spans = F.coalesce(F.pandas_udf(_union, "array<struct<start:int,end:int>>")(F.coalesce("all_spans", F.array())), F.array())
    items = F.coalesce("all_items", F.array().cast("array<long>"))
    kept = [F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns, strict=True) if name not in _NAMES]
    return joined.select(*kept, "__n_words", spans.alias("__spans"), items.alias("__items"), (F.size(items) + F.coalesce("none", F.lit(0))).cast("long").alias("__n_items"))


def _union(spans: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in own])] for own in spans])


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, percent: int = 5, text: str = "text") -> DataFrame:
    """hits() with __n_hit (hit words) and __contaminated (any hit, and at least percent of 100 words)."""
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = hits(docs, benchmark, n, text=text).withColumn("__n_hit", n_hit)
    return out.withColumn("__contaminated", (F.col("__n_hit") > 0) & (F.col("__n_hit") * 100 >= F.col("__n_words") * percent))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = N, percent: int = 5) -> DataFrame:
    """The documents without what the benchmark shares: mode "document" drops contaminated documents, mode "span"
    keeps every document and cuts the hit words (with what stands between them) out of its text."""
    plain, (text,) = common.by_place(docs, "text")
    found = contaminated(plain, benchmark, n, percent, text)
    if mode == "document":
        return found.where(~F.col("__contaminated")).select(*plain.columns).toDF(*docs.columns)
    if mode != "span":
        raise ValueError(f"unknown mode {mode!r}")
    cut = F.when(F.size("__spans") > 0, F.pandas_udf(_cut, "string")(F.col(text), F.col("__spans"))).otherwise(F.col(text))
    return found.withColumn(text, cut).select(*plain.columns).toDF(*docs.columns)


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_words(t, [(s["start"], s["end"]) for s in own]) if t is not None else None for t, own in zip(text, spans, strict=True)])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    mapped = raw.translate(_TO_WORDS)
    places, at = [], 0
    for word in mapped.split():
        at = mapped.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : places[a][0]])
        done = places[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_decontamination: one row per document, by the 5 per cent rule over all its words."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, common.table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.transform("__items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.col("__n_items").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), F.col("__contaminated").alias("contaminated"),
    )


#: DuckDB SQL of query().
ORACLE_SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_words AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
doc_windows AS (
    SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
found AS (SELECT r, d.n, i, item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.win = b.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM found)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
