"""Periodic runs of words, by tiles of each period octave.

Words are `[^\\x20\\x09-\\x0D]+` of the text, numbered from 0. A run is a stretch of consecutive words with smallest period
q (words q apart are the same) and a length of at least max(LEAST, 2 * q) that no neighbouring word extends.

Octave k has the periods from 2^k to 2^(k+1) - 1. Boundaries stand 2^k words apart, so that a run of such a period has
one within its first q words. For boundary b and period q, Z-functions give how far words agree with those q later, ahead
of b (the Z-function of what follows b) and behind it (the Z-function of what precedes b, backwards, over what precedes
b + q), up to 2^k words either way: a fragment [b - g, b + f) of starts i with word i = word i + q. A fragment that
reaches that limit goes on in those of the neighbouring boundaries; one that doesn't is whole, and kept only if it is long
enough. Small octaves extend all their pairs together, word by word; in large ones the pairs that agree over a few words
tell the boundaries whose Z-functions are worked out, each in time linear in its window, however periodic it is.

Documents of up to TILE words are a tile of all their octaves. Longer ones are exploded: for every three octaves, tiles
that grow with the period and overlap by what the periods need, which are dealt out over the tasks, solved apart and give
fragments in the document's own numbers. Fragments are shuffled by document and period and stitched where they touch; of
stretches found under several periods (multiples) the smallest is the run's. At last each document meets its runs, which
are at most as many as its words.

Defined cases: a null text is empty; a text without words has no runs, and the SHA-256 of the empty text twice; a null id
counts as the empty text where the id is hashed; repeated rows and ids are rows of their own; an empty table gives no
rows; columns of any name are kept by periodic_runs() and collapse().
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakejobs.llm import common

#: Least length of a run.
LEAST = 12
#: Words of a document that is one tile; tiles of the first octaves of longer ones are as long. A power of two, 2^13.
TILE = 1 << 13
#: Octaves of the first tiles, and of each further kind of tile.
FIRST, NEXT = 10, 3
#: Octaves below this extend all pairs together; from it on, pairs that agree over PROBE words lead to Z-functions.
SMALL, PROBE = 6, 8
#: Text of short documents that is solved together.
STEP_BYTES = 1 << 20


def z_function(s: list[int]) -> list[int]:
    """How many words from each place on agree with those from the start on; at 0 the length."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _small(x: np.ndarray, b: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that agree ahead of and behind each boundary, up to most, all pairs together."""
    out = []
    for ahead in (True, False):
        n, live = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
        for step in range(most):
            i = b[live] + step if ahead else b[live] - 1 - step
            live = live[x[i] == x[i + q[live]]]
            if not len(live):
                break
            n[live] += 1
        out.append(n)
    return out[0], out[1]


def _large(x: np.ndarray, b: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one boundary and all periods size .. 2 * size - 1, by Z-functions."""
    ahead = z_function(x[b : b + 3 * size].tolist())[size : 2 * size]
    back = x[b - size : b][::-1].tolist() + [-1] + x[b - size : b + 2 * size - 1][::-1].tolist()
    behind = z_function(back)[size + 1 : 2 * size + 1][::-1]
    return np.minimum(ahead, size), np.minimum(behind, size)


def fragments(x: np.ndarray, first: np.ndarray, last: np.ndarray, octaves: range) -> list[np.ndarray]:
    """Rows (q, low, high) of fragments around the boundaries of some octaves in places of x.

    x: words as numbers; equal ones in different documents are different. A boundary counts if first <= it < last for its
    place. Places before and after x agree with nothing.
    """
    out = []
    for k in octaves:
        size = 1 << k
        pad = 4 * size
        n = -(-len(x) // size) * size
        padded = np.concatenate([np.arange(-2, -2 - pad, -1), x, np.arange(-2 - pad, -2 - pad - (n - len(x)) - pad, -1)])
        bounds = np.arange(0, n + size, size)
        place = np.minimum(bounds, len(x) - 1)
        bounds = bounds[(first[place] <= bounds) & (bounds < last[place])]
        if not len(bounds):
            continue
        rows = padded[pad + bounds[:, None] + size + np.arange(size)] if len(bounds) * 2 < n // size else padded[pad + size :][: n + size].reshape(-1, size)[bounds // size]
        same = rows == padded[pad + bounds][:, None]
        before = np.concatenate([padded[pad + bounds + size - 1][:, None], rows[:, :-1]], axis=1) == padded[pad + bounds - 1][:, None]
        at, r = np.nonzero(same | before)
        b, q = bounds[at], r + size
        if k < SMALL:
            f, g = _small(padded, b + pad, q, size)
        else:
            f, g = _small(padded, b + pad, q, PROBE)
            long = np.unique(b[(f >= PROBE) | (g >= PROBE)])
            parts = [_large(padded, int(i) + pad, size) for i in long]
            b, q = np.repeat(long, size), np.tile(np.arange(size, 2 * size), len(long))
            f, g = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for j in (0, 1))
        keep = (f + g >= np.maximum(q, LEAST - q)) | (f == size) | (g == size)
        out.append(np.stack([q[keep], b[keep] - g[keep], b[keep] + f[keep]], axis=1))
    return out


def stitched(owner: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fragments (q, low, high) of owners, joined where they touch."""
    order = np.lexsort((rows[:, 1], rows[:, 0], owner))
    owner, rows = owner[order], rows[order]
    if not len(rows):
        return owner, rows
    # A group's ends are shifted beyond those of the groups before it, so that one running maximum serves all.
    group = np.cumsum(np.append(0, (owner[1:] != owner[:-1]) | (rows[1:, 0] != rows[:-1, 0])))
    shift = group * (int(rows[:, 1:].max() - min(rows[:, 1:].min(), 0)) + 1)
    reach = np.maximum.accumulate(rows[:, 2] + shift)
    new = np.append(True, (rows[1:, 1] + shift[1:] > reach[:-1]) | (group[1:] != group[:-1]))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(rows)) - 1
    return owner[starts], np.stack([rows[starts, 0], rows[starts, 1], reach[ends] - shift[ends]], axis=1)


def _numbers(words: list[bytes]) -> np.ndarray:
    """Each word as the place of its first occurrence among the different ones."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def solve_short(docs: list[np.ndarray]) -> list[list[dict]]:
    """The fragments of whole documents, solved together."""
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes) - sizes
    found: list[list[dict]] = [[] for _ in docs]
    if not sizes.sum():
        return found
    x = np.concatenate([d + (i << 32) for i, d in enumerate(docs)])
    owner = np.repeat(np.arange(len(docs)), sizes)
    first, last = starts[owner], (starts + sizes)[owner]
    parts = []
    for k in range(int(sizes.max()).bit_length() - 1):
        # A document needs two periods: shorter ones have no boundaries in this octave.
        parts += fragments(x, np.where(sizes[owner] >= 2 << k, first, len(x)), last, range(k, k + 1))
    rows = np.concatenate([np.zeros((0, 3), dtype=np.int64), *parts])
    rows = rows[rows[:, 2] > rows[:, 1]]
    own, rows = stitched(owner[rows[:, 1]], rows)
    keep = rows[:, 2] - rows[:, 1] >= np.maximum(rows[:, 0], LEAST - rows[:, 0])
    for o, (q, low, high) in zip(own[keep].tolist(), (rows[keep] - np.array([0, 1, 1]) * starts[own[keep]][:, None]).tolist(), strict=True):
        found[o].append({"q": q, "low": low, "high": high})
    return found


def tiles(n: int) -> Iterator[tuple[range, int, int, int, int]]:
    """Tiles of a document of n words: octaves, first and last word of the tile, and of its own boundaries in it."""
    low, high = 0, FIRST
    while 2 << low <= n:
        octaves = range(low, min(high, n.bit_length() - 1))
        widest = 1 << (high - 1)
        stride = 16 * widest
        for at in range(0, n, stride):
            # One boundary more at the end, then room for its period and what agrees beyond it; and before the first.
            a, z = max(0, at - widest), min(n, at + stride + 4 * widest)
            yield octaves, a, z, at - a, min(at + stride + widest, n) - a
        low, high = high, high + NEXT


def solve_tile(words: np.ndarray, octaves: range, start: int, first: int, last: int) -> list[tuple[int, int, int]]:
    """The fragments of a tile, in numbers of the document: stitched, and whole or to be stitched further."""
    n = len(words)
    rows = np.concatenate([np.zeros((0, 3), dtype=np.int64), *fragments(words, np.full(n, first), np.full(n, last), octaves)])
    _, rows = stitched(np.zeros(len(rows), dtype=np.int64), rows)
    return (rows + np.array([0, start, start])).tolist()


def repeated_tail(words: list, hashed: int) -> list:
    """The words that the query's contract puts in place of a tenth of the documents' own: from word a on, p of them over
    and over, a and p taken from the id's hash."""
    n, g = len(words), hashed // 10
    if hashed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_FRAGMENT = "array<struct<q: int, low: int, high: int>>"


def _split(plain: DataFrame, text: str, id_column: str | None, change: Callable[[list, int], list] | None) -> DataFrame:
    """A row for each document (kept columns, row, n, words if there are fragments or tiles, plain_sha, fragments), and
    further rows for the tiles of long ones (row, tile). Saved."""
    fields = [f for f in plain.schema if f.name != text]
    numbered = plain.select(F.monotonically_increasing_id().alias("row"), "*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.schema.names, common.texts(batch, text)
            ids = batch.column(names.index(id_column)).to_pylist() if id_column else []
            for lo, hi in common.steps([len(t) for t in texts], STEP_BYTES):
                docs, out = [], []
                for i in range(lo, hi):
                    words = texts[i].split()
                    if change:
                        words = change(words, zlib.crc32(b"" if ids[i] is None else str(ids[i]).encode()))
                    docs.append(words)
                found = solve_short([_numbers(d) if len(d) <= TILE else np.zeros(0, dtype=np.int64) for d in docs])
                for i, d, f in zip(range(lo, hi), docs, found, strict=True):
                    joined = b" ".join(d)
                    keep = bool(f) or len(d) > TILE
                    out.append((i, len(d), joined if keep else None, None if keep else hashlib.sha256(joined).hexdigest(), f or None, None))
                    if len(d) > TILE:
                        x = _numbers(d)
                        out += [(i, None, None, None, None, {"low": o.start, "high": o.stop, "start": a, "first": s, "last": e, "words": x[a:z].astype(np.int32).tobytes()}) for o, a, z, s, e in tiles(len(d))]
                take = pa.array([r[0] for r in out], pa.int64())
                own = [batch.column(names.index(f.name)).take(take) for f in fields]
                kinds = [pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([(c, pa.int32()) for c in ("q", "low", "high")])), pa.struct([*[(c, pa.int32()) for c in ("low", "high", "start", "first", "last")], ("words", pa.binary())])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index("row")).take(take), *own, *[pa.array([r[j] for r in out], t) for j, t in enumerate(kinds, 1)]],
                    names=["row", *[f.name for f in fields], "n", "words", "plain_sha", "fragments", "tile"],
                )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    tile = "struct<low: int, high: int, start: int, first: int, last: int, words: binary>"
    return common.saved(numbered.mapInArrow(run, ", ".join(["row long", *kept, "n long", "words binary", "plain_sha string", f"fragments {_FRAGMENT}", f"tile {tile}"])), "split")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.array(solve_tile(np.frombuffer(t["words"], dtype=np.int32).astype(np.int64), range(t["low"], t["high"]), t["start"], t["first"], t["last"]), dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), *[pa.array(found[:, j]) for j in range(3)]], names=["row", "q", "low", "high"])


def _runs(split: DataFrame) -> DataFrame:
    """(row, runs): the runs of each document that has some, by start, then period."""
    short = split.where("fragments is not null").select("row", F.explode("fragments").alias("f")).select("row", *[F.col(f"f.{c}").cast("long").alias(c) for c in ("q", "low", "high")])
    dealt = split.where("tile is not null").select("row", "tile").repartition("row", "tile.low", "tile.start")
    every = short.unionByName(dealt.mapInArrow(_solved, "row long, q long, low long, high long"))
    by = Window.partitionBy("row", "q").orderBy("low", "high")
    reach = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = every.withColumn("new", (reach.isNull() | (F.col("low") > reach)).cast("int"))
    joined = marked.withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "q", "part").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    whole = joined.where(F.col("high") - F.col("start") >= F.greatest("q", LEAST - F.col("q"))).select("row", "start", (F.col("high") + F.col("q") - F.col("start")).alias("length"), "q")
    smallest = whole.groupBy("row", "start", "length").agg(F.min("q").alias("period"))
    return smallest.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def kept_words(n: int, runs: list[dict]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, dtype=np.int64)
    for r in runs:
        change[r["start"] + r["period"]] += 1
        change[r["start"] + r["length"]] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", id_column: str | None = None, change: Callable[[list, int], list] | None = None) -> DataFrame:
    """docs without the text, with __n (words), __runs (array of start, period, length), __collapsed (the words that stay
    when every run keeps its first period only, joined by a space; null where all stay) and __sha (its SHA-256).
    change: what stands in for a document's words, given them and the crc32 of its id."""
    names = [text, *([id_column] if id_column else [])]
    plain, found = common.by_place(docs, *names)
    split = _split(plain, found[0], found[1] if id_column else None, change)
    kept = [c for c in plain.columns if c != found[0]]
    rows = split.where("tile is null").select("row", *kept, "n", "words", "plain_sha")
    joined = rows.join(_runs(split), "row", "left").select(*kept, "n", "words", "plain_sha", "runs")
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            collapsed, sha = [], []
            for words, plain_sha, runs in zip(*[batch.column(at + j).to_pylist() for j in (1, 2, 3)], strict=True):
                if words is not None and runs:
                    own = words.split(b" ")
                    words = b" ".join([w for w, k in zip(own, kept_words(len(own), runs).tolist(), strict=True) if k])
                    collapsed.append(words.decode("utf-8", "replace"))
                else:
                    collapsed.append(None)
                sha.append(plain_sha if words is None else hashlib.sha256(words).hexdigest())
            own = [batch.column(j) for j in (*range(at + 1), at + 3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(collapsed, pa.string()), pa.array(sha, pa.string())], names=[*kept, "n", "runs", "collapsed", "sha"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in kept]
    out = joined.mapInArrow(run, ", ".join([*fields, "n long", "runs array<struct<start: long, period: long, length: long>>", "collapsed string", "sha string"]))
    return out.toDF(*[c for c in docs.columns if c.lower() != text.lower()], "__n", "__runs", "__collapsed", "__sha")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every run of words cut to its first period, in the texts that have runs; other texts stay as they are."""
    plain, (t,) = common.by_place(docs, text)
    found = periodic_runs(plain.withColumn("own", F.col(t)), t)
    new = F.coalesce("__collapsed", "own").alias(t)
    return found.select(*[new if c == t else F.col(c) for c in plain.columns]).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_periodic_runs: every document's runs, its longest one and its text without what repeats."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs, "text", "doc_id", repeated_tail)
    runs = F.coalesce("__runs", F.array().cast("array<struct<start: long, period: long, length: long>>"))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), F.col("__sha").alias("collapsed_sha256"))
    length = -F.col("best.less")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * length / F.col("best.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), "collapsed_sha256",
    )
