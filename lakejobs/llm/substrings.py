"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Every byte that a string of LENGTH bytes covers which also starts earlier (in a document of smaller id, or earlier in
the same document) is removed. Suffixes are ordered only through LENGTH bytes, by most-significant-digit passes; groups
that are still equal then are exactly the repeated windows, and all but the first member of a group are removed.

The first digit splits the suffixes over the cluster. It is the window's anchor: of the window's SEED-byte pieces the
one of least hash (leftmost of equals). The digit is a function of the window's bytes alone, so equal windows fall
together, and neighbouring windows mostly share their anchor, so one record stands for a run of about 35 suffixes. Runs
whose anchor occurs once hold no repeated window and leave the sort. Runs that are equal as a whole are settled by
their first member. Only runs that share the anchor but differ are sorted further, suffix by suffix: by the offset of
the anchor, then by digits of DIGIT bytes, and the members of the last groups are compared byte by byte.

Equal runs of one task are merged before the shuffle, so a passage that a third of all documents hold is a record per
task. Anchors that one task holds in more than HOT different runs (the edges of such passages) are dealt out by their
whole run, and those with more than HOT_ANCHOR different runs in all window by window, so no task gets all of one anchor.

Exact copies of whole texts are settled first, by the SHA-256 of the text: a later copy of at least LENGTH bytes goes.

Defined cases: null text counts as empty; matches don't cross documents; among rows of one id, and of null ids (which
come last), the row number decides what is earlier; texts shorter than LENGTH stay; an empty table gives no rows; other
columns are ignored by removals() and kept, whatever their names, by deduplicate(), which replaces bytes of a cut character
by nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common

LENGTH = 100
SEED = 32
DIGIT = 25
HOT = 128
HOT_ANCHOR = 4000
#: Crowded anchors that are broadcast, 16 bytes each; more (over 4,000 times so many runs) meet their runs in a join that
#: adaptive execution splits.
MAX_CROWDED = 500_000
#: Buckets of a shuffle partition: a task sorts its rows by bucket (Spark spills) and holds one bucket at a time.
BUCKETS = 16
#: Bytes of a segment of one text; windows that begin in a segment belong to it.
SEGMENT = 1 << 20
#: Text behind the records that a task merges before it hands them on.
FLUSH_BYTES = 24 << 20
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)

_RUN = np.dtype([("anchor", "<u8"), ("run", "<u8"), ("id", "<i8"), ("row", "<i8"), ("at", "<i4"), ("back", "u1"), ("span", "u1")])
_WINDOW = np.dtype([("key", "<u8"), ("key2", "<u8"), ("id", "<i8"), ("row", "<i8"), ("start", "<i4")])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLY
    return x ^ (x >> np.uint64(29))


class _Hasher:
    """Hashes of substrings of a buffer, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, size: int):
        self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)

    def load(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.up):
            self.__init__(2 * len(raw))
        out = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((prefix[end] - prefix[begin]) * self.down[begin])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def runs(hasher: _Hasher, segments: list[tuple[int, int, bytes]], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in (owner, offset in its text, bytes) segments: owner, anchor hash, hash of the
    run's bytes, place of the anchor, first and last window start."""
    sizes = np.array([len(s) for _, _, s in segments], dtype=np.int64)
    raw = np.frombuffer(b"".join(s for _, _, s in segments), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    begins = np.cumsum(sizes) - sizes
    prefix = hasher.load(raw)
    places = np.arange(len(raw) - seed + 1, dtype=np.int64)
    low = np.uint64((1 << 23) - 1)
    hashes = hasher.at(prefix, places, places + seed)
    least = _window_min((hashes & ~low) | places.astype(np.uint64), length - seed + 1)
    segment = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= (begins + sizes)[segment]
    change = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (segment[1:] != segment[:-1])) & inside)
    if not len(change):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    # A run ends before the next run, or at the last window of its segment.
    of = segment[change]
    last = np.minimum(np.append(change[1:], len(least)) - 1, (begins + sizes - length)[of])
    anchor = (least[change] & low).astype(np.int64)
    shift = np.array([o for _, o, _ in segments], dtype=np.int64)[of] - begins[of]
    return np.array([w for w, _, _ in segments], dtype=np.int64)[of], hashes[anchor], hasher.at(prefix, change, last + length), anchor + shift, change + shift, last + shift


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts cut into overlapping segments, in lists of about SEGMENT bytes."""
    out, total = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), SEGMENT):
            part = t[at : at + SEGMENT + length - 1]
            out.append((i, at, part))
            total += len(part)
            if total >= SEGMENT:
                yield out
                out, total = [], 0
    if out:
        yield out


def _first_of_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first is the most significant), and where in it the first key or two change."""
    order = np.lexsort(keys[::-1])
    return order, np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys[:2]], axis=0)) if len(order) else np.zeros(0, dtype=bool)


def _spans(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each row."""
    if not len(rows):
        return rows, start, end
    order = np.lexsort((start, rows))
    rows, start, end = rows[order], start[order].astype(np.int64), end[order].astype(np.int64)
    new_row = np.append(True, rows[1:] != rows[:-1])
    offset = np.cumsum(new_row) * np.int64(1 << 40)  # rows far apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + offset)
    begin = np.append(True, start[1:] + offset[1:] > reach[:-1])
    firsts = np.flatnonzero(begin)
    lasts = np.append(firsts[1:], len(rows)) - 1
    return rows[firsts], start[firsts], reach[lasts] - offset[lasts]


def _packed(kind: int, records: np.ndarray, bucket: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(np.append(len(bucket) > 0, bucket[1:] != bucket[:-1]))
    return [(kind, int(bucket[a]), records[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(records)], strict=False)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, list[tuple[int, bytes]]]]:
    """Of packed rows sorted by bucket: batches of the spans among them, and the (kind, data) of one bucket at a time."""
    held: list[tuple[int, bytes]] = []
    last = None
    for batch in batches:
        kinds, buckets = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        through = np.flatnonzero(kinds == _SPAN)
        if len(through):
            yield batch.take(pa.array(through)), []
        data = batch.column(5)
        for i in np.flatnonzero(kinds != _SPAN):
            if held and buckets[i] != last:
                yield None, held
                held = []
            last = buckets[i]
            held.append((int(kinds[i]), data[int(i)].as_py()))
    if held:
        yield None, held


_PACKED = "kind int, bucket int, row long, start long, end long, data binary"
_RUNS, _HOT_RUNS, _MARKS, _SPAN, _WINDOWS, _TEXTS = range(6)


def _packed_batch(packed: list[tuple[int, int, bytes]], spans: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    n, m = len(packed), len(spans[0])
    none = np.zeros(n, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append([k for k, _, _ in packed], np.full(m, _SPAN)).astype(np.int32)), pa.array(np.append([b for _, b, _ in packed], spans[0] % 1024).astype(np.int32)),
            *[pa.array(np.append(none, s).astype(np.int64)) for s in spans], pa.array([d for _, _, d in packed] + [None] * m, pa.binary()),
        ],
        names=["kind", "bucket", "row", "start", "end", "data"],
    )


def _find_runs(docs: DataFrame, buckets: int, length: int, hot: int) -> DataFrame:
    """First pass: runs of each task, equal ones merged, dealt into buckets by their anchor; spans settled on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(2 * SEGMENT)
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            r = np.concatenate(held)
            held.clear()
            order, first = _first_of_groups(r["anchor"], r["run"], r["id"], r["row"], r["at"])
            r = r[order]
            late = r[~first]
            kept = r[first]
            begin = late["at"].astype(np.int64) - late["back"]
            new = np.append(True, kept["anchor"][1:] != kept["anchor"][:-1])
            count = np.diff(np.append(np.flatnonzero(new), len(kept)))
            many = np.repeat(count > hot, count)
            seen_twice = np.repeat(np.bincount(np.cumsum(np.append(True, r["anchor"][1:] != r["anchor"][:-1])) - 1) > 1, count)
            packed = _packed(_RUNS, kept[~many], (kept["anchor"][~many] % np.uint64(buckets)).astype(np.int64))
            packed += _packed(_HOT_RUNS, kept[many], (_mix(kept["anchor"][many] ^ kept["run"][many]) % np.uint64(buckets)).astype(np.int64))
            marks = kept["anchor"][new & many & seen_twice]
            packed += _packed(_MARKS, marks, (marks % np.uint64(buckets)).astype(np.int64))
            return _packed_batch(packed, _spans(late["row"], begin, begin + late["span"] + length))

        for batch in batches:
            texts = common.texts(batch, "text")
            ids, rows = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            for part in _segments(texts, length):
                owner, anchor, body, at, first, last = runs(hasher, part, length)
                r = np.zeros(len(owner), dtype=_RUN)
                r["anchor"], r["run"], r["id"], r["row"] = anchor, body, ids[owner], rows[owner]
                r["at"], r["back"], r["span"] = at, at - first, last - first
                held.append(r)
                size += sum(len(s) for _, _, s in part)
                if size > FLUSH_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    return docs.select("id", "row", "text").mapInArrow(run, _PACKED)


def _settle_runs(packed: DataFrame, length: int) -> DataFrame:
    """Second pass, per bucket: later equal runs become spans, the first of differing runs become candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, packed_rows in _by_bucket(batches):
            if part is not None:
                yield _candidates(np.zeros(0, dtype=_RUN), tuple(part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)))
            else:
                yield from settle(packed_rows)

    def settle(packed_rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {_RUNS: [], _HOT_RUNS: [], _MARKS: []}
        for kind, data in packed_rows:
            held[kind].append(data)
        marks = np.unique(np.frombuffer(b"".join(held[_MARKS]), dtype=np.uint64))
        for kind in (_RUNS, _HOT_RUNS):
            r = np.frombuffer(b"".join(held[kind]), dtype=_RUN)
            held[kind].clear()
            if not len(r):
                continue
            order, first = _first_of_groups(r["anchor"], r["run"], r["id"], r["row"], r["at"])
            r = r[order]
            late, kept = r[~first], r[first]
            begin = late["at"].astype(np.int64) - late["back"]
            if kind == _RUNS:
                new = np.append(True, kept["anchor"][1:] != kept["anchor"][:-1])
                count = np.diff(np.append(np.flatnonzero(new), len(kept)))
                kept = kept[np.repeat(count > 1, count) | np.isin(kept["anchor"], marks)]
            spans = _spans(late["row"], begin, begin + late["span"] + length)
            for i in range(0, max(len(kept), len(spans[0])), 50_000):
                yield _candidates(kept[i : i + 50_000], tuple(s[i : i + 50_000] for s in spans))

    return packed.mapInArrow(run, "row long, start long, end long, anchor long, at long")


def _candidates(kept: np.ndarray, spans: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    first = kept["at"].astype(np.int64) - kept["back"]
    n, m = len(kept), len(spans[0])
    mask = np.append(np.zeros(n, dtype=bool), np.ones(m, dtype=bool))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(kept["row"], spans[0]).astype(np.int64)), pa.array(np.append(first, spans[1]).astype(np.int64)), pa.array(np.append(first + kept["span"], spans[2]).astype(np.int64)),
            pa.array(np.append(kept["anchor"].view(np.int64) if n else kept["at"].astype(np.int64), np.zeros(m, dtype=np.int64)), mask=mask),
            pa.array(np.append(kept["at"], np.zeros(m)).astype(np.int64), mask=mask),
        ],
        names=["row", "start", "end", "anchor", "at"],
    )


_HEAD = np.dtype([("anchor", "<u8"), ("id", "<i8"), ("row", "<i8"), ("first", "<i4"), ("at", "<i4"), ("size", "<i4")])


def _cut_out(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Third pass: the bytes of the candidates (hot ones as windows), dealt into buckets again. docs: id, row, text, runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(2 * SEGMENT)
        none = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        for batch in batches:
            texts = common.texts(batch, "text")
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            heads: list[tuple] = []
            bodies: list[bytes] = []
            windows: list[np.ndarray] = []
            for i, (t, found) in enumerate(zip(texts, batch.column(3).to_pylist(), strict=True)):
                for x in found:
                    a, b = x["start"], x["end"] + length
                    if not x["hot"]:
                        heads.append((x["anchor"] & 0xFFFFFFFFFFFFFFFF, ids[i], rows[i], a, x["at"], b - a))
                        bodies.append(t[a:b])
                        continue
                    raw = np.frombuffer(t[a:b], dtype=np.uint8)
                    prefix, places = hasher.load(raw), np.arange(b - a - length + 1)
                    w = np.zeros(len(places), dtype=_WINDOW)
                    w["key"] = hasher.at(prefix, places, places + length)
                    w["key2"] = _mix(hasher.at(prefix, places, places + length // 2) + np.uint64(x["anchor"] & 0xFFFFFFFFFFFFFFFF))
                    w["id"], w["row"], w["start"] = ids[i], rows[i], places + a
                    windows.append(w)
            packed: list[tuple[int, int, bytes]] = []
            if heads:
                h = np.array(heads, dtype=_HEAD)
                bucket = (h["anchor"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    own = order[a:b]
                    packed.append((_TEXTS, int(bucket[own[0]]), np.uint32(b - a).tobytes() + h[own].tobytes() + b"".join(bodies[k] for k in own)))
            if windows:
                w = np.concatenate(windows)
                order, first = _first_of_groups(w["key"], w["key2"], w["id"], w["row"], w["start"])
                w = w[order]
                late, w = w[~first], w[first]
                packed += _packed(_WINDOWS, w, (w["key"] % np.uint64(buckets)).astype(np.int64))
                yield _packed_batch([], _spans(late["row"], late["start"], late["start"].astype(np.int64) + length))
            yield _packed_batch(packed, none)

    return docs.mapInArrow(run, _PACKED)


def radix_groups(raw: np.ndarray, starts: np.ndarray, keys: np.ndarray, hasher: _Hasher, length: int = LENGTH, digit: int = DIGIT) -> tuple[np.ndarray, np.ndarray]:
    """Windows of raw at starts that are equal to another of the same key: their numbers, and their group numbers.
    One pass per digit, most significant first; windows alone in their group leave after each pass."""
    prefix = hasher.load(raw)
    live, group = np.arange(len(starts)), keys.astype(np.uint64)
    for at in range(0, length, digit):
        value = hasher.at(prefix, starts[live] + at, starts[live] + min(at + digit, length))
        value = _mix(value ^ (group * _MULTIPLY))
        order = np.argsort(value, kind="stable")
        new = np.append(True, value[order][1:] != value[order][:-1]) if len(order) else np.zeros(0, dtype=bool)
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1 if len(number) else new
        live, group = live[order][several], number[several].astype(np.uint64)
    return live, group.astype(np.int64)


def _sort_windows(packed: DataFrame, length: int) -> DataFrame:
    """Fourth pass, per bucket: the radix sort of the windows that are left; later members of a group become spans."""

    def settle(group: np.ndarray, key2: np.ndarray, ids: np.ndarray, rows: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        order, first = _first_of_groups(group, key2, ids, rows, start)
        late = order[~first]
        return _packed_batch([], _spans(rows[late], start[late], start[late].astype(np.int64) + length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(2 * SEGMENT)
        for part, packed_rows in _by_bucket(batches):
            if part is not None:
                yield _packed_batch([], tuple(part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)))
            else:
                yield from sort(hasher, packed_rows)

    def sort(hasher: _Hasher, packed_rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        heads, bodies, windows = [], [], []
        for kind, data in packed_rows:
            if kind == _WINDOWS:
                windows.append(np.frombuffer(data, dtype=_WINDOW))
                continue
            n = int(np.frombuffer(data[:4], dtype=np.uint32)[0])
            heads.append(np.frombuffer(data[4 : 4 + n * _HEAD.itemsize], dtype=_HEAD))
            bodies.append(data[4 + n * _HEAD.itemsize :])
        if windows:
            w = np.concatenate(windows)
            yield settle(w["key"], w["key2"], w["id"], w["row"], w["start"])
        if not heads:
            return
        h, raw = np.concatenate(heads), np.frombuffer(b"".join(bodies), dtype=np.uint8)
        begins = np.cumsum(h["size"], dtype=np.int64) - h["size"]
        order = np.argsort(h["anchor"], kind="stable")
        h, begins = h[order], begins[order]
        firsts = np.flatnonzero(np.append(True, h["anchor"][1:] != h["anchor"][:-1]))
        stops = np.append(firsts[1:], len(h))
        a = 0
        while a < len(firsts):  # whole anchors, about a million bytes of runs at a time
            b = a + 1
            while b < len(firsts) and stops[b] - firsts[a] < 8000:
                b += 1
            own = slice(firsts[a], stops[b - 1])
            part, begin = h[own], begins[own]
            count = part["size"].astype(np.int64) - length + 1
            which = np.repeat(np.arange(len(part)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            low = np.cumsum(part["size"], dtype=np.int64) - part["size"]
            body = np.concatenate([raw[x : x + n] for x, n in zip(begin, part["size"], strict=True)])
            start = part["first"][which].astype(np.int64) + nth
            key = _mix(part["anchor"][which] + (part["at"][which] - start).astype(np.uint64))
            live, group = radix_groups(body, low[which] + nth, key, hasher, length)
            if len(live):
                places = (low[which] + nth)[live]
                head = np.append(True, group[1:] != group[:-1])
                same = places[np.flatnonzero(head)][np.cumsum(head) - 1]
                for c in range(0, length, 20):
                    columns = np.arange(c, min(c + 20, length))
                    if (body[places[:, None] + columns] != body[same[:, None] + columns]).any():
                        raise RuntimeError("two different windows share all digits")
                w = which[live]
                yield settle(group, np.zeros(len(live), dtype=np.int64), part["id"][w], part["row"][w], start[live])
            a = b

    return packed.mapInArrow(run, _PACKED)


def removals(docs: DataFrame, length: int = LENGTH, hot: int = HOT, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(row, spans array<struct<start, end>>): maximal removed byte runs of the rows that have any.

    docs: id long, row long (unique, the same on each read), text. Null ids are last.
    """
    if length <= SEED or length > 255:
        raise ValueError(f"the length must be over {SEED} and at most 255")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * BUCKETS
    docs = docs.select(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "row", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    keyed = docs.where(size >= length).select("id", "row", size.alias("size"), F.unhex(F.sha2("text", 256)).alias("sha"))
    first = keyed.groupBy("sha").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n"), F.min("size").alias("size"))
    repeated = common.saved(first.where("n > 1").select("sha", "first.row", "size"), "repeated-texts")
    copies = keyed.join(repeated.select("sha", F.col("row").alias("first")), "sha").where("row <> first").select("row", "size")
    copies = common.saved(copies, "copies")
    originals = docs.where(size >= length).join(copies.select("row"), "row", "left_anti").select("id", "row", "text")
    packed = _find_runs(originals, buckets, length, hot)
    settled = common.saved(_settle_runs(packed.repartition(parts, "bucket").sortWithinPartitions("bucket"), length), "runs")
    candidates = settled.where("anchor is not null")
    crowded = candidates.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_anchor).select("anchor", F.lit(True).alias("hot"))
    crowded = common.saved(crowded, "crowded")
    if crowded.count() <= MAX_CROWDED:  # the candidates aren't dealt by anchor then, so no task gets all of one
        crowded = F.broadcast(crowded)
    candidates = candidates.join(crowded, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    runs_of = candidates.groupBy("row").agg(F.collect_list(F.struct("start", "end", "anchor", "at", "hot")).alias("runs"))
    cut = _cut_out(docs.join(runs_of, "row").select("id", "row", "text", "runs"), buckets, length)
    spans = common.saved(_sort_windows(cut.repartition(parts, "bucket").sortWithinPartitions("bucket"), length).select("row", "start", "end"), "window-spans")
    every = settled.where("anchor is null").select("row", "start", "end").unionByName(spans).unionByName(copies.select("row", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    return every.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, done = [], 0
    for a, b in spans:
        out.append(text[done:a])
        done = b
    return b"".join([*out, text[done:]])


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without the repeated bytes; a text that ends up without a whole character at a cut loses its odd bytes."""
    plain, (id_column, text) = common.by_place(docs, id_column, text)
    base = common.saved(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    spans = removals(base.select(F.col(id_column).cast("long").alias("id"), "row", F.col(text).alias("text")), length)
    joined = base.join(spans, "row", "left")
    cut = F.pandas_udf(lambda t, s: _cut_series(t, s), "string")
    out = joined.withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(cut(F.col(text), F.col("spans"))))
    return out.select(*plain.columns).toDF(*docs.columns)


def _cut_series(texts, spans):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series([None if t is None else _kept(t.encode(), _merged(None if s is None else list(s))).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row. The numbered rows are written first, as another
    read of the scan may be split otherwise."""
    rows = common.saved(docs.select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")), "numbered")
    joined = rows.join(removals(rows, length), "row", "left").select("id", F.coalesce("text", F.lit("")).alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t, found in zip(common.texts(batch, "text"), batch.column(2).to_pylist(), strict=True):
                spans = _merged(found)
                for column, x in zip(out, (len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(t, spans)).hexdigest()), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"`{id_column}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_suffix_dedup: what the repeated windows of 100 bytes take from every document."""
    return report(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
