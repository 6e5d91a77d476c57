"""Approximate nearest neighbours by NN-descent, largest inner product.

Equal vectors are one node. Vectors get one more coordinate, which makes all norms equal, so that the neighbours by inner
product are neighbours in space. The first graph comes from leaves: TREES times all nodes are dealt to the nearest of some
random nodes, and the nodes of a leaf are compared with each other; if nodes end up with under DEGREE neighbours (lone ones,
small far groups), all are compared once more in random groups, so that none stays apart. Then each iteration joins the graph
with itself: a node's list (the best of its neighbours, and nodes that have it as neighbour) is joined with the vectors, the
list's members are compared with each other, and every node keeps its DEGREE best. Two members are compared once: only pairs
with a member whose edge is new since it was last on a list, and lists without new edges don't meet the vectors at all. It
ends when few neighbours still change, however many iterations that takes.
Nodes that few lists hold are added to the lists of their own neighbours, so that searches find them.

Queries search greedily, near ones of them in blocks: from its queries' own nodes, their neighbours and a random group, a block
expands the best nodes of each query's beam that it hasn't expanded, and all its queries meet what it reaches. Each query keeps
its best beam_width(n), round by round, until no query has an open node in its beam. A block meets a node once at most; on
vectors without structure it may reach a large part of the nodes. What may be among the k best of the last beam, by the bound
of the rounding, is scored in double precision on the original vectors, with all rows of equal vectors. A query whose beam has
under k rows is scored against all nodes.

Nodes are numbered, and rows of edges, lists and vectors travel packed: a binary value for each bucket of nodes, which Spark
shuffles by the bucket and a task takes apart, a bucket at a time. Vectors are a norm in 32 bits and a unit vector in 16 bits a
component, near enough to tell a beam's members from others, whatever the norms. No task holds the table, and nothing that grows
with the rows is broadcast but the random nodes of the leaves (TREES of LEAF nodes) and blocks. Lists are bounded by
construction (WIDTH of either kind), which is the method's own sampling. Parameters are for hard, high-dimensional data:
the recall at 20 is measured against brute force in the tests and the README.

Defined cases: null ids, null, empty or zero vectors, and vectors with null or non-finite components take no part, nor do
those of another length than the most frequent one; an id of several different vectors takes part with each; repeated
rows of one id and vector count once; fewer candidates than k give all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakejobs.llm import common

DEGREE, WIDTH, OFFER = 64, 40, 16
#: Nodes of a leaf on average, how often all nodes are dealt to leaves, and what a node is offered in one of several leaves.
LEAF, TREES, LEAF_OFFER = 1500, 8, 32
BEAM, BEAM_STEP, BEAM_NODES, EXPAND = 96, 32, 65_536, 32
#: Nodes of a bucket on average, and buckets at most; a task holds one at a time.
BUCKET_NODES, BUCKETS = 1000, 4096
#: Nodes of a random group, on average: for nodes without enough neighbours, and for the start of a search.
PARTNERS, ENTRIES = 128, 1024
#: Nodes that fewer lists than this hold are offered to searches by their own neighbours too.
SELDOM = 20
#: Leaves over this size are cut into blocks, along a random direction; tasks get ranges of it, not whole leaves.
BLOCK = 4000
#: Queries that search together, at most and at least (fewer only if there are no more).
ABREAST, FEWEST = 1024, 128
#: How far the difference of two scores by vectors in 16 bits may be from the exact one, at norms of one.
ROUNDING = 0.0025
#: Bytes of packed rows that a task gathers before it hands them on.
GATHER = 32 << 20

#: How an edge stands: met on a list already, in the graph but not on a list yet, offered.
_MET, _NEW, _OFFERED = range(3)
#: Kinds of packed rows that meet in a bucket, in the order in which a task gets them.
_GRAPH, _VECTOR, _WORST, _BACK, _WANTED, _OFFERS, _QUERY, _BEAM, _DONE, _SENT, _OPEN, _REACHED, _MEMBER = range(13)
_PACKED = "bucket int, kind int, data binary"
_EDGE = np.dtype([("a", "<u4"), ("b", "<u4"), ("s", "<f4"), ("f", "u1")])
_PAIR = np.dtype([("a", "<u4"), ("b", "<u4"), ("f", "u1")])
_WORST_TYPE = np.dtype([("a", "<u4"), ("t", "<f4")])
_HALVES = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32)


def vectors(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, x array<float>) of the rows that take part."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    ok = df.where(F.col(id_column).isNotNull() & x.isNotNull()).where(F.size(x) > 0).where(finite & F.exists(x, lambda c: c != 0))
    ok = ok.select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: c.cast("double") + F.lit(0.0)).alias("x"))
    size = ok.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return ok.where(F.size("x") == (size["n"] if size else 0))


def _packed_vectors(x: np.ndarray) -> pa.Array:
    """Vectors as binary: the norm in 32 bits, then the unit vector in 16 bits a component."""
    norm = np.sqrt((x * x).sum(axis=1))
    out = np.zeros(len(x), dtype=[("n", "<f4"), ("u", "<f2", (x.shape[1],))])
    out["n"], out["u"] = norm, x / np.maximum(norm, np.finfo(float).tiny)[:, None]
    return pa.array([r.tobytes() for r in out], pa.binary())


def _matrix(column: pa.Array, rows: int, last: bool = True) -> np.ndarray:
    """Packed vectors as float32, with the coordinate that makes all norms one unless last is false."""
    if not rows:
        return np.zeros((0, 1), dtype=np.float32)
    raw = b"".join(column.to_pylist())
    return _decoded(np.frombuffer(raw, dtype=f"V{len(raw) // rows}"), last)


def _decoded(v: np.ndarray, last: bool = True) -> np.ndarray:
    """The same of an array of packed vectors."""
    raw = np.ascontiguousarray(v).view(np.uint16).reshape(len(v), -1)
    size = raw.shape[1] - 2
    out = np.empty((len(v), size + last), dtype=np.float32)
    unit = np.take(_HALVES, raw[:, 2:])
    norm = np.ascontiguousarray(raw[:, :2]).view(np.float32)[:, 0]
    out[:, :size] = unit * (norm / np.maximum(np.sqrt(np.einsum("ij,ij->i", unit, unit)), np.finfo(np.float32).tiny))[:, None]
    if last:
        out[:, size] = np.sqrt(np.maximum(1 - norm**2, 0))
    return out


def beam_width(n: int) -> int:
    """Nodes of a beam: BEAM, and BEAM_STEP more for each doubling beyond BEAM_NODES, as recall falls with the nodes."""
    return BEAM + BEAM_STEP * max(0, ceil(log2(max(n, 1) / BEAM_NODES)))


def _groups(batches: Iterator[pa.RecordBatch], key: list[int], limit: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows with equal key columns, from batches sorted by them; runs over the limit in parts."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in key], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(keys[a])
            if held and (now != last or limit and sum(h.num_rows for h in held) >= limit):
                yield pa.Table.from_batches(held)
                held = []
            last = now
            for c in range(a, b, limit or b - a):
                if held and limit and sum(h.num_rows for h in held) >= limit:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(c, min(limit or b - a, b - c)))
    if held:
        yield pa.Table.from_batches(held)


def _buckets_of(n: int) -> int:
    """Buckets of n nodes: a power of two, so that it divides BUCKETS."""
    return min(BUCKETS, 1 << max(0, int(log2(max(n, 1) / BUCKET_NODES)) if n > BUCKET_NODES else 0))


def _parts(spark: SparkSession, n: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(_buckets_of(n) / 8))


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """32 random bits of each number."""
    x = (x.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)


def _rows(x: np.ndarray, kind: int, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a structured array as one binary value per bucket."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    x, bucket = x[order], bucket[order].astype(np.int32)
    raw, size, stops = x.view(np.uint8), x.dtype.itemsize, _cuts(bucket)
    for i in range(0, len(stops) - 1, 1024):
        own = stops[i : i + 1025]
        offsets = pa.py_buffer(((own - own[0]) * size).astype(np.int32))
        data = pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, offsets, pa.py_buffer(raw[own[0] * size : own[-1] * size])])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[own[:-1]]), pa.array(np.full(len(own) - 1, kind, dtype=np.int32)), data], names=["bucket", "kind", "data"])


def _gathered(found: Iterator[np.ndarray], kind: int, buckets: int, key: str = "a") -> Iterator[pa.RecordBatch]:
    """Structured arrays, dealt to the buckets of their key, in steps of about GATHER bytes."""
    held: list[np.ndarray] = []
    for x in found:
        for i in range(0, len(x), step := max(1, GATHER // x.dtype.itemsize)):
            held.append(x[i : i + step])
            if sum(h.nbytes for h in held) >= GATHER:
                x_ = np.concatenate(held)
                yield from _rows(x_, kind, x_[key] % np.uint32(buckets))
                held = []
    if held:
        x_ = np.concatenate(held)
        yield from _rows(x_, kind, x_[key] % np.uint32(buckets))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bucket, kind, bytes) of packed rows."""
    for batch in batches:
        if batch.num_rows:
            for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                yield bucket, kind, np.frombuffer(data.as_buffer(), dtype=np.uint8)


def _meeting(batches: Iterator[pa.RecordBatch], **kinds: tuple[int, np.dtype]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """What meets in each bucket, from packed rows sorted by bucket: (bucket, arrays by name)."""

    def joined(held: list[tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
        out = {}
        for name, (kind, dtype) in kinds.items():
            of = [x for k, x in held if k == kind]
            out[name] = (np.concatenate(of) if len(of) > 1 else of[0] if of else np.zeros(0, dtype=np.uint8)).view(dtype)
        return out

    last, held = None, []
    for bucket, kind, data in _values(batches):
        if bucket != last and held:
            yield last, joined(held)
            held = []
        last = bucket
        held.append((kind, data))
    if held:
        yield last, joined(held)


def _met(parts: int, *frames: DataFrame) -> DataFrame:
    """Packed rows, brought together by their bucket."""
    every = frames[0]
    for f in frames[1:]:
        every = every.union(f)
    return every.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")


def _first(a: np.ndarray) -> np.ndarray:
    """Whether each of sorted keys is the first of its kind."""
    out = np.ones(len(a), dtype=bool)
    out[1:] = a[1:] != a[:-1]
    return out


def _cuts(a: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.append(np.flatnonzero(_first(a)), len(a))


def _place(a: np.ndarray) -> np.ndarray:
    """The place of each row among rows of the same key, from sorted keys."""
    cuts = _cuts(a)
    return np.arange(len(a)) - np.repeat(cuts[:-1], np.diff(cuts))


def _falling(s: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits whose order is that of falling scores."""
    bits = np.ascontiguousarray(s, dtype=np.float32).view(np.uint32)
    return np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF)).astype(np.uint64)


def _best(edges: np.ndarray, k: int, buckets: int) -> np.ndarray:
    """The k best different neighbours of each node of a bucket; an edge that is offered again stands as it stood."""
    edges = edges[edges["a"] != edges["b"]]
    own = (edges["a"] // np.uint32(buckets)).astype(np.uint64)
    key = own << np.uint64(34) | edges["b"].astype(np.uint64) << np.uint64(2) | edges["f"]
    order = np.argsort(key)
    pair = key[order] >> np.uint64(2)
    order = order[_first(pair)]
    edges, own = edges[order], own[order]
    order = np.argsort(own << np.uint64(32) | _falling(edges["s"]), kind="stable")
    edges = edges[order]
    return edges[_place(edges["a"]) < k]


def _packed_nodes(nodes: DataFrame, buckets: int) -> DataFrame:
    """Nodes and their vectors by bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                if batch.num_rows:
                    raw = b"".join(batch.column(1).to_pylist())
                    out = np.empty(batch.num_rows, dtype=[("a", "<u4"), ("v", f"V{len(raw) // batch.num_rows}")])
                    out["a"], out["v"] = batch.column(0).to_numpy(), np.frombuffer(raw, dtype=out.dtype["v"])
                    yield out

        return _gathered(found(), _VECTOR, buckets)

    return nodes.select("node", "v").mapInArrow(pack, _PACKED)


def _near(ids: np.ndarray, x: np.ndarray, offer: int) -> Iterator[np.ndarray]:
    """Members of a group with each other: the best of them for each, as edges."""
    if len(ids) < 2:
        return
    k = min(offer, len(ids) - 1)
    for i in range(0, len(ids), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(s, len(ids) - k, axis=1)[:, len(ids) - k :]
        e = np.full(top.size, _OFFERED, dtype=_EDGE)
        e["a"], e["b"], e["s"] = np.repeat(ids[i : i + 512], k), ids[top.ravel()], np.take_along_axis(s, top, axis=1).ravel()
        yield e


def _merge(old: DataFrame | None, offers: DataFrame, parts: int, buckets: int) -> DataFrame:
    """The DEGREE best of the graph so far and what is offered, as packed rows: edges by node and falling score, with the number
    of those that came now (fresh) and of nodes with DEGREE of them (full); edges turned round; the worst scores of full nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(rows: Iterator[pa.RecordBatch], fresh: int = 0, full: int = 0) -> Iterator[pa.RecordBatch]:
            for row in rows:
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array(np.full(row.num_rows, x, dtype=np.int64)) for x in (fresh, full))], names=[*row.schema.names, "fresh", "full"])

        turned: list[np.ndarray] = []
        for bucket, got in _meeting(batches, old=(_GRAPH, _EDGE), offers=(_OFFERS, _EDGE)):
            before = got["old"].copy()
            before["f"] = np.where((before["f"] != _MET) & (_place(before["a"]) >= WIDTH), _NEW, _MET)
            e = _best(np.concatenate([before, got["offers"]]), DEGREE, buckets)
            yield from counted(_rows(e, _GRAPH, np.full(len(e), bucket)), np.count_nonzero(e["f"] == _OFFERED), np.count_nonzero(np.diff(_cuts(e["a"])) >= DEGREE))
            last = e[_place(e["a"]) == DEGREE - 1]
            worst, back = np.empty(len(last), dtype=_WORST_TYPE), np.empty(len(e), dtype=_PAIR)
            worst["a"], worst["t"] = last["a"], last["s"]
            yield from counted(_rows(worst, _WORST, np.full(len(worst), bucket)))
            back["a"], back["b"], back["f"] = e["b"], e["a"], e["f"] != _MET
            turned.append(back)
            if sum(x.nbytes for x in turned) >= GATHER:
                yield from counted(_gathered(iter(turned), _BACK, buckets))
                turned = []
        yield from counted(_gathered(iter(turned), _BACK, buckets))

    every = [offers] if old is None else [offers, _of(old, _GRAPH)]
    return _met(parts, *every).mapInArrow(run, f"{_PACKED}, fresh long, full long")


def _of(frame: DataFrame, *kinds: int) -> DataFrame:
    return frame.where(F.col("kind").isin(*kinds)).select("bucket", "kind", "data")


def _pivots(nodes: DataFrame, n: int, leaves: int) -> np.ndarray:
    """(TREES, leaves, size): random nodes."""
    found = common.smallest_hashes(nodes.select("node", "v"), "node", TREES * leaves).collect()
    found = [found[i % len(found)] for i in range(TREES * leaves)]
    x = _matrix(pa.array([r["v"] for r in found], pa.binary()), len(found))
    return x[np.random.default_rng(11).permutation(len(x))].reshape(TREES, leaves, -1)


def _first_graph(nodes: DataFrame, n: int, size: int, parts: int, buckets: int) -> DataFrame:
    """Neighbours inside leaves: the nodes nearest to the same one of some random nodes, which are others each time."""
    trees, leaves = (TREES, ceil(n / LEAF)) if n > LEAF else (1, 1)
    pivots = _pivots(nodes, n, leaves) if n > LEAF else np.zeros((1, 1, size), dtype=np.float32)
    along = np.random.default_rng(12).standard_normal((trees, size)).astype(np.float32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), batch.num_rows)
            for t in range(trees):
                leaf = np.concatenate([(x[i : i + 1000] @ pivots[t].T).argmax(axis=1) for i in range(0, len(x), 1000)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(leaf.astype(np.int64)), pa.array((x @ along[t]).astype(float)), batch.column(0), batch.column(1)], names=["tree", "leaf", "place", "node", "v"])

    dealt = nodes.select("node", "v").mapInArrow(deal, "tree long, leaf long, place double, node long, v binary")
    # By ranges, so that a leaf of many unequal vectors lies in several tasks; a table that is one leaf stays together.
    dealt = dealt.repartitionByRange(parts, "tree", "leaf", "place") if n > LEAF else dealt.repartition(parts, "tree", "leaf")
    dealt = dealt.sortWithinPartitions("tree", "leaf", "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for g in _groups(batches, [0, 1], BLOCK):
                yield from _near(g.column(3).to_numpy().astype(np.uint32), _matrix(g.column(4).combine_chunks(), g.num_rows), LEAF_OFFER if n > LEAF else DEGREE)

        return _gathered(found(), _OFFERS, buckets)

    return _merge(None, dealt.mapInArrow(compare, _PACKED), parts, buckets)


def _vector_type(size: int) -> np.dtype:
    """A node and its packed vector of so many coordinates."""
    return np.dtype([("a", "<u4"), ("v", f"V{4 + 2 * size}")])


def _partners(vectors: DataFrame, size: int, parts: int, buckets: int) -> DataFrame:
    """Offers between the nodes of random groups, which are parts of a bucket."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for _, got in _meeting(batches, vectors=(_VECTOR, _vector_type(size))):
                group = (_mixed(got["vectors"]["a"], 23) % np.uint64(max(1, len(got["vectors"]) // PARTNERS))).astype(np.int64)
                nodes = got["vectors"][np.argsort(group, kind="stable")]
                for part in np.split(nodes, np.cumsum(np.bincount(group))[:-1]):
                    yield from _near(part["a"], _decoded(part["v"]), DEGREE)

        return _gathered(found(), _OFFERS, buckets)

    return _met(parts, vectors).mapInArrow(compare, _PACKED)


def _lists(graph: DataFrame, seed: int, parts: int, buckets: int) -> DataFrame:
    """What each list wants: the first WIDTH neighbours of a node, and of the nodes that have it as neighbour WIDTH, new ones
    first. Lists without a new member are left out."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for _, got in _meeting(batches, graph=(_GRAPH, _EDGE), back=(_BACK, _PAIR)):
                ahead, behind = got["graph"], got["back"]
                ahead = ahead[_place(ahead["a"]) < WIDTH]
                own = (behind["a"] // np.uint32(buckets)).astype(np.uint64)
                behind = behind[np.argsort(own << np.uint64(33) | (behind["f"] == 0).astype(np.uint64) << np.uint64(32) | _mixed(behind["b"], seed))]
                behind = behind[_place(behind["a"]) < WIDTH]
                every = np.empty(len(ahead) + len(behind), dtype=_PAIR)
                for name, x in (("a", ahead["a"]), ("b", ahead["b"]), ("f", ahead["f"] != _MET)):
                    every[name][: len(ahead)], every[name][len(ahead) :] = x, behind[name]
                key = (every["a"] // np.uint32(buckets)).astype(np.uint64) << np.uint64(33) | every["b"].astype(np.uint64) << np.uint64(1) | (every["f"] == 0)
                order = np.argsort(key)
                pair = key[order] >> np.uint64(1)
                every = every[order[_first(pair)]]  # of a member that is there twice the new one
                cuts = _cuts(every["a"])
                fresh = np.maximum.reduceat(every["f"], cuts[:-1]) if len(every) else every["f"]
                every = every[np.repeat(fresh, np.diff(cuts)) > 0]
                every["a"], every["b"] = every["b"], every["a"].copy()  # now by member
                yield every

        return _gathered(found(), _WANTED, buckets)

    return _met(parts, _of(graph, _GRAPH, _BACK)).mapInArrow(choose, _PACKED)


def _members(wanted: DataFrame, vectors: DataFrame, graph: DataFrame, size: int, parts: int, buckets: int) -> DataFrame:
    """The members of each list, with their vectors and the score that an offer must exceed."""
    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for _, got in _meeting(batches, vectors=(_VECTOR, _vector_type(size)), worst=(_WORST, _WORST_TYPE), wanted=(_WANTED, _PAIR)):
                nodes = got["vectors"][np.argsort(got["vectors"]["a"])]
                least = np.full(len(nodes), -2, dtype=np.float32)
                least[np.searchsorted(nodes["a"], got["worst"]["a"])] = got["worst"]["t"]
                for i in range(0, len(got["wanted"]), 50_000):
                    w = got["wanted"][i : i + 50_000]
                    at = np.searchsorted(nodes["a"], w["a"])
                    out = np.empty(len(w), dtype=_member_type(size))
                    out["a"], out["b"], out["f"], out["t"], out["v"] = w["b"], w["a"], w["f"], least[at], nodes["v"][at]
                    yield out

        return _gathered(found(), _MEMBER, buckets)

    return _met(parts, wanted, vectors, _of(graph, _WORST)).mapInArrow(attach, _PACKED)


def _member_type(size: int) -> np.dtype:
    return np.dtype([("a", "<u4"), ("b", "<u4"), ("t", "<f4"), ("f", "u1"), ("v", f"V{4 + 2 * size}")])


def _compared(members: np.ndarray) -> Iterator[np.ndarray]:
    """Members of each list with each other: the OFFER best of them, if better than what a member has, as edges. Pairs
    without a new member are left out."""
    members = members[np.argsort(members["a"], kind="stable")]
    first = _cuts(members["a"])
    for i in range(0, len(first) - 1, 64):
        own = first[i : i + 65]
        part, sizes = members[own[0] : own[-1]], np.diff(own)
        row, at = np.repeat(np.arange(len(sizes)), sizes), _place(part["a"])
        x = _decoded(part["v"])
        size = x.shape[1]
        # Two more coordinates take 8 from the product of two old members, and of a member with the padding.
        left, right = (np.zeros((len(sizes), sizes.max(), size + 2), dtype=np.float32) for _ in range(2))
        left[row, at, :size] = right[row, at, :size] = x
        old = part["f"] == 0
        left[row, at, size], left[row, at, size + 1] = -8.0 * old, -8.0
        right[..., size + 1] = 1
        right[row, at, size], right[row, at, size + 1] = old, 0
        s = np.matmul(left, right.transpose(0, 2, 1))
        s[:, np.arange(s.shape[1]), np.arange(s.shape[1])] = -8
        ids, least = np.zeros(s.shape[:2], dtype=np.uint32), np.full(s.shape[:2], np.inf, dtype=np.float32)
        ids[row, at], least[row, at] = part["b"], part["t"]
        good = s > least[..., None]
        if (many := np.nonzero(np.count_nonzero(good, axis=2) > OFFER))[0].size:
            of = s[many]
            good[many] &= of >= np.partition(of, of.shape[1] - OFFER, axis=1)[:, of.shape[1] - OFFER, None]
        found = np.flatnonzero(good)
        who, whom = np.divmod(found, s.shape[1])
        e = np.full(len(found), _OFFERED, dtype=_EDGE)
        e["a"], e["s"] = ids.ravel()[who], s.ravel()[found]
        e["b"] = ids.ravel()[who // s.shape[1] * s.shape[1] + whom]
        yield e


def _offers(members: DataFrame, size: int, parts: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for _, got in _meeting(batches, members=(_MEMBER, _member_type(size))):
                yield from _compared(got["members"])

        return _gathered(found(), _OFFERS, buckets)

    return _met(parts, members).mapInArrow(run, _PACKED)


def build(nodes: DataFrame, n: int, size: int) -> DataFrame:
    """(node, neighbours): the neighbour graph of nodes (node long, v packed; size: coordinates, the added one with them)."""
    parts, buckets = _parts(nodes.sparkSession, n), _buckets_of(n)
    packed = common.saved(_packed_nodes(nodes, buckets), "packed")
    graph = common.saved(_first_graph(nodes, n, size, parts, buckets), "graph")
    if n > LEAF and (graph.agg(F.sum("full")).first()[0] or 0) < n:
        graph = common.saved(_merge(graph, _partners(packed, size - 1, parts, buckets), parts, buckets), "graph")
    for i in count() if n > LEAF else ():  # ends: lists only get better
        members = _members(_lists(graph, i, parts, buckets), packed, graph, size - 1, parts, buckets)
        graph = common.saved(_merge(graph, _offers(members, size - 1, parts, buckets), parts, buckets), "graph")
        if (graph.agg(F.sum("fresh")).first()[0] or 0) < 0.01 * n * DEGREE:
            break
    return _with_seldom(graph, n > LEAF, parts, buckets)


def _with_seldom(graph: DataFrame, more: bool, parts: int, buckets: int) -> DataFrame:
    """(node, neighbours) of the packed graph, with edges back to nodes that few lists hold, the DEGREE best for a node, if more."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for _, got in _meeting(batches, graph=(_GRAPH, _EDGE), held=(_BACK, _PAIR)):
                e = got["graph"]
                lists = np.bincount(got["held"]["a"] // np.uint32(buckets), minlength=int(e["a"].max()) // buckets + 1 if len(e) else 0)
                e = e[lists[e["a"] // np.uint32(buckets)] < SELDOM]
                e["a"], e["b"] = e["b"], e["a"].copy()
                yield e

        return _gathered(found(), _OFFERS, buckets)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in _meeting(batches, graph=(_GRAPH, _EDGE), offers=(_OFFERS, _EDGE)):
            e = _best(got["offers"], DEGREE, buckets)
            e = _best(np.concatenate([got["graph"], e]), 2 * DEGREE, buckets)
            cuts = _cuts(e["a"])
            offsets = pa.array(cuts.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(e["a"][cuts[:-1]].astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(e["b"].astype(np.int64)))], names=["node", "neighbours"])

    offers = [_met(parts, _of(graph, _GRAPH, _BACK)).mapInArrow(back, _PACKED)] if more else []
    return _met(parts, _of(graph, _GRAPH), *offers).mapInArrow(lists, "node long, neighbours array<long>")


_LINK = np.dtype([("a", "<u4"), ("b", "<u4")])
_FOUND = np.dtype([("q", "<i8"), ("b", "<u4"), ("s", "<f4")])


def _asked(queries: DataFrame, n: int, parts: int) -> DataFrame:
    """queries with the block in which they search: near ones together, ABREAST at most, on average."""
    total = queries.count()
    cells = max(1, ceil(total / ABREAST), min(parts, ceil(total / FEWEST)))
    found = common.smallest_hashes(queries.select("query", "w"), "query", cells).collect()
    pivots = _matrix(pa.array([r["w"] for r in found], pa.binary()), len(found))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), batch.num_rows)
                cell = np.concatenate([(x[i : i + 1000] @ pivots.T).argmax(axis=1) for i in range(0, len(x), 1000)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["query", "node", "w", "cell"])

    dealt = queries.select("query", "node", "w").mapInArrow(deal, "query long, node long, w binary, cell int")
    dealt = dealt.join(dealt.groupBy("cell").agg(F.ceil(F.count("*") / ABREAST).alias("of")), "cell")
    return dealt.select("query", "node", "w", (F.col("cell") + cells * F.pmod(F.xxhash64("query"), "of")).cast("int").alias("block"))


class _Beams:
    """The beams of a block's queries, by falling score."""

    def __init__(self, queries: np.ndarray, width: int):
        queries = queries[np.argsort(queries["q"])]
        self.ids, self.w, self.width = queries["q"], _decoded(queries["v"], last=False), width
        self.q, self.node, self.s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.float32)
        self.least = np.full(len(self.ids), -np.inf, dtype=np.float32)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, q: np.ndarray, node: np.ndarray, s: np.ndarray) -> None:
        self.held.append((q, node, s))
        if sum(len(h[0]) for h in self.held) > 2 * len(self.ids) * self.width:
            self.settle()

    def settle(self) -> None:
        q, node, s = (np.concatenate(x) for x in zip((self.q, self.node, self.s), *self.held, strict=True))
        order = np.argsort(q.astype(np.uint64) << np.uint64(32) | _falling(s), kind="stable")
        q, node, s = q[order], node[order], s[order]
        place = _place(q)
        keep = place < self.width
        self.q, self.node, self.s, self.held = q[keep], node[keep], s[keep], []
        last = place == self.width - 1
        self.least[q[last]] = s[last]

    def meet(self, nodes: np.ndarray, v: np.ndarray) -> None:
        """All queries of the block with nodes that they haven't met."""
        for i in range(0, len(nodes), 4096):
            s = self.w @ _decoded(v[i : i + 4096], last=False).T
            if s.shape[1] > self.width and np.isneginf(self.least).any():
                top = np.argpartition(s, s.shape[1] - self.width, axis=1)[:, s.shape[1] - self.width :]
                q, at = np.repeat(np.arange(len(s)), self.width), top.ravel()
            else:
                q, at = np.divmod(np.flatnonzero(s > self.least[:, None]), s.shape[1])
            self.offer(q, nodes[i : i + 4096][at], s[q, at])


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, n: int, keep: int | None = None) -> DataFrame:
    """(query, node): the beam of each query; with keep, only what may be among its best so many nodes. queries: query long,
    node long (where it starts), w (its vector, packed)."""
    spark = nodes.sparkSession
    parts, buckets, width = _parts(spark, n), _buckets_of(n), beam_width(n)
    none = spark.createDataFrame([], "query long, node long")
    size = nodes.select(F.octet_length("v")).first()
    if size is None:
        return none
    vector_type, query_type, raw = _vector_type((size[0] - 4) // 2), np.dtype([("q", "<i8"), ("v", f"V{size[0]}")]), f"V{size[0]}"
    asked = common.saved(_asked(queries, n, parts), "asked")
    blocks = [r[0] for r in asked.select("block").distinct().collect()]
    if not blocks:
        return none

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                out = np.empty(len(batch.column(1).flatten()), dtype=_LINK)
                out["a"], out["b"] = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()), batch.column(1).flatten().to_numpy()
                yield out

        return _gathered(found(), _GRAPH, buckets)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                out = np.empty(batch.num_rows, dtype=_LINK)
                out["a"], out["b"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                yield out

        return _gathered(found(), _OPEN, buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = np.empty(batch.num_rows, dtype=query_type)
                out["q"], out["v"] = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=raw)
                yield from _rows(out, _QUERY, batch.column(2).to_numpy())

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbours of the nodes that blocks expand, and these themselves."""

        def found() -> Iterator[np.ndarray]:
            for _, got in _meeting(batches, edges=(_GRAPH, _LINK), open=(_OPEN, _LINK)):
                e = got["edges"][np.argsort(got["edges"]["a"], kind="stable")]
                wanted = got["open"][np.argsort(got["open"]["b"], kind="stable")]
                for i in range(0, len(wanted), 50_000):
                    w = wanted[i : i + 50_000]
                    first = np.searchsorted(e["a"], w["a"])
                    sizes = np.searchsorted(e["a"], w["a"], side="right") - first
                    at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    key = np.unique(np.concatenate([np.repeat(w["b"], sizes).astype(np.uint64) << np.uint64(32) | e["b"][at], w["b"].astype(np.uint64) << np.uint64(32) | w["a"]]))
                    out = np.empty(len(key), dtype=_LINK)
                    out["a"], out["b"] = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32)
                    yield out

        return _gathered(found(), _REACHED, buckets)

    groups = max(1, n // ENTRIES)

    def attach(entries: bool) -> object:
        """What blocks reach and haven't met, with its vectors; what they have met is kept as bits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            member_type = np.dtype([("a", "<u4"), ("v", raw)])

            def passed() -> Iterator[pa.RecordBatch]:
                out, to = np.empty(sum(len(h[1]) for h in held), dtype=member_type), np.repeat([h[0] for h in held], [len(h[1]) for h in held])
                out["a"], out["v"] = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                yield from _rows(out, _MEMBER, to)
                held.clear()

            for bucket, got in _meeting(batches, vectors=(_VECTOR, vector_type), reached=(_REACHED, _LINK), sent=(_SENT, np.dtype("u1"))):
                own = got["vectors"][np.argsort(got["vectors"]["a"])]
                if not len(own):
                    continue
                sent = got["sent"].reshape(-1, 4 + (len(own) + 7) // 8)
                met = dict(zip(np.ascontiguousarray(sent[:, :4]).view("<u4")[:, 0].tolist(), sent[:, 4:], strict=True))
                reached = got["reached"][np.argsort(got["reached"]["b"], kind="stable")]
                cuts = _cuts(reached["b"])
                want = {int(reached["b"][a]): reached["a"][a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
                group = _mixed(own["a"], 29) % np.uint64(groups)
                for block in blocks if entries else want:
                    on = np.zeros(len(own), dtype=bool)
                    if block in want:
                        on[np.searchsorted(own["a"], want[block])] = True
                    if entries:
                        on |= group == _mixed(np.array([block]), 31) % np.uint64(groups)
                    if block in met:
                        seen = np.unpackbits(met[block], count=len(own)).astype(bool)
                        on &= ~seen
                        met[block] = np.packbits(seen | on)
                    else:
                        met[block] = np.packbits(on)
                    if on.any():
                        held.append((block, own["a"][on], own["v"][on]))
                        if sum(h[2].nbytes for h in held[-1:]) and sum(len(h[1]) for h in held) * member_type.itemsize >= GATHER:
                            yield from passed()
                data = [np.array([k], dtype="<u4").tobytes() + v.tobytes() for k, v in met.items()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), -1 - bucket, dtype=np.int32)), pa.array(np.full(len(data), _SENT, dtype=np.int32)), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])
            if held:
                yield from passed()

        return run

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Beams with what their block has met now, and the nodes that the block expands next."""
        member_type = np.dtype([("a", "<u4"), ("v", raw)])

        def ended(block: int, beams: _Beams, done: np.ndarray) -> Iterator[pa.RecordBatch]:
            beams.settle()
            out = np.empty(len(beams.q), dtype=_FOUND)
            out["q"], out["b"], out["s"] = beams.ids[beams.q], beams.node, beams.s
            rest = np.flatnonzero(~np.isin(beams.node, done))
            opened = np.unique(beams.node[rest[_place(beams.q[rest]) < EXPAND]])
            every = np.concatenate([done, opened])
            yield from _rows(out, _BEAM, np.full(len(out), block))
            yield from _rows(every.view([("a", "<u4")]), _DONE, np.full(len(every), block))
            ahead = np.empty(len(opened), dtype=_LINK)
            ahead["a"], ahead["b"] = opened, block
            yield from _rows(ahead, _OPEN, opened % np.uint32(buckets))

        last, beams, done, asks = None, None, np.zeros(0, dtype=np.uint32), []
        for bucket, kind, data in _values(batches):
            if kind == _SENT:
                yield pa.RecordBatch.from_arrays([pa.array([-1 - bucket], pa.int32()), pa.array([_SENT], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["bucket", "kind", "data"])
                continue
            if bucket != last:
                if beams:
                    yield from ended(last, beams, done)
                last, beams, done, asks = bucket, None, np.zeros(0, dtype=np.uint32), []
            if kind == _QUERY:
                asks.append(data.view(query_type))
                continue
            beams = beams or _Beams(np.concatenate(asks), width)
            if kind == _BEAM:
                x = data.view(_FOUND)
                beams.offer(np.searchsorted(beams.ids, x["q"]), x["b"], x["s"])
            elif kind == _DONE:
                done = np.concatenate([done, data.view("<u4")])
            elif kind == _MEMBER:
                if beams.held:
                    beams.settle()
                x = data.view(member_type)
                beams.meet(x["a"], x["v"])
        if beams:
            yield from ended(last, beams, done)

    edges = common.saved(graph.select("node", "neighbours").mapInArrow(links, _PACKED), "edges")
    vectors = common.saved(_packed_nodes(nodes, buckets), "packed")
    packed = common.saved(asked.select("query", "w", "block").mapInArrow(ask, _PACKED), "queries")
    state = spark.createDataFrame([], _PACKED)
    opened = asked.select("node", "block").distinct().mapInArrow(starts, _PACKED)
    for i in count():  # ends: a block expands a node once at most
        reached = _met(parts, edges, opened).mapInArrow(follow, _PACKED)
        members = _met(parts, vectors, reached, state.where(F.col("kind") == _SENT)).mapInArrow(attach(i == 0), _PACKED)
        known = state.where(F.col("kind").isin(_BEAM, _DONE))
        state = common.saved(_met(max(parts, 4 * len(blocks)), packed, known, members).mapInArrow(step, _PACKED), "beam")
        opened = state.where(F.col("kind") == _OPEN)
        if not opened.limit(1).count():
            break

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _values(batches):
            x = data.view(_FOUND)  # by query and falling score
            if keep is not None:
                cuts = _cuts(x["q"])
                sizes = np.diff(cuts)
                x = x[x["s"] >= np.repeat(x["s"][cuts[:-1] + np.minimum(sizes, keep) - 1], sizes) - ROUNDING]
            yield pa.RecordBatch.from_arrays([pa.array(x["q"].astype(np.int64)), pa.array(x["b"].astype(np.int64))], names=["query", "node"])

    return state.where(F.col("kind") == _BEAM).mapInArrow(unpack, "query long, node long")


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product of each row for which is_query (of column id)."""
    ok = vectors(df, id_column, column).distinct()
    top = Window.partitionBy("x").orderBy("id")
    members = ok.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1)
    grouped = members.groupBy("x").agg(F.min("id").alias("least"), F.array_sort(F.collect_list("id")).alias("members"))
    # Nodes are numbered, so that edges are short and a number's remainder is a random bucket.
    deal = Window.partitionBy("part").orderBy("least", "x")
    grouped = grouped.withColumn("part", F.pmod(F.xxhash64("least", "x"), F.lit(BUCKETS)))
    grouped = common.saved(grouped.withColumn("node", (F.row_number().over(deal) - 1) * F.lit(BUCKETS).cast("long") + F.col("part")).drop("part"), "vectors")
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    stats = grouped.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.max(F.size("x")).alias("size")).first()
    n, most, size = stats["n"], stats["most"] or 1.0, (stats["size"] or 1) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) / np.sqrt(most)
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed_vectors(x)], names=["node", "v"])

    nodes = common.saved(grouped.select("node", "x").mapInArrow(pack, "node long, v binary"), "nodes")
    graph = build(nodes.select("node", "v"), n, size)
    asked = common.saved(ok.where(is_query).join(grouped.select("x", "node"), "x").select(F.col("id").alias("query"), "node", "x"), "queries")
    # Rows of equal vectors search once, as their node.
    starts = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("query"), "node", F.col("v").alias("w"))
    beam = search(graph, nodes, starts, n, k + 1).select(F.col("query").alias("start"), "node")
    # A repeated id of several vectors asks with each; its rows are told apart by their node.
    asked = asked.withColumn("query_id", F.col("query")).withColumn("query", F.xxhash64("query", "node"))
    beam = asked.select(F.col("node").alias("start"), "query").join(beam, "start").select("query", "node")
    candidates = grouped.select("node", F.col("x").alias("y"), "members")
    pairs = beam.join(candidates, "node").join(asked.select("query", "query_id", "x"), "query")
    held = beam.join(grouped.select("node", "members"), "node").join(asked.select("query", "query_id"), "query")
    held = held.groupBy("query").agg(F.count("*").alias("nodes"), F.sum(F.size("members") - F.array_contains("members", F.col("query_id")).cast("int")).alias("rows"))
    short = common.saved(asked.join(held, "query", "left").where((F.coalesce("rows", F.lit(0)) < k) & (F.coalesce("nodes", F.lit(0)) < n)).select("query", "query_id", "x"), "short")
    if short.limit(1).count():
        blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # these queries against all rows, in blocks
        dealt = candidates.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
        every = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "block").drop("block")
        pairs = pairs.join(short.select("query"), "query", "left_anti").unionByName(every)
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
    rows = pairs.select("query", "query_id", product.alias("score"), F.explode("members").alias("id")).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_nearest_neighbours: the 20 nearest rows of every row whose id is divisible by 20."""
    found = nearest(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
