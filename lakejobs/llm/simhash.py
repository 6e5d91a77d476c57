"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints: words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case; shingles are k consecutive words,
repeats included, joined by one space (fewer words: the whole sequence); h is a shingle's XXH64, seed 42; a bit of
the fingerprint is 1 if it is set in over half the h. No words: fingerprint zero, linked like any other.

Links join fingerprints that differ in at most max_distance bits; components are the documents that links reach.
Exact copies fall together first: everything after works on distinct fingerprints.

Search: the 64 bits are grouped into m partitions, correlated bits together, and each partition i gets a threshold
t_i >= -1 with sum(t_i) = max_distance - m + 1. Two fingerprints within max_distance then differ in at most t_i bits of
some partition i (generalised pigeonhole), so no link is lost. m and the t_i are those of least estimated cost:
dynamic programming over the partitions on the probes a threshold needs and the candidates it lets through, both
estimated from the bit counts of all fingerprints. A fingerprint is stored under its own partition values and probes
with all values within t_i; candidates are verified on all 64 bits.

Dense groups of near copies are not expanded into pairs. First every bucket of equal partition values links its
members to two of its own (the smallest fingerprint and the one of most documents), which joins nearly all of a
dense group in linear work. Only buckets that still hold different components are then probed, crowded ones split by
further bits, and only pairs of different components are kept.

Defined cases: null and empty texts have fingerprint zero; a null id takes part, and is never a component id unless
all ids of the component are null; repeated rows are rows of their own; an empty table gives no rows; other columns
of any name are kept by deduplicate() and ignored by components().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common

BITS = 64
MAX_DISTANCE = 4
SHINGLE = 4
#: Cost of one probe (a row to shuffle) and of one candidate (a verification in the join).
PROBE_COST, CANDIDATE_COST = 3.0, 0.25
#: Entries and probes of one bucket beyond which it is left out, if of one component, or split by further bits.
CROWDED = 512


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(found)
    if len(found) <= k:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths)[: len(found) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits of the hashes, as an unsigned number."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16), None].view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """docs (kept columns first) with __fp, the fingerprint as a signed long, in place of the text column."""
    fields = [f for f in docs.schema if f.name not in (text, "__fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [batch.schema.names.index(f.name) for f in fields]
            fp = pa.array([_signed(fingerprint(shingle_hashes(t, k))) for t in common.texts(batch, text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], fp], names=[*[batch.schema.names[i] for i in keep], "__fp"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return docs.mapInArrow(run, ", ".join([*kept, "`__fp` long"]))


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set (64 x 64), over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fp), 1 << 15):
                x = np.unpackbits(fp[i : i + (1 << 15), None].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
            n += len(fp)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of even size. Each group starts with the most one-sided bit that is left and takes the
    bits that correlate most with what it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [min(left, key=lambda b: (spread[b], b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, group: list[int], top: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1, ... top bits of the group, bits taken as independent."""
    dist = np.zeros(top + 1)
    dist[0] = 1.0
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        dist = dist * (1 - q) + np.append(0.0, dist[:-1]) * q
    return np.cumsum(dist).tolist()


def allocate(n: int, p: np.ndarray, groups: list[list[int]], max_distance: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost whose sum is max_distance - m + 1; -1 leaves a partition out."""
    m = len(groups)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        chance = within(p, group, max_distance)
        cost = {-1: 0.0}
        for t in range(max_distance + 1):
            probes = sum(comb(len(group), r) for r in range(t + 1))
            cost[t] = n * PROBE_COST * probes + n * float(n) / 2 * chance[t] * CANDIDATE_COST
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for t, c in cost.items():
                key = used + t + 1
                if key <= max_distance + 1 and (key not in new or so_far + c < new[key][0]):
                    new[key] = (so_far + c, [*chosen, t])
        best = new
    return best[max_distance + 1]  # sum(t_i + 1) = max_distance + 1


def plan(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions of the cheapest allocation, over m = 1 .. max_distance + 1 partitions."""
    n, together = bit_statistics(distinct)
    p = np.diag(together) / max(n, 1)
    options = []
    for m in range(1, max_distance + 2):
        groups = correlated_groups(n, together, m)
        cost, chosen = allocate(n, p, groups, max_distance)
        options.append((cost, m, groups, chosen))
    _, _, groups, chosen = min(options, key=lambda x: x[:2])
    return [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _buckets(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Each node under its own value in each partition: (part, sig, ...)."""
    own = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("sig")) for i, (g, _) in enumerate(parts)])
    return nodes.select("*", F.explode(own).alias("b")).select("*", "b.part", "b.sig").drop("b")


def _probes(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Each node under all values within the threshold of each partition."""
    out = None
    for i, (g, t) in enumerate(parts):
        flips = [_mask(list(c)) for r in range(t + 1) for c in combinations(g, r)]
        listed = nodes.sparkSession.createDataFrame([(flips,)], "flips array<long>")  # one row, C(64, 4) numbers at most
        probed = nodes.join(F.broadcast(listed)).select(*nodes.columns, F.lit(i).alias("part"), F.explode("flips").alias("flip"))
        probed = probed.withColumn("sig", F.col("fp").bitwiseAND(F.lit(_mask(g))).bitwiseXOR(F.col("flip"))).drop("flip")
        out = probed if out is None else out.unionByName(probed)
    return out


def _near(a: str, b: str, max_distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_distance


def links(nodes: DataFrame, max_distance: int = MAX_DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that have the components of all links, not all the links.

    nodes: (fp long, n long) distinct fingerprints and their number of documents.
    """
    parts = plan(nodes, max_distance)
    own = _buckets(nodes, parts)
    hubs = own.groupBy("part", "sig").agg(F.count("*").alias("size"), F.min("fp").alias("low"), F.max_by("fp", F.struct("n", "fp")).alias("top")).where("size > 1")
    star = own.select("fp", "part", "sig").join(hubs, ["part", "sig"])
    star = star.select(F.explode(F.array(F.struct(F.col("fp").alias("u"), F.col("low").alias("v")), F.struct(F.col("fp").alias("u"), F.col("top").alias("v")))).alias("e"))
    star = common.saved(star.select("e.u", "e.v").where((F.col("u") != F.col("v")) & _near("u", "v", max_distance)).distinct(), "star-links")
    label = common.connected_components(star)
    # What is left: pairs of different components, from buckets that hold different components.
    marked = common.saved(nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", F.coalesce("component", "fp").alias("c")), "labelled")
    stored, probes = _buckets(marked, parts), _probes(marked, parts)
    right = probes.select("part", "sig", F.col("fp").alias("v"), F.col("c").alias("cv"))
    left = stored.select("part", "sig", F.col("fp").alias("u"), F.col("c").alias("cu"))
    both = left.select("part", "sig", F.col("cu").alias("c")).unionByName(right.select("part", "sig", F.col("cv").alias("c")))
    sizes = both.groupBy("part", "sig").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n")).where(F.col("n") > crowded)
    sizes = common.saved(sizes.select("part", "sig", (F.col("a") == F.col("b")).alias("same")), "crowded")
    key = ["part", "sig"]
    pairs = left.join(sizes.select(*key), key, "left_anti").join(right, key).select("u", "cu", "v", "cv")
    mixed = sizes.where("not same").select(*key)
    if mixed.limit(1).count():
        # Bits in max_distance + 1 groups: fingerprints within the distance agree in one of them, so a crowded bucket is
        # split by group and value without losing a pair.
        groups = np.array_split(np.arange(BITS), max_distance + 1)
        split = lambda df, fp: df.join(mixed, key, "left_semi").select("*", F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(fp).bitwiseAND(F.lit(_mask(bits.tolist()))).alias("value")) for g, bits in enumerate(groups)])).alias("k")).select("*", "k.*").drop("k")
        pairs = pairs.unionByName(split(left, "u").join(split(right, "v"), [*key, "group", "value"]).select("u", "cu", "v", "cv"))
    found = pairs.where((F.col("cu") != F.col("cv")) & _near("u", "v", max_distance))
    return star.unionByName(found.select("u", "v").distinct())


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE, k: int = SHINGLE) -> DataFrame:
    """(id, __fp, component_id): one row per document."""
    prints = common.saved(fingerprints(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")), k=k), "fingerprints")
    nodes = common.saved(prints.groupBy(F.col("__fp").alias("fp")).agg(F.count("*").alias("n"), F.min("id").alias("least")), "distinct")
    label = common.connected_components(links(nodes.select("fp", "n"), max_distance))
    joined = nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    by_fp = joined.join(joined.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "component_id")
    return prints.join(by_fp, prints["__fp"] == by_fp["fp"]).select(F.col("id").alias(id_column), "__fp", "component_id")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE, k: int = SHINGLE) -> DataFrame:
    """One document of each group: the one of the smallest id (of repeated rows with that id, one)."""
    plain, (id_column, text) = common.by_place(docs, id_column, text)
    numbered = common.saved(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    keyed = numbered.select("row", F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    prints = common.saved(fingerprints(keyed, k=k), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    nodes = common.saved(prints.groupBy(F.col("__fp").alias("fp")).agg(F.count("*").alias("n"), first.alias("first")), "distinct")
    label = common.connected_components(links(nodes.select("fp", "n"), max_distance))
    joined = nodes.join(label, nodes["fp"] == label["node"], "left").select("first", F.coalesce("component", "fp").alias("c"))
    kept = joined.groupBy("c").agg(F.min("first").alias("first")).select("first.row")
    return numbered.join(kept, "row", "left_semi").select(*plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_simhash: fingerprint and component of every document."""
    found = components(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")
