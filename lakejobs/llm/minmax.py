"""Near-duplicates by min-max hashing of word shingles, confirmed on full sets.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case; a document's set is its distinct shingles of SHINGLE
words, joined by one space (fewer words: the whole sequence; none: empty), told apart by XXH64. Documents are linked if
100 * intersection >= 100 * threshold * union; components are the documents that links reach.

Signatures: each of PERMUTATIONS permutations of the hashes gives two values, the least and the greatest of the set. Both
agree between two sets with the chance of their similarity J, and they are as good as independent, so one evaluation of
all hashes does the work of two, with less variance. A band is the four values of two permutations: J^4 to agree. Over
BANDS bands a pair of J = 0.85 is missed with the chance (1 - 0.85^4)^20 = 4e-7; a candidate has to agree in AGREE of the
80 values, which 0.85 fails with a chance below 1e-8, before its sets are compared.

Equal sets fall together first: all that follows works on distinct sets. Dense groups aren't expanded into pairs: every
bucket links its members to the one of most documents, then, in HUB_ROUNDS rounds, to one member of each of two of the components that
it still holds; what links confirm falls together. Only pairs of different components are compared at last. In a bucket of
over CROWDED members these are found by what sets the members apart from the bucket's hub H: with D_u the symmetric
difference of the sets of u and H, those of u and v differ in |D_u ^ D_v|. A link allows t = 15 / 185 (|u| + |v|), so that D_u
and D_v share at least o = (|D_u| + |D_v| - t) / 2 elements, and one among the first |D_u| - o + 1 of D_u and |D_v| - o + 1 of
D_v in one order: first what H lacks, which is seldom common. (Where o is 0, both are linked to H.) So variants of one text
that aren't near each other don't meet at all, and no link is lost.

Sets aren't stored. The texts of those nodes that share a bucket are taken out once, one text a node, and pairs meet the
texts of both their nodes by joins.

Defined cases: null and empty texts and texts without words have the empty set, are linked with nothing and are their own
component; a null id takes part, and is a component id only where all ids of the component are null; repeated rows are
rows of their own; an empty table gives no rows; other columns of any name are kept by deduplicate().
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common
from lakejobs.llm.simhash import shingle_hashes

SHINGLE, THRESHOLD = 5, 85
PERMUTATIONS, BANDS, ROWS = 40, 20, 4
AGREE = 48
HUB_ROUNDS, CROWDED = 1, 128
#: Sets of hubs that a task keeps at hand.
HELD = 64

_random = np.random.default_rng(20_240_601)
_XOR = _random.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
_TIMES = _random.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_MIX = _random.integers(0, 1 << 64, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, k))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least and greatest value of each permutation, side by side: 2 * PERMUTATIONS numbers."""
    out = np.empty((PERMUTATIONS, 2), dtype=np.uint64)
    out[:, 0], out[:, 1] = np.iinfo(np.uint64).max, 0
    for i in range(0, len(hashes), 2048):
        x = (hashes[i : i + 2048] ^ _XOR[:, None]) * _TIMES[:, None]
        out[:, 0], out[:, 1] = np.minimum(out[:, 0], x.min(axis=1)), np.maximum(out[:, 1], x.max(axis=1))
    return out.ravel()


def bands(values: np.ndarray) -> np.ndarray:
    """A number of each band, equal where all its values are."""
    mixed = (values.reshape(BANDS, ROWS) ^ (values.reshape(BANDS, ROWS) >> np.uint64(29))) * _MIX
    total = mixed.sum(axis=1, dtype=np.uint64)
    return (total ^ (total >> np.uint64(32))).view(np.int64)


def described(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs: (row or id columns ..., text). The text column becomes n, d1 and d2 (a digest of the set), sig and bands."""
    fields = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts(batch, "text")
            for a, b in common.steps([len(t) for t in texts]):
                n, d, sig, own = [], [], [], []
                for t in texts[a:b]:
                    h = shingle_set(t, k)
                    values = signature(h) if len(h) else np.zeros(0, dtype=np.uint64)
                    n.append(len(h))
                    d.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=np.int64))
                    sig.append((values >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    own.append(bands(values) if len(h) else np.zeros(0, dtype=np.int64))
                both = np.array(d).reshape(-1, 2)
                kept = [batch.column(batch.schema.names.index(f.name)).slice(a, b - a) for f in fields]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sig, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.int64()))], names=[*[f.name for f in fields], "n", "d1", "d2", "sig", "bands"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return docs.mapInArrow(run, ", ".join([*kept, "n long", "d1 long", "d2 long", "sig array<int>", "bands array<long>"]))


def _close(threshold: int) -> Column:
    """Whether sizes and signatures of a pair (nu, su, nv, sv) leave it a candidate."""
    agree = F.aggregate(F.zip_with("su", "sv", lambda a, b: (a == b).cast("int")), F.lit(0), lambda t, x: t + x)
    return (100 * F.least("nu", "nv") >= threshold * F.greatest("nu", "nv")) & (agree >= AGREE)


def _candidates(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) that sizes and signatures leave."""
    side = lambda w: nodes.select(F.col("node").alias(w), F.col("n").alias(f"n{w}"), F.col("sig").alias(f"s{w}"))
    return pairs.join(side("v"), "v").join(side("u"), "u").where(_close(threshold)).select("u", "v")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """The pairs (u, v) of nodes whose full sets are linked. texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def set_of(node: int, text: bytes) -> np.ndarray:
            if node not in held:
                held[node] = shingle_set(text, k)
                if len(held) > HELD:
                    held.popitem(last=False)
            held.move_to_end(node)
            return held[node]

        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for u, v, a, b in zip(us, vs, common.texts(batch, "tu"), common.texts(batch, "tv"), strict=True):
                x, y = set_of(u, a), set_of(v, b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda w: texts.select(F.col("node").alias(w), F.col("text").alias(f"t{w}"))
    return pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def labelled(nodes: DataFrame, docs: DataFrame, threshold: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(node, c): the component of every node, by links on full sets.

    nodes: (node, n, docs, id, h, sig, bands) distinct sets that aren't empty, id and h of one document of each.
    docs: (id, h, text).
    """
    members = nodes.select("node", "docs", F.posexplode("bands").alias("band", "key"))
    hubs = members.groupBy("band", "key").agg(F.count("*").alias("size"), F.max_by("node", F.struct("docs", "node")).alias("top")).where("size > 1")
    shared = common.saved(members.join(hubs, ["band", "key"]).select("node", "band", "key", "top"), "shared")
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "id", "h")
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["id"]) & (docs["h"] == wanted["h"]))
    texts = common.saved(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    star = shared.select(F.col("node").alias("u"), F.col("top").alias("v")).where("u <> v").distinct()
    tested = common.saved(_candidates(_in_order(star), nodes, threshold), "tested")
    links = common.saved(confirmed(tested, texts, threshold, k), "links")
    for step in range(HUB_ROUNDS + 1):
        marked = _marked(nodes, links)
        at = shared.select("node", "band", "key", "top").join(marked.select("node", "c"), "node")
        mixed = at.groupBy("band", "key").agg(F.min(F.struct("c", "node")).alias("a"), F.max(F.struct("c", "node")).alias("b"), F.count("*").alias("size")).where("a.c <> b.c")
        if step < HUB_ROUNDS:
            near = at.join(mixed, ["band", "key"]).select(F.col("node").alias("u"), "c", F.explode(F.array("a", "b")).alias("hub")).where(F.col("c") != F.col("hub.c"))
            new = _candidates(_in_order(near.select("u", F.col("hub.node").alias("v"))).join(tested, ["u", "v"], "left_anti"), nodes, threshold)
        else:
            at = at.join(common.saved(mixed.select("band", "key", (F.col("size") > CROWDED).alias("crowded")), "mixed"), ["band", "key"])
            new = _pairs_of_few(at.where("not crowded"), marked, threshold)
            new = new.unionByName(_pairs_of_many(at.where("crowded"), marked, texts, threshold, k)).distinct().join(tested, ["u", "v"], "left_anti")
        new = common.saved(new, "tested")
        tested, links = tested.unionByName(new), links.unionByName(common.saved(confirmed(new, texts, threshold, k), "links"))
    return _marked(nodes, links).select("node", "c")


def _marked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, c, n, sig): nodes with the components of links."""
    label = common.connected_components(links)
    return common.saved(nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "n", "sig"), "marked")


def _pairs_of_few(at: DataFrame, marked: DataFrame, threshold: int) -> DataFrame:
    """Candidates (u, v) of different components that share a bucket, in buckets of CROWDED members at most."""
    both = at.select("node", "band", "key").join(marked, "node")
    side = lambda w: both.select("band", "key", F.col("node").alias(w), F.col("c").alias(f"c{w}"), F.col("n").alias(f"n{w}"), F.col("sig").alias(f"s{w}"))
    pairs = side("u").join(side("v"), ["band", "key"]).where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & _close(threshold))
    return pairs.select("u", "v")


def _pairs_of_many(at: DataFrame, marked: DataFrame, texts: DataFrame, threshold: int, k: int) -> DataFrame:
    """Candidates (u, v) of different components in crowded buckets, by the first of what sets them apart from the hub."""
    near = at.where("node <> top").select("node", F.col("top").alias("hub")).distinct().join(marked.select("node", "c", "n"), "node")
    side = lambda w, t: texts.select(F.col("node").alias(w), F.col("text").alias(t))
    rows = near.join(side("hub", "th"), "hub").join(side("node", "tu"), "node").select("hub", "node", "c", "n", "tu", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            hubs, sizes = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            take, place, apart = [], [], []
            for i, (hub, n, a, b) in enumerate(zip(hubs, sizes, common.texts(batch, "tu"), common.texts(batch, "th"), strict=True)):
                if held[0] != hub:
                    held = (hub, shingle_set(b, k))
                x, y = shingle_set(a, k), held[1]
                own, gone = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                allowed = (100 - threshold) * (100 * n + threshold * n) // (threshold * (100 + threshold))  # by the largest partner
                first = np.concatenate([own, gone])[: allowed + 1]
                take.append(np.full(len(first), i)), place.append(np.arange(len(first))), apart.append((first, len(own) + len(gone)))
            at = np.concatenate([np.zeros(0, dtype=np.int64), *take])
            found = np.concatenate([np.zeros(0, dtype=np.uint64), *[x for x, _ in apart]]).view(np.int64)
            d = np.repeat(np.array([x for _, x in apart], dtype=np.int64), [len(x) for x, _ in apart])
            columns = [batch.column(j).take(pa.array(at)) for j in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array(d), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *place]))], names=["hub", "node", "c", "n", "e", "d", "at"])

    found = common.saved(rows.mapInArrow(run, "hub long, node long, c long, n long, e long, d long, at long"), "differences")
    mixed = found.groupBy("hub", "e").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("hub", "e")
    found = found.join(mixed, ["hub", "e"], "left_semi")
    side = lambda w: found.select("hub", "e", F.col("node").alias(w), *[F.col(c).alias(f"{c}{w}") for c in ("c", "n", "d", "at")])
    allowed = F.floor((100 - threshold) * (F.col("nu") + F.col("nv")) / (100 + threshold))
    share = F.ceil((F.col("du") + F.col("dv") - allowed) / 2)
    first = (F.col("atu") <= F.col("du") - share) & (F.col("atv") <= F.col("dv") - share)
    alike = 100 * F.least("nu", "nv") >= threshold * F.greatest("nu", "nv")
    return side("u").join(side("v"), ["hub", "e"]).where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & alike & first).select("u", "v")


def _nodes(rows: DataFrame) -> DataFrame:
    """A node for each distinct set that isn't empty, with its number of documents and its first one (least id, null last)."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "h")).alias("first")
    found = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.count("*").alias("docs"), first, F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    return common.saved(found.select(F.monotonically_increasing_id().alias("node"), "*", "first.id", "first.h"), "nodes")


def _rows(docs: DataFrame, id_column: str, text: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, h, text) of the documents, and their saved descriptions with a row number."""
    keyed = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    rows = described(keyed.select(F.monotonically_increasing_id().alias("row"), "*"), k)
    return keyed, common.saved(rows, "described")


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id): one row per document. threshold: per cent."""
    keyed, rows = _rows(docs, id_column, text, k)
    nodes = _nodes(rows)
    label = labelled(nodes, keyed, threshold, k).join(nodes.select("node", "d1", "d2", "n", "id"), "node")
    least = label.groupBy("c").agg(F.min("id").alias("component_id"))
    by_set = label.join(least, "c").select("d1", "d2", "n", "component_id")
    found = rows.where("n > 0").join(by_set, ["d1", "d2", "n"]).select("id", "n", "component_id")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(empty).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """One document of each component, that of the smallest id (of repeated rows with that id, one); all without words."""
    plain, (id_column, text) = common.by_place(docs, id_column, text)
    numbered = common.saved(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    keyed = numbered.select("row", F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    rows = common.saved(described(keyed, k), "described")
    nodes = _nodes(rows)
    label = labelled(nodes, keyed.drop("row"), threshold, k).join(nodes.select("node", "first"), "node")
    kept = label.groupBy("c").agg(F.min("first").alias("first")).select("first.row").unionByName(rows.where("n = 0").select("row"))
    return numbered.join(kept, "row", "left_semi").select(*plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_minmax_hash: set size and component of every document."""
    found = components(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
