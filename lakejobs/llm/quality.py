"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature, and each chosen pair of features, has a lookup table over quantile bins. The tables are learnt by cyclic
boosting: round after round, every feature in turn gets a shallow tree on the gradient histogram of its bins, and the
tree's leaf values are added to its table. The pairs of largest gain on what is left are boosted the same way. A score
is the logistic function of a sum of table entries, so scoring is one bin search and one addition per table.

Features are counts and ratios of the whole text (characters by class, words, lines, repetition); ids, labels, language
and source are not among them. The fit uses a bounded sample of labelled rows (max_rows, those of smallest hash);
features and scores are computed for every row.

Defined cases: null text counts as empty, and empty texts are scored like any other; rows with a null label don't
train; a document of several labels trains once per label; without labels, or with one class only, scores are the
constant (positives + 1) / (rows + 2); an empty table gives no rows; extra columns of any name are kept by keep_good(), and
by score() but for one named __score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common

#: Labelled rows of the fit at most: 20 features of 8 bytes each, so 3 MB at the driver.
MAX_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_words", "mean_word", "spread_word", "distinct_words", "repeated_neighbours", "distinct_lines", "words_per_line", "upper", "digit", "space", "symbol",
    "bar", "exclamation", "stop", "comma", "other_ascii", "non_ascii", "capitalised", "stop_after_word", "symbol_after_word",
)

_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _BAR, _BANG, _STOP, _COMMA, _HIGH, _REST = range(11)
_CLASS = np.full(256, _REST, dtype=np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = _UPPER, _LOWER, _DIGIT, _HIGH
for _chars, _kind in ((b" \t\n\v\f\r", _SPACE), (b"#$%&*+/<=>@[\\]^_`{}~", _SYMBOL), (b"|", _BAR), (b"!", _BANG), (b".?", _STOP), (b",;:", _COMMA)):
    _CLASS[list(_chars)] = _kind


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    for a, b in common.steps(sizes.tolist()):
        kind = _CLASS[np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)]
        doc = np.repeat(np.arange(b - a, dtype=np.int32), sizes[a:b])
        count = np.bincount(doc * 11 + kind, minlength=(b - a) * 11).reshape(b - a, 11).astype(float)
        first = np.ones(len(kind), dtype=bool)  # the first byte of a word
        first[1:] = (kind[:-1] == _SPACE) | (doc[1:] != doc[:-1])
        first &= kind != _SPACE
        last = np.ones(len(kind), dtype=bool)
        last[:-1] = (kind[1:] == _SPACE) | (doc[1:] != doc[:-1])
        last &= kind != _SPACE
        per = lambda mask: np.bincount(doc[mask], minlength=b - a).astype(float)
        words = per(first)
        length = np.flatnonzero(last) - np.flatnonzero(first) + 1.0
        squares = np.bincount(doc[first], weights=length**2, minlength=b - a)
        n, w = np.maximum(sizes[a:b], 1).astype(float), np.maximum(words, 1)
        mean = (n - count[:, _SPACE]) * (words > 0) / w
        own = out[a:b]
        own[:, 0] = np.log1p(words)
        own[:, 1] = mean
        own[:, 2] = np.sqrt(np.maximum(squares / w - mean**2, 0))
        for i, text in enumerate(texts[a:b]):
            found, lines = text.split(), text.split(b"\n")
            own[i, 3] = len(set(found)) / w[i]
            own[i, 4] = sum(map(bytes.__eq__, found, found[1:])) / w[i]
            own[i, 5] = len(set(lines)) / len(lines)
            own[i, 6] = np.log1p(words[i] / len(lines))
        letters = np.maximum(count[:, _UPPER] + count[:, _LOWER] + count[:, _HIGH], 1)
        own[:, 7] = count[:, _UPPER] / letters
        for j, c in ((8, _DIGIT), (9, _SPACE), (10, _SYMBOL), (11, _BAR), (12, _BANG), (13, _STOP), (14, _COMMA), (15, _REST), (16, _HIGH)):
            own[:, j] = count[:, c] / n
        own[:, 17] = per(first & (kind == _UPPER)) / w
        own[:, 18] = per(last & (kind == _STOP)) / w
        own[:, 19] = per(last & ((kind == _SYMBOL) | (kind == _BANG) | (kind == _BAR))) / w
    return out


@dataclass
class Additive:
    """Tables of a fitted model: edges of each feature's bins, a table for each feature, and one for each pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # i, j, edges of i, edges of j, table

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for i, j, at_i, at_j, table in self.pairs:
            out += table[np.searchsorted(at_i, x[:, i], side="right"), np.searchsorted(at_j, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, shrink: float) -> np.ndarray:
    """Leaf value of each bin: best-first splits of the bin range by second-order gain, at most so many leaves."""
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + shrink)
    ranges = [(0, len(g))]

    def best_split(a: int, b: int) -> tuple[float, int]:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        left_g, left_h = gs[:-1], hs[:-1]
        right_g, right_h = gs[-1] - left_g, hs[-1] - left_h
        gain = left_g**2 / (left_h + shrink) + right_g**2 / (right_h + shrink) - gs[-1] ** 2 / (hs[-1] + shrink)
        gain[(left_h < least) | (right_h < least)] = -1
        return (float(gain.max()), a + 1 + int(gain.argmax())) if len(gain) else (-1.0, a)

    while len(ranges) < leaves:
        gain, cut, k = max((*best_split(*r), k) for k, r in enumerate(ranges))
        if gain <= 0:
            break
        a, b = ranges.pop(k)
        ranges += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = value(a, b)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, pair_rounds: int = 80, n_pairs: int = 8, bins: int = 64, pair_bins: int = 12, rate: float = 0.1, leaves: int = 3, least: float = 2.0, shrink: float = 1.0) -> Additive:
    n, pos = len(y), float(y.sum())
    base = float(np.log((pos + 1) / (n - pos + 1)))
    edges = [_edges(x[:, j], bins) if n else np.zeros(0) for j in range(len(FEATURES))]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not 0 < pos < n:
        return Additive(base, edges, tables, [])
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    f = np.full(n, base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            g, h = gradients()
            step = rate * _shallow_tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), leaves, least, shrink)
            table += step
            f += step[at[j]]
    coarse = [_edges(x[:, j], pair_bins) for j in range(len(FEATURES))]
    bin2 = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    g, h = gradients()
    gains = []
    for i in range(len(FEATURES)):
        for j in range(i):
            cells = bin2[i] * (len(coarse[j]) + 1) + bin2[j]
            gains.append((float((np.bincount(cells, g) ** 2 / (np.bincount(cells, h) + 5 * shrink)).sum()), i, j))
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, _, _, table in pairs:
            g, h = gradients()
            cells = bin2[i] * table.shape[1] + bin2[j]
            sum_g, sum_h = (np.bincount(cells, v, table.size).reshape(table.shape) for v in (g, h))
            # A tree of depth two: the split of one feature, then one of the other on either side of it.
            rows = _shallow_tree(sum_g.sum(1), sum_h.sum(1), 2, least, shrink)
            cut = int(np.flatnonzero(rows != rows[0])[0]) if (rows != rows[0]).any() else len(rows)
            step = np.zeros(table.shape)
            for part in (slice(0, cut), slice(cut, None)):
                if len(sum_g[part]):
                    step[part] = rate * _shallow_tree(sum_g[part].sum(0), sum_h[part].sum(0), 2, least, 5 * shrink)
            table += step
            f += step[bin2[i], bin2[j]]
    return Additive(base, edges, tables, pairs)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, max_rows: int = MAX_ROWS) -> Additive:
    """Fit on the labelled rows whose fold is not 0, at most max_rows of them (those of smallest hash of the id)."""
    chosen = labels.where((common.crc_fold(id_column, folds) != 0) & F.col(label).isNotNull()).select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("__y"))
    chosen = common.smallest_hashes(chosen, "__id", max_rows)
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(common.texts(batch, "__t"))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    # Repeated documents could make the sample larger than max_rows again.
    sample = rows.select("__t", "__y").mapInArrow(run, "y int, x array<double>").orderBy(F.xxhash64("x"), "x", "y").limit(max_rows).collect()
    x = np.array([r["x"] for r in sample]).reshape(len(sample), len(FEATURES))
    return fit(x, np.array([r["y"] for r in sample], dtype=float))


def score(docs: DataFrame, model: Additive, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with __score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema if f.name != "__score" and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [batch.schema.names.index(f.name) for f in fields]
            out = shared.value.score(features(common.texts(batch, text)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(out)], names=[*[batch.schema.names[i] for i in keep], "__score"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return docs.mapInArrow(run, ", ".join([*kept, "`__score` double"]))


def keep_good(docs: DataFrame, model: Additive, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score at least the threshold."""
    plain, (body,) = common.by_place(docs, text)
    return score(plain, model, body).where(F.col("__score") >= threshold).select(*plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_quality: the score of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs, model, keep_text=False)
    return scored.select("doc_id", (common.crc_fold("doc_id", 5) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
