"""Whitening of embeddings by polarisation covariance.

Entries c become whole numbers x = floor(SCALE * c) + SHIFT. One pass takes n and the sums S of every dimension, in whole
numbers. The next centres before it multiplies: y = x - m, m the whole number next to S / n, and adds up the squares of
every y_i and of every sum y_i + y_j of two dimensions; both are whole numbers, so the sums are exact in any order and for
any partitioning. What m leaves, r = S - n * m, is taken off exactly: n * sum(y_i^2) - r_i^2 is n^2 times the variance of
dimension i, n * sum((y_i + y_j)^2) - (r_i + r_j)^2 that of the sum of i and j, and half of the difference between the
variance of the sum and both variances is the covariance. Each is divided once, which is rounded once. The matrix is D x D
and is decomposed on the driver (eigh); D is the vectors' length, whatever the number of rows.

Tasks add up what they read and give one row per cell at their end: D * (D + 1) / 2 rows a task, combined before the
shuffle, and as many at the driver. Squares are added as upper and lower halves in 64 bits; rows that could leave them are
added as Python numbers. Nothing else leaves the tasks.

Defined cases: null vectors, vectors with null or non-finite entries and vectors shorter than the longest (their missing
entries count as null) take no part; repeated rows and ids count and are returned each, null ids too; x beyond 64 bits
stays at the bound; a deviation beyond 64 bits is null. Components without variance (eigenvalue up to 1e-12 of the
largest) have explained as it is, null whitened values and no share in identity_error. Ties of eigenvalues stand as eigh
gives them. Other columns of any name are kept by whiten(). An empty table, or one without such vectors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows that one numpy step works on.
ROWS = 4096
_LONG = (1 << 63) - 1
#: Digits of a sum that travel in one row.
_DIGITS = 15


def vectors(df: DataFrame, column: str, into: str) -> DataFrame:
    """The rows that take part, with x, an array of longs, in a column more."""
    v = F.col(column)
    ok = df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    longest = ok.agg(F.max(F.size(v))).first()[0] or 0

    def whole(c: Column) -> Column:
        return F.least(F.floor(c.cast("double") * SCALE), F.lit(_LONG - SHIFT)) + SHIFT

    return ok.where(F.size(v) == longest).withColumn(into, F.transform(v, whole))


def _matrices(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of ROWS rows at most, with their x as a matrix."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _exact(columns: np.ndarray) -> list[int]:
    """The sums of the columns of longs, up to 2^30 rows."""
    high, low = (columns >> 32).sum(axis=0), (columns & 0xFFFFFFFF).sum(axis=0)
    return [(h << 32) + n for h, n in zip(high.tolist(), low.tolist(), strict=True)]


def _gathered(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], list[int] | None]) -> dict[int, int]:
    """run gives a task's exact sums by cell; the sums over all tasks. Numbers of any size travel in digits."""

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, place, value = [], [], []
        for i, s in enumerate(run(batches) or []):
            sign, left, k = (-1 if s < 0 else 1), abs(s), 0
            while left or not k:
                left, digit = divmod(left, 10**_DIGITS)
                cell.append(i), place.append(k), value.append(sign * digit)
                k += 1
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.int64())], names=["cell", "place", "value"])

    rows = df.mapInArrow(digits, "cell int, place int, value long").groupBy("cell", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v"))
    out: dict[int, int] = {}
    for r in rows.collect():
        out[r["cell"]] = out.get(r["cell"], 0) + int(r["v"]) * 10 ** (_DIGITS * r["place"])
    return out


def totals(xs: DataFrame) -> tuple[int, list[int]]:
    """n, and S of each dimension. xs: one column, arrays of longs of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> list[int] | None:
        n, sums = 0, None
        for _, x in _matrices(batches):
            n, part = n + len(x), _exact(x)
            sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        return [n, *sums] if n else None

    found = _gathered(xs, run)
    return found.pop(0, 0), [found[i] for i in sorted(found)]


def squares(xs: DataFrame, middle: list[int]) -> dict[int, int]:
    """Sums of squares of y_i and of y_i + y_j, i < j, by row of the upper triangle: y = x - middle."""
    d = len(middle)
    small = 1 << 30  # y_i + y_j stays in 32 bits, its square in 64

    def run(batches: Iterator[pa.RecordBatch]) -> list[int] | None:
        high, low, rest, n = np.zeros(d * (d + 1) // 2, np.int64), np.zeros(d * (d + 1) // 2, np.int64), [0] * (d * (d + 1) // 2), 0
        for _, x in _matrices(batches):
            big = (np.abs(x.astype(np.float64) - np.array(middle, dtype=np.float64)) >= small).any(axis=1)
            y = (x[~big] - np.array(middle, dtype=np.int64)).T.copy()
            at = 0
            for i in range(d):
                both = y[i:] + y[i]
                both[0] = y[i]
                both *= both
                high[at : at + d - i] += (both >> 32).sum(axis=1)
                low[at : at + d - i] += (both & 0xFFFFFFFF).sum(axis=1)
                at += d - i
            for row in x[big].tolist():
                y, at = [a - b for a, b in zip(row, middle, strict=True)], 0
                for i in range(d):
                    for j in range(i, d):
                        rest[at] += (y[i] + (y[j] if j > i else 0)) ** 2
                        at += 1
            n += x.shape[0]
            if n >> 29:  # the halves are emptied long before they could overflow
                rest, n = [r + (h << 32) + k for r, h, k in zip(rest, high.tolist(), low.tolist(), strict=True)], 0
                high[:], low[:] = 0, 0
        return [r + (h << 32) + k for r, h, k in zip(rest, high.tolist(), low.tolist(), strict=True)]

    return _gathered(xs, run)


def covariances(n: int, sums: list[int], middle: list[int], found: dict[int, int]) -> tuple[np.ndarray, float]:
    """The covariance matrix of x, divisor n, and its trace, from the sums of squares."""
    d = len(sums)
    left = [s - n * m for s, m in zip(sums, middle, strict=True)]
    cells = iter(range(d * (d + 1) // 2))
    spread = {(i, j): n * found.get(next(cells), 0) - (left[i] + (left[j] if j > i else 0)) ** 2 for i in range(d) for j in range(i, d)}
    out = np.zeros((d, d))
    for (i, j), both in spread.items():
        out[i, j] = out[j, i] = both / (n * n) if i == j else (both - spread[i, i] - spread[j, j]) / (2 * n * n)
    return out, sum(spread[i, i] for i in range(d)) / (n * n)


@dataclass(frozen=True)
class Whitening:
    n: int
    #: S, and the whole numbers next to S / n.
    sums: list[int]
    middle: list[int]
    #: By falling eigenvalue: eigenvalues, and unit eigenvectors as columns.
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        return self.values > 1e-12 * max(self.values.max(initial=0.0), 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of rows of x; not-a-number for components without variance."""
        centred = (x - np.array(self.middle, dtype=np.int64)).astype(np.float64) if np.abs(x).max(initial=0) < 1 << 61 else x.astype(np.float64) - np.array(self.middle, dtype=np.float64)
        centred -= np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, self.middle, strict=True)])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable, (centred @ self.axes) / np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2 of each row, exactly; None beyond 64 bits."""
        rough = x.astype(np.float64) * self.n - np.array(self.sums, dtype=np.float64)
        if np.abs(x.astype(np.float64) * self.n).max(initial=0) < 2.0**62 and (rough * rough).sum(axis=1).max(initial=0) < 2.0**62:
            z = x * self.n - np.array(self.sums, dtype=np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v <= _LONG else None for v in exact]


def fit(xs: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of vectors (one column, x); None if there are none."""
    n, sums = totals(xs)
    if not n:
        return None
    middle = [(2 * s + n) // (2 * n) for s in sums]
    matrix, trace = covariances(n, sums, middle, squares(xs, middle))
    values, axes = np.linalg.eigh(matrix)
    k = min(components, len(sums))
    return Whitening(n, sums, middle, values[::-1][:k].copy(), axes[:, ::-1][:, :k].copy(), trace)


def identity_error(xs: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the usable components."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches):
            w = np.nan_to_num(model.project(x))
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k, dtype=np.int32)), pa.array(np.append(first, second.ravel()))], names=["cell", "value"])

    sums = np.zeros(k + k * k)
    for r in xs.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("v")).collect():
        sums[r["cell"]] = r["v"]
    mean, second = sums[:k] / model.n, sums[k:].reshape(k, k) / model.n
    off = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(model.usable, model.usable)]
    return float(off.max(initial=0.0))


def apply(df: DataFrame, model: Whitening, column: str) -> DataFrame:
    """df (rows as vectors() gives them, x in column) with __deviation and __whitened in place of x."""
    kept = [f for f in df.schema if f.name != column]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, at):
            w = model.project(x)
            white = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel(), mask=np.isnan(w.ravel())))
            own = [part.column(i) for i in range(part.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(model.deviation(x), pa.int64()), white], names=[*[f.name for f in kept], "__deviation", "__whitened"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return df.mapInArrow(run, ", ".join([*fields, "`__deviation` long", "`__whitened` array<double>"]))


def whiten(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The rows of df that take part, all their columns, with __deviation and __whitened, and the model."""
    plain, (v,) = common.by_place(df, column)
    found = vectors(plain, v, "x")
    model = fit(found.select("x"), components)
    if model is None:
        none = plain.where(F.lit(False)).select("*", F.lit(None).cast("long"), F.lit(None).cast("array<double>"))
        return none.toDF(*df.columns, "__deviation", "__whitened"), None
    return apply(found, model, "x").toDF(*df.columns, "__deviation", "__whitened"), model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_whitening: a row for each vector that takes part and each component."""
    df = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out, model = whiten(df)
    error = identity_error(vectors(df, "embedding", "x").select("x"), model) if model else 0.0
    explained = F.array(*[F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values]) if model else F.array(F.lit(0.0))
    out = out.select("vec_id", "__deviation", F.posexplode("__whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), F.col("__deviation").alias("deviation"), "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
