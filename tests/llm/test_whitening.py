"""Whitening against plain arithmetic, and its defined cases."""

from fractions import Fraction

import numpy as np
import pytest

from lakejobs.llm import registry, whitening


def test_whitened_vectors_of_the_tables(spark, sf_dir):
    got = registry.QUERIES["op13_whitening"](spark, sf_dir).toPandas()
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x = np.floor(np.array([rows[i] for i in ids]) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes[:, :32] / np.sqrt(values[:32])
    white = got.pivot(index="vec_id", columns="component", values="whitened")
    assert white.index.tolist() == ids and white.columns.tolist() == list(range(1, 33)) and len(got) == 32 * n
    white = white.to_numpy()
    assert np.allclose(white * np.sign(white[0]), want * np.sign(want[0]), atol=1e-8)
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values[:32] / values.sum(), rtol=1e-9)
    assert got.groupby("vec_id").deviation.first().tolist() == ((n * x - s) ** 2).sum(axis=1).tolist()


def test_sums_of_squares_are_exact(spark):
    r = np.random.default_rng(0)
    x = [[int(v) for v in row] for row in r.integers(-(1 << 20), 1 << 20, (500, 5))] + [[1 << 50, 3, -(1 << 40), 0, 7]]
    df = spark.createDataFrame([(row,) for row in x], "x array<long>").repartition(3)
    n, sums = whitening.totals(df)
    assert n == 501 and sums == [sum(c) for c in zip(*x, strict=True)]
    middle = [round(s / n) for s in sums]
    matrix, trace = whitening.covariances(n, sums, middle, whitening.squares(df, middle))
    for i in range(5):
        for j in range(5):
            exact = sum(Fraction(n * a[i] - sums[i]) * (n * a[j] - sums[j]) for a in x) / n**3
            assert matrix[i, j] == float(exact)
    assert trace == pytest.approx(np.trace(matrix), rel=1e-15)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(i % 3), float(i * i % 5), 1.0], f"e{i}", 0.5) for i in range(12)]
    odd = [(None, [2.0, 1.0, 1.0], "n", 0.1), (3, [0.0, 4.0, 1.0], "again", None), (50, None, "x", 0.0), (51, [], "x", 0.0), (52, [1.0, None, 2.0], "x", 0.0), (53, [1.0, inf, 2.0], "x", 0.0), (54, [nan, 1.0, 2.0], "x", 0.0), (55, [1.0, 2.0], "short", 0.0)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>, x string, __whitened double")
    out, model = whitening.whiten(df)
    got = out.toDF("vec_id", "embedding", "x", "old", "__deviation", "__whitened").collect()
    assert model.n == len(got) == 14 and {r["vec_id"] for r in got} == {None, *range(12)} and {r["old"] for r in got} == {0.5, 0.1, None}
    assert all(r["__whitened"][2] is None and r["__whitened"][0] is not None for r in got)  # the third dimension never varies
    assert whitening.identity_error(whitening.vectors(df, "embedding", "q").select("q"), model) < 1e-9
    none, model = whitening.whiten(df.where("false"))
    assert model is None and none.count() == 0 and none.columns[-2:] == ["__deviation", "__whitened"]
    one, model = whitening.whiten(df.where("vec_id = 1"))
    assert [(r[-2], r[-1]) for r in one.collect()] == [(0, [None] * 3)] and model.trace == 0


def test_vectors_beyond_longs(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<double>")
    out, model = whitening.whiten(df)
    got = {r["vec_id"]: r for r in out.collect()}
    assert model.n == 3 and got[1]["__deviation"] is None and all(np.isfinite(r["__whitened"][0]) for r in got.values())


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.QUERIES["op13_whitening"](spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
