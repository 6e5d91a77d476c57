"""Periodic runs against a plain search of all periods, and their defined cases."""

import hashlib
import random
import time
import zlib

import pytest
from conftest import prose

from lakejobs.llm import periodic, registry


def brute(w):
    """(start, period, length) of all runs: every period, smallest first."""
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, q, length))
            i = j
    return sorted(out)


def changed(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = changed(doc_id, (text or "").encode().split())
    runs = brute(w)
    best = min(((-length, s, q) for s, q, length in runs), default=None)
    drop = {i for s, q, length in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    head = (len(runs), best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (0, None, None, None, None)
    return (*head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def some_words(r):
    n, kinds = r.choice([0, 1, 3, 11, 12, 13, 30, 100, 300]), r.choice([1, 2, 2, 3, 8, 50])
    w = [b"w%d" % r.randrange(kinds) for _ in range(n)]
    if r.random() < 0.6 and n > 20:
        i, p = r.randrange(n), r.randrange(1, 1 + n // 3)
        w = w[:i] + (w[i : i + p] * 50)[: n - i]
    return w + w if r.random() < 0.3 else w


def test_runs_of_the_tables(spark, sf_dir):
    got = registry.QUERIES["op11_periodic_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", *COLUMNS] and {t for c, t in got.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    short = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len((r["text"] or "").split()) < 3000]
    assert len(short) > 150 and all(rows[r["doc_id"]] == expected(r["doc_id"], r["text"]) for r in short)
    assert sum(v[0] for v in rows.values()) > 20


@pytest.mark.parametrize(("small", "first"), [(6, 10), (4, 4), (5, 2)])
def test_documents_and_tiles_agree(monkeypatch, small, first):
    monkeypatch.setattr(periodic, "SMALL", small)
    monkeypatch.setattr(periodic, "FIRST", first)
    r = random.Random(small)
    docs = [some_words(r) for _ in range(150)]

    def runs(rows):
        best = {}
        for q, low, high in rows:
            if high - low >= max(q, 12 - q):
                best[low, high - low + q] = min(best.get((low, high - low + q), q), q)
        return sorted((s, q, length) for (s, length), q in best.items())

    for w, found in zip(docs, periodic.solve_short([periodic._numbers(w) for w in docs]), strict=True):
        assert runs([(f["q"], f["low"], f["high"]) for f in found]) == brute(w)
        x, rows = periodic._numbers(w), []
        for octaves, a, z, own, last in periodic.tiles(len(x)):
            rows += periodic.solve_tile(x[a:z], octaves, a, own, last)
        import numpy as np

        _, rows = periodic.stitched(np.zeros(len(rows), dtype=np.int64), np.array(rows, dtype=np.int64).reshape(-1, 3))
        assert runs(rows.tolist()) == brute(w)


def test_long_documents_are_stitched_from_tiles(spark, monkeypatch):
    monkeypatch.setattr(periodic, "TILE", 64)
    r = random.Random(11)
    rows = [(i, b" ".join(some_words(r)).decode()) for i in range(60)] + [(100, " ".join(["a b a b c"] * 300)), (101, "x " * 900)]
    monkeypatch.setattr(periodic, "FIRST", 3)
    out = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {x["doc_id"]: [(a["start"], a["period"], a["length"]) for a in x["__runs"] or []] for x in out.collect()}
    assert got == {i: brute(t.split()) for i, t in rows}


def test_odd_rows(spark, odd, none, tmp_path):
    got = periodic.periodic_runs(odd, "text", "doc_id", periodic.repeated_tail)
    assert got.columns == ["doc_id", "source", "id", "score", "__n", "__runs", "__collapsed", "__sha"] and got.count() == odd.count()
    texts = {r["score"]: (r["doc_id"], r["text"]) for r in odd.collect()}
    for r in got.collect():
        i, t = texts[r["score"]]
        assert r["__sha"] == expected("" if i is None else i, t)[-1] and r["id"] == "extra"
    assert periodic.periodic_runs(none).count() == 0
    rows = [("a", "one two " * 8 + "three", 1), ("b", "one  two\nthree", 2), (None, None, 3), ("c", " \t", 4)]
    df = spark.createDataFrame(rows, "q string, text string, words int")
    kept = {r["words"]: r["text"] for r in periodic.collapse(df).collect()}
    assert kept == {1: "one two three", 2: "one  two\nthree", 3: None, 4: " \t"} and periodic.collapse(df).columns == df.columns
    spark.createDataFrame([(None, None), (7, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    empty = hashlib.sha256(b"").hexdigest()
    got = registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_runs"], r["start"], r["runs_sha256"], r["collapsed_sha256"]) for r in got) == [(0, 0, None, empty, empty), (7, 0, None, empty, empty)]


def test_a_text_of_a_million_words(spark):
    began = time.time()
    text = prose(1, 30_000) + " " + "same " * 60_000 + prose(2, 40_000) + " " + " ".join([prose(3, 250_000)] * 3)
    (got,) = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    found = [(r["start"], r["period"], r["length"]) for r in got["__runs"]]
    assert (30_000, 1, 60_000) in found and (130_000, 250_000, 750_000) in found and got["__n"] == 880_000
    assert len(got["__collapsed"].split()) <= 30_000 + 1 + 40_000 + 250_000 and time.time() - began < 120
