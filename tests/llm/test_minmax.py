"""Min-max hashing against all pairs, and its defined cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import prose

from lakejobs.llm import minmax, registry

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def brute(rows, threshold=85, k=5):
    """id -> (set size, component) by an inverted index over shingles."""
    sets, where = {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = {b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        for s in sets[i]:
            where[s].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        common = defaultdict(int)
        for s in sets[i]:
            for j in where[s]:
                common[j] += 1
        for j, both in common.items():
            if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def as_rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"q{r.randrange(10**6)}"
    return " ".join(w)


def test_components_of_the_tables(spark, sf_dir):
    got = registry.QUERIES["op12_minmax_hash"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    assert as_rows(got) == want and got.where("kept <> (doc_id = component_id)").count() == 0
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("crowded", [2, 10, 512])
def test_groups_of_near_copies(spark, monkeypatch, crowded):
    monkeypatch.setattr(minmax, "CROWDED", crowded)
    rows = []
    for g, (words, edits) in enumerate([(150, 1), (150, 2), (200, 4), (400, 6), (90, 2), (12, 1)]):
        base = prose(g, words)
        rows += [(1000 * g + i, edited(base, i, edits if i % 3 else 1)) for i in range(40)]
    base = prose(77, 150)
    rows += [(20_000 + i, edited(base, i, r)) for r in (0, 3, 4, 6) for i in range(r * 100, r * 100 + 25)]  # variants that aren't near each other
    rows += [(30_000 + i, edited(edited(base, 5, 12), i, 1 + i % 2)) for i in range(30)]  # but these are, apart from the rest
    chain = prose(99, 300).split()  # each is near the next only
    for i in range(12):
        chain[20 * i : 20 * i + 2] = [f"x{i}", f"y{i}"]
        rows.append((9000 + i, " ".join(chain)))
    random.Random(1).shuffle(rows)
    assert as_rows(minmax.components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark, odd, none):
    got = minmax.components(odd).collect()
    assert len(got) == odd.count()
    sizes = {(r["doc_id"], r["n_shingles"]) for r in got}
    assert {(None, 1), (None, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 0), (6, 1), (8, 56), (9, 56)} <= sizes
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert by[9] == by[8] == {8} and by[1] == {1} and by[2] == {2} and by[5] == {5} and by[None] == {None}
    kept = minmax.deduplicate(odd).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 10] and all(r["id"] == "extra" for r in kept)
    assert minmax.components(none).count() == 0 and minmax.deduplicate(none).columns == none.columns


def test_both_ends_estimate_the_similarity():
    r = np.random.default_rng(3)
    for j in (0.5, 0.85):
        agree = []
        for _ in range(200):
            h = r.integers(0, 1 << 64, 1000, dtype=np.uint64)
            own = int(1000 * (1 - j) / (1 + j))
            a, b = minmax.signature(h), minmax.signature(np.append(h[own:], r.integers(0, 1 << 64, own, dtype=np.uint64)))
            agree.append((a == b).mean())
            assert (minmax.bands(a) == minmax.bands(b)).sum() == (a == b).reshape(minmax.BANDS, -1).all(axis=1).sum()
        assert abs(np.mean(agree) - j) < 0.02 and np.std(agree) < np.sqrt(j * (1 - j) / (2 * minmax.PERMUTATIONS)) * 1.15
