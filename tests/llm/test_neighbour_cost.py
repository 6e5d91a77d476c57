"""What a search of nearest neighbours moves and scores."""

import numpy as np
from pyspark.sql import functions as F

from lakejobs.llm import neighbours


def test_equal_vectors_search_once(spark, monkeypatch):
    asked = []

    def search(graph, nodes, queries, *a):
        asked.append(queries.count())
        return queries.select("query", "node")

    monkeypatch.setattr(neighbours, "search", search)
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(200)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 10 == 0, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert asked == [1]  # 20 queries, all of one vector
    assert sorted(got) == list(range(0, 200, 10)) and got[0] == [(2, 1.0), (4, 1.0), (6, 1.0)] and got[40] == [(0, 1.0), (2, 1.0), (4, 1.0)]


def test_only_what_may_be_among_the_best_is_scored_again(spark):
    x = np.random.default_rng(3).standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    raw = [bytearray(v) for v in neighbours._packed_vectors(x).to_pylist()]
    nodes = spark.createDataFrame(list(enumerate(raw)), "node long, v binary")
    graph = spark.createDataFrame([(i, [j for j in range(60) if j != i]) for i in range(60)], "node long, neighbours array<long>")
    queries = spark.createDataFrame([(i, i, raw[i]) for i in range(0, 60, 5)], "query long, node long, w binary")
    got = {}
    for r in neighbours.search(graph, nodes, queries, 60, 6).collect():
        got.setdefault(r["query"], set()).add(r["node"])
    for q in range(0, 60, 5):
        s = x @ x[q]
        least = np.sort(s)[-6]
        assert set(np.flatnonzero(s >= least)) <= got[q] <= set(np.flatnonzero(s >= least - 2 * neighbours.ROUNDING))


def test_two_old_members_of_a_list_are_not_compared():
    x = np.random.default_rng(4).standard_normal((5, 4))
    members = np.zeros(5, dtype=neighbours._member_type(4))
    members["b"], members["f"], members["t"] = np.arange(5), [1, 0, 0, 0, 1], -2
    members["v"] = np.frombuffer(b"".join(neighbours._packed_vectors(x / 9).to_pylist()), dtype=members.dtype["v"])
    pairs = {(int(e["a"]), int(e["b"])) for e in np.concatenate(list(neighbours._compared(members)))}
    assert pairs == {(a, b) for a in range(5) for b in range(5) if a != b and (a in (0, 4) or b in (0, 4))}


def test_no_edges_and_falling_scores():
    assert len(neighbours._best(np.zeros(0, dtype=neighbours._EDGE), 3, 1)) == 0
    s = np.array([0.5, -0.25, 0.0, 1.0, -1.0], dtype=np.float32)
    assert np.argsort(neighbours._falling(s)).tolist() == [3, 0, 2, 1, 4]
