"""Nulls, empty and long texts, repeated rows, ties, empty tables, clashing columns: each operator's defined results."""

import hashlib
import json
import time

import numpy as np
import pytest
from oracle_rows import plain
from pyspark.sql import functions as F

from lakejobs.llm import common, decontaminate, hmm, htmltext, neighbours, pieces, quality, secrets, simhash, substrings, tokencount


def by_text(rows, value):
    out = {}
    for r in rows:
        out.setdefault(r["text"] or "", set()).add(value(r))
    return out


# -- components


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 7), (7, 5), (20, 21), (21, 20), (30, 30)], "u long, v long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 7: 3, 8: 3, 9: 3, 20: 20, 21: 20}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r["component"] for r in common.connected_components(chain).collect()} == {0}
    assert common.connected_components(edges.where("false")).count() == 0


def test_saved_frames_are_released(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    df = common.saved(spark.range(5).toDF("k"), "x")
    (file,) = {r["f"].rsplit("/", 1)[0] for r in df.select(F.col("_metadata.file_path").alias("f")).collect()}
    folder = file.removeprefix("file:").replace("///", "/")
    import pathlib

    assert pathlib.Path(folder).exists() and spark.conf.get("spark.checkpoint.dir", None) == before
    held = common.saved_names(spark)
    other = common.saved(spark.range(3).toDF("k"), "mine")
    common.release(spark, before=held, keep="mine")
    assert pathlib.Path(folder).exists() and other.count() == 3
    common.release(spark, keep="mine")
    assert not pathlib.Path(folder).exists() and other.count() == 3
    common.release(spark)
    assert not common.saved_names(spark)
    assert common.saved(spark.range(5).toDF("k"), "x").count() == 5


# -- token counts


def test_boundary_rules():
    begin, end = np.array([0, 2, 5, 9]), np.array([2, 5, 9, 10])
    section, crossing = tokencount.allocate(begin, end, np.array([0, 4]), np.array([4, 8]), "most")
    assert section.tolist() == [0, 0, 1, -1] and crossing.tolist() == [False, True, True, False]
    section, _ = tokencount.allocate(begin, end, np.array([0, 4]), np.array([4, 8]), "first")
    assert section.tolist() == [0, 0, 1, -1]
    section, _ = tokencount.allocate(np.array([3]), np.array([7]), np.array([0, 5]), np.array([5, 9]), "most")
    assert section.tolist() == [0]  # two bytes each: the earlier
    section, _ = tokencount.allocate(np.array([0]), np.array([4]), np.array([1]), np.array([9]), "first")
    assert section.tolist() == [-1]
    with pytest.raises(ValueError, match="rule"):
        tokencount.allocate(begin, end, begin, end, "x")


def test_token_counts_of_odd_rows(odd, none):
    out = tokencount.attribute(odd, None)
    for r in out.collect():
        assert sum(s["n_tokens"] for s in r["__counts"]) + r["__outside"] == r["__n_tokens"] and r["__outside"] == 0
        assert (r["__n_tokens"] == 0) == (not r["text"]) and r["id"] == "extra"
    assert tokencount.attribute(none, None).count() == 0


def test_tokens_across_fields(spark):
    df = spark.createDataFrame([("the int", None, "ernational")], "t string, m string, b string")
    text, sections = tokencount.field_sections(["t", "m", "b"], "")
    r = tokencount.attribute(df.select(text.alias("text"), sections.alias("sections"))).first()
    assert [(s["start"], s["end"]) for s in r["__counts"]] == [(0, 7), (7, 7), (7, 17)]
    assert sum(s["n_tokens"] for s in r["__counts"]) == r["__n_tokens"] and sum(s["n_crossing"] for s in r["__counts"]) >= 1
    bad = df.select(F.lit("abcdef").alias("text"), F.expr("array(named_struct('start', 0, 'end', 3), named_struct('start', 2, 'end', 4))").alias("sections"))
    with pytest.raises(Exception, match="overlap"):
        tokencount.attribute(bad).collect()


# -- quality


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(1, 11)] + [(3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["__score"] <= 1 for r in got)
    assert all(len(v) == 1 for v in by_text(got, lambda r: r["__score"]).values())
    empty = quality.train(odd, labels.where("false"))
    assert {r["__score"] for r in quality.score(odd, empty).collect()} == {0.5}
    one = quality.fit(np.zeros((3, len(quality.FEATURES))), np.ones(3))
    assert one.score(np.zeros((1, len(quality.FEATURES)))).tolist() == pytest.approx([0.8])
    assert quality.score(none, model).count() == 0 and quality.keep_good(odd, model).columns == odd.columns


def test_lookup_tables_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and (1, 0) in [(i, j) for i, j, *_ in model.pairs]


# -- language model


def test_the_most_frequent_words_when_counts_tie(spark):
    rows = [(f"w{i}".encode(), 7) for i in range(3000)] + [(b"often", 90_001), (b"more", 90_002), (b"once", 1)]
    df = spark.createDataFrame([(bytearray(w), n) for w, n in rows], "word binary, n long")
    for most in (1, 2, 500, 3002, 3003):
        got = [bytes(r["word"]) for r in df.where(hmm.frequent(df, most)).collect()]
        assert len(got) <= most and (b"more" in got) and (b"often" in got or most < 2)
        assert len(got) > 0.9 * most
    assert df.where("false").where(hmm.frequent(df.where("false"), 5)).count() == 0


def test_a_very_long_text_is_scored_in_parts(spark, monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(300_000)) + " " + "x" * 3_000_000
    df = spark.createDataFrame([(1, text), (2, "w1 w4 w9"), (3, "w1")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in hmm.score(df, F.col("doc_id") == 1).collect()}
    assert got[1]["n_tokens"] == 300_002 and np.isfinite(got[1]["score"]) and got[2]["n_tokens"] == 4
    model = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.full((hmm.SYMBOLS, 2), 1 / hmm.SYMBOLS))
    flat = np.arange(50) % 7
    whole = hmm.forward_of(model, flat, np.array([0, 3]), np.array([40, 11]))
    monkeypatch.setattr(hmm, "BLOCK", 8)
    assert hmm.forward_of(model, flat, np.array([0, 3]), np.array([40, 11])) == pytest.approx(whole)


def test_cuts_add_nothing_to_the_start_counts():
    model = hmm.Model(np.array([0.9, 0.1]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.full((hmm.SYMBOLS, 2), 1 / hmm.SYMBOLS))
    assert hmm.stationary(model.move) == pytest.approx([0.4, 0.6])
    emit, move, start = np.zeros((hmm.SYMBOLS, 2)), np.zeros((2, 2)), np.zeros(2)
    hmm.expected_counts(model, np.zeros((3, 2), dtype=int), np.array([3, 3]), emit, move, start, np.array([True, False]))
    assert start == pytest.approx([0.9, 0.1]) and emit.sum() == pytest.approx(6)
    assert emit[0] == pytest.approx(np.array([0.4, 0.6]) * 3 + sum(np.array([0.9, 0.1]) @ np.linalg.matrix_power(model.move, t) for t in range(3)))


def test_forward_is_the_sum_over_paths():
    r = np.random.default_rng(0)
    model = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.zeros((hmm.SYMBOLS, 2)))
    model.emit[:3] = r.dirichlet(np.ones(3), 2).T
    sequences = [[0, 1, 2, 1], [2], [1, 0]]
    lengths = np.array([4, 2, 1])
    matrix = hmm._matrix(np.array([0, 1, 2, 1, 2, 1, 0]), np.array([0, 5, 4]), lengths)
    got = np.exp(hmm.forward(model, matrix, lengths))

    def brute(seq):
        import itertools

        total = 0.0
        for path in itertools.product((0, 1), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[s, b]
            total += p
        return total

    assert got == pytest.approx([brute(sequences[0]), brute(sequences[2]), brute(sequences[1])])
    emit, move, start = np.zeros((hmm.SYMBOLS, 2)), np.zeros((2, 2)), np.zeros(2)
    hmm.expected_counts(model, matrix, lengths, emit, move, start)
    assert emit.sum() == pytest.approx(7) and move.sum() == pytest.approx(4) and start.sum() == pytest.approx(3)
    assert emit[:3].sum(axis=1) == pytest.approx([2, 3, 2])


def test_scores_of_odd_rows(odd, none):
    got = hmm.score(odd, F.col("doc_id") == 10).collect()
    assert len(got) == odd.count() and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    empty = [r for r in got if r["doc_id"] in (1, 2, 5)]
    assert {r["n_tokens"] for r in empty} == {1} and len({round(r["score"], 9) for r in empty}) == 1
    assert hmm.score(none, F.lit(False)).count() == 0
    untrained = hmm.score(odd, F.lit(True)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and {r["n_known"] for r in untrained} == {0} and {r["base_score"] for r in untrained} == {0.0}


# -- near-duplicates


def test_simhash_of_odd_rows(odd, none):
    got = simhash.components(odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r["__fp"] == 0]
    assert {r["component_id"] for r in zero} == {1} and len(zero) == 4
    assert {r["component_id"] for r in got if r["doc_id"] in (8, 9)} == {8}
    assert sum(r["component_id"] is None for r in got) == 1  # the text whose only row has no id
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted([(False, 1), (False, 3), (False, 3), (False, 4), (False, 6), (False, 7), (False, 8), (False, 10), (True, 0)])
    assert simhash.components(none).count() == 0 and simhash.deduplicate(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_links_lose_no_component(spark, seed):
    r = np.random.default_rng(seed)
    centres = r.integers(-(2**63), 2**63 - 1, 60)
    fps = set(centres.tolist())
    for c in centres[:20].tolist():
        for _ in range(25):
            x = c
            for b in r.choice(64, r.integers(1, 7), replace=False).tolist():
                x ^= 1 << b if b < 63 else -(1 << 63)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f, 1) for f in fps], "fp long, n long")
    got = {x["node"]: x["component"] for x in common.connected_components(simhash.links(nodes)).collect()}
    u = np.array(fps)
    near = np.bitwise_count((u[:, None] ^ u[None, :]).view(np.uint64)) <= 4
    want = {}
    for i in range(len(u)):
        if i not in want:
            todo, group = [i], set()
            while todo:
                k = todo.pop()
                if k not in group:
                    group.add(k)
                    todo += np.flatnonzero(near[k]).tolist()
            want |= {k: int(u[min(group)]) for k in group}
    assert {int(u[k]): v for k, v in want.items()} == {f: got.get(f, f) for f in fps}


def test_crowded_buckets_are_split_without_loss(spark):
    r = np.random.default_rng(7)
    low = r.choice(1 << 16, 300, replace=False).tolist()  # one value in the upper 48 bits, so one bucket holds all
    nodes = spark.createDataFrame([(0x7ABC_0000_0000_0000 | f, 1) for f in low], "fp long, n long")
    found = [common.connected_components(simhash.links(nodes, 2, crowded=c)).collect() for c in (8, 10**6)]
    a, b = ({x["node"]: x["component"] for x in f} for f in found)
    assert a == b and len(a) > 10


def test_allocation_is_the_cheapest():
    p = np.full(64, 0.5)
    groups = [list(range(0, 10)), list(range(10, 30)), list(range(30, 64))]
    cost, chosen = simhash.allocate(10**6, p, groups, 4)
    assert sum(chosen) == 4 - 3 + 1 and min(chosen) >= -1
    import itertools
    from math import comb

    def price(ts):
        return sum(0 if t < 0 else 1e6 * simhash.PROBE_COST * sum(comb(len(g), r) for r in range(t + 1)) + 5e11 * simhash.within(p, g, 4)[t] * simhash.CANDIDATE_COST for g, t in zip(groups, ts, strict=True))

    assert cost == pytest.approx(min(price(t) for t in itertools.product(range(-1, 5), repeat=3) if sum(t) == 2))


# -- secrets


def test_secret_spans_and_owners(spark, none):
    key = "AKIA" + "B" * 16
    rows = [(1, f'é password = "hunter22x" and {key}', "a"), (2, f"{key} {key}", "a"), (3, "token: short secret:token: abcdefgh", "b"), (4, "0123456789abcdef01234567 token=aaaaaaaa", "b"), (5, None, None), (6, "", "c"), (7, "api_key: example123", "a"), (8, "APIKEY='example123'", "b"), (9, "apikey=example123", "c"), (10, "-----BEGIN RSA PRIVATE KEY-----", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.scan(df).select("*", secrets.spans_text(F.col("spans")).alias("s")).collect()}
    assert got[1]["s"] == "assign:2:23,access:29:49" and got[1]["n_live"] == 2
    assert got[2]["s"] == "access:0:20,access:21:41" and got[3]["s"] == "" and got[5]["s"] == "" and got[6]["s"] == ""
    assert got[4]["s"] == "hex:0:24,assign:25:39" and (got[4]["n_live"], got[4]["n_example"]) == (1, 1)
    assert [got[i]["n_example"] for i in (7, 8, 9)] == [1, 1, 1] and got[7]["most_owners"] == 3
    assert got[10]["s"] == "pem:0:31"
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[1] == 'é [SECRET]" and [SECRET]' and clean[7] == "api_key: example123" and clean[5] is None and clean[2] == "[SECRET] [SECRET]"
    assert secrets.redact(df).columns == df.columns and secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0


def test_secrets_of_odd_rows(odd):
    assert secrets.scan(odd).count() == odd.count()
    assert plain(secrets.redact(odd).collect()) == plain(odd.collect())


def test_a_text_of_many_matches(spark):
    text = " ".join(f"token=abc{i:07d}x" for i in range(40_000))
    long = "é🎉" * 3000 + " password: hunter2222 " + "x" * 9000
    edge = "y" * (secrets.CHUNK - 6) + " secret=abcdefgh " + "z" * 100
    df = spark.createDataFrame([(1, text, "a"), (2, long, "b"), (3, edge, "c"), (4, "token=token=abcdefgh1234567", "d")], "doc_id long, text string, source string")
    secrets.scan(df.limit(0)).count()
    began = time.perf_counter()
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(df).collect()}
    assert time.perf_counter() - began < 20  # about 3 s; copies of arrays per match took over 40
    assert [(s["start"], s["end"]) for s in found[1]] == [(18 * i, 18 * i + 17) for i in range(40_000)]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[1] == " ".join(["[SECRET]"] * 40_000) and clean[2] == "é🎉" * 3000 + " [SECRET] " + "x" * 9000
    assert clean[3] == "y" * (secrets.CHUNK - 6) + " [SECRET] " + "z" * 100 and clean[4] == "[SECRET]"


def test_overlapping_spans_are_one_mask(spark):
    df = spark.createDataFrame([(1, "a secret=0123456789abcdef0123456789 b", "s"), (2, "api_key=AKIA" + "Q" * 16 + "AKIA" + "Q" * 16, "t")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()} == {1: "a [SECRET] b", 2: "[SECRET]"}


def test_secret_scan_stays_in_the_engine(odd):
    plan = secrets.scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- benchmark


def test_windows_hits_and_blocks(spark, odd, none):
    passage = "a b c d e f g h i j k l m n o"
    bench = spark.createDataFrame([(1, passage), (2, "Short one"), (3, None), (4, ""), (2, "short ONE"), (None, "no id here")], "item_id long, text string")
    rows = [(1, "x A-b c d e f g h i j k l m; y"), (2, "a b c d e f g h i j k l"), (3, "so short one it is"), (4, None), (5, passage + " " + "w " * 400), (6, "no id here no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (decontaminate.MAX_WORDS, 20):
        got = {r["doc_id"]: r for r in decontaminate.hits(df, bench, max_words=most).collect()}
        assert {r["doc_id"]: r["__n_words"] for r in got.values()} == {1: 15, 2: 12, 3: 5, 4: 0, 5: 415, 6: 6}
        assert {i: [(s["start"], s["end"]) for s in r["__spans"]] for i, r in got.items()} == {1: [(1, 14)], 2: [], 3: [(1, 3)], 4: [], 5: [(0, 15)], 6: [(0, 6)]}
        assert [got[i]["__n_items"] for i in range(1, 7)] == [1, 0, 1, 0, 1, 1] and got[3]["__items"] == [2] and got[6]["__items"] == []
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()) == [2, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench, "span").collect()}
    assert cut[1] == "x ; y" and cut[3] == "so  it is" and cut[4] is None
    assert decontaminate.decontaminate(odd, bench).count() == odd.count() and decontaminate.hits(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.where("false")).columns == odd.columns
    with pytest.raises(ValueError, match="mode"):
        decontaminate.decontaminate(df, bench, "x")


# -- repeated substrings


def spans_of(spark, docs, **knobs):
    df = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(docs)], "id long, row long, text string")
    out = substrings.removals(df, **knobs)
    return {r["row"]: substrings._merged(r["spans"]) for r in out.collect()}


def brute_spans(docs, length):
    order = sorted(range(len(docs)), key=lambda n: (docs[n][0] is None, docs[n][0] or 0, n))
    seen, out = set(), {}
    for n in order:
        t = (docs[n][1] or "").encode()
        found = []
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                found.append({"start": p, "end": p + length})
            seen.add(w)
        if found:
            out[n] = substrings._merged(found)
    return out


@pytest.mark.parametrize("hot", [1, 128])
def test_removals_against_brute_force(spark, hot):
    r = np.random.default_rng(5)
    word = lambda n: "".join(r.choice(list("abé "), n))
    shared, edge = word(300), word(120)
    docs = [(5, word(200) + shared), (3, shared[:150] + word(50)), (9, shared + shared), (None, word(30) + shared[100:]), (3, edge), (4, edge), (7, "ab" * 300), (8, None), (10, ""), (11, "x" * 99), (12, "x" * 99), (13, "x" * 101)]
    docs += [(20 + i, word(40) + edge + word(40)) for i in range(12)]
    assert spans_of(spark, docs, hot=hot, hot_anchor=hot * 3) == brute_spans(docs, 100)


def test_removals_are_by_segment_too(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 256)
    text = hashlib.sha256(b"x").hexdigest() * 30
    docs = [(1, text[:700]), (2, text[64:900] + "tail"), (3, "z" + text)]
    out = []
    hasher = substrings._Hasher(4096)
    for n, (_, t) in enumerate(docs):
        for part in substrings._segments([t.encode()], 100):
            owner, anchor, body, at, first, last = substrings.runs(hasher, part)
            out.append((n, sorted(zip(at.tolist(), first.tolist(), last.tolist(), strict=True))))
            assert all(f <= a <= f + 68 for a, f in zip(at, first, strict=True))
    covered = {n: set() for n in range(3)}
    for n, runs in out:
        for _, a, b in runs:
            covered[n] |= set(range(a, b + 1))
    assert all(covered[n] == set(range(len(t) - 99)) for n, (_, t) in enumerate(docs))
    assert spans_of(spark, docs) == brute_spans(docs, 100)


def test_report_when_the_splits_of_the_scan_change(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(9)
    shared = "".join(r.choice(list("abcd "), 300))
    texts = [(i, "".join(r.choice(list("abcd "), 20 * (i + 1))) + (shared if i % 3 == 0 else "")) for i in range(24)]
    for i, row in enumerate(texts):
        spark.createDataFrame([row], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents"))
    key = "spark.sql.files.minPartitionNum"
    real, splits = common.saved, iter([1, 24] * 50)

    def saved(df, label):
        out = real(df, label)
        spark.conf.set(key, str(next(splits)))
        return out

    monkeypatch.setattr(common, "saved", saved)
    try:
        spark.conf.set(key, "24")
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in substrings.report(spark.read.parquet(str(tmp_path / "documents"))).collect()}
    finally:
        spark.conf.unset(key)
    want = brute_spans(texts, 100)
    assert got == {i: (len(t), sum(b - a for a, b in want.get(i, ()))) for i, t in texts}


def test_deduplicated_texts(odd, none):
    out = substrings.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    got = {(r["doc_id"], r["score"]): r["text"] for r in out.collect()}
    assert got[9, 12] == "" and got[8, 11] != "" and got[1, 2] is None and len(got[6, 9]) < 300
    assert substrings.deduplicate(none).count() == 0 and substrings.report(none).count() == 0


# -- pieces


def test_pieces_of_odd_rows(odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.PieceModel.load()
    coded = pieces.encode(odd, model, check=True)
    for r in coded.collect():
        assert r["__ids"] == sp.encode(r["text"] or "") and r["__same"] and r["id"] == "extra"
    back = pieces.decode(coded.withColumn("ids", F.col("__ids")), model)
    assert all((a["text"] or "") == (b["text"] or "") for a, b in zip(odd.orderBy("score").collect(), back.orderBy("score").collect(), strict=True))
    assert pieces.encode(none, model).count() == 0
    with pytest.raises(Exception, match="not of this model"):
        pieces.decode(odd.select(F.array(F.lit(10**6)).alias("ids")), model).collect()
    assert {r["text"] for r in pieces.decode(odd.select(F.lit(None).cast("array<int>").alias("ids")), model).collect()} == {None}


def test_units_alone_and_by_matrix_agree(monkeypatch):
    model = pieces.PieceModel.load()
    texts = ["internationalisation", "aaaaaaaaaaaaaaaa", "thethethethe-the", "éèêé ünïcode", "x   y    z"]
    ids, sizes = model.encode(texts)
    monkeypatch.setattr(pieces, "LONG", 0)
    other = pieces.PieceModel.load()
    ids2, sizes2 = other.encode(texts)
    assert ids.tolist() == ids2.tolist() and sizes.tolist() == sizes2.tolist()


def test_bpe_paths_are_what_merging_makes():
    """Against the merges themselves, best rank first, leftmost of equals."""
    model = pieces.PieceModel.load()
    pairs = dict(zip(model.pair_keys.tolist(), model.pair_ranks.tolist(), strict=True))
    names = {i: p for p, i in model.by_text.items()}

    def merged(nodes):
        while True:
            ranks = [pairs.get(a * model.nodes + b, 1 << 40) for a, b in zip(nodes, nodes[1:], strict=False)]
            if not ranks or min(ranks) == 1 << 40:
                return nodes
            k = ranks.index(min(ranks))
            nodes = [*nodes[:k], model.by_text[names[nodes[k]] + names[nodes[k + 1]]], *nodes[k + 2 :]]

    r = np.random.default_rng(3)
    made = sorted(model.by_text.values())
    a, b = r.choice(made, 3000), r.choice(made, 3000)
    want = [merged([model.by_text[c] for c in names[x] + names[y]]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert model._apart(a, b).tolist() == want == [model._two_apart(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)] and 0.05 < np.mean(want) < 1
    words = ["".join(r.choice(list("aeinorst"), r.integers(2, 14))) for _ in range(500)]
    ids, sizes = model.encode(words)
    for w, n, end in zip(words, sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
        assert ids[end - n : end].tolist() == merged([model.by_text[c] for c in "▁" + w])


def test_a_very_long_unit_is_encoded():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.PieceModel.load()
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("etaoinshr"), 200_000)), "ab" * 150_000, "é日🎉" * 1000]
    ids, sizes = model.encode(texts)
    assert ids.tolist() == [i for t in texts for i in sp.encode(t)] and model.decode(ids, sizes) == texts


def test_the_kind_is_that_of_the_model_file(tmp_path):
    raw = open(pieces.MODEL, "rb").read()
    at = raw.rindex(b"tok_v0\x18\x02")
    path = tmp_path / "unigram.model"
    path.write_bytes(raw[:at] + b"tok_v0\x18\x01" + raw[at + 8 :])
    assert (pieces.PieceModel.load(pieces.MODEL).kind, pieces.PieceModel.load(str(path)).kind) == ("bpe", "unigram")


def test_viterbi_paths_are_the_best():
    import sentencepiece

    raw = open(pieces.MODEL, "rb").read()
    at = raw.rindex(b"tok_v0\x18\x02")
    unigram = raw[:at] + b"tok_v0\x18\x01" + raw[at + 8 :]  # the same pieces read as a unigram model
    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram)
    model = pieces.PieceModel.from_bytes(unigram, sp, "unigram")
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(259, sp.get_piece_size())}

    def best(text):
        found = [0.0]
        for end in range(1, len(text) + 1):
            found.append(max(found[a] + score[text[a:end]] for a in range(end) if text[a:end] in score))
        return found[-1]

    texts = ["the", "international", "Erthenanreedsh.", "unwh thble", "é 日本", "   x"]
    ids, sizes = model.encode(texts)
    at = 0
    for t, n in zip(texts, sizes, strict=True):
        own, at = ids[at : at + n].tolist(), at + n
        assert sum(model.scores[own]) == pytest.approx(best("▁" + t.replace(" ", "▁"))) and sp.decode(own) == t
    ids, sizes = model.encode(["a\nb🎉"])
    assert model.decode(ids, sizes) == ["a\nb🎉"]


# -- pages


@pytest.fixture(scope="module")
def field():
    slots = htmltext._Slots()
    return htmltext.fit([(htmltext.observations(f, slots), y) for f, y in htmltext.seed_labels()])


def test_seed_pages_are_learnt(field):
    slots = htmltext._Slots()
    pages = htmltext.seed_pages()
    assert np.mean([htmltext.main_text(p, field, slots) == t for p, t in pages]) > 0.95


def test_pages_without_sectioning_elements_are_learnt(spark):
    body = "<h1>Title {0}</h1>" + "".join(f"<p>Sentence {k} of page {{0}} has some words, and it ends here.</p>" for k in range(6))
    page = "<html><body><nav><a href='/a'>Home</a> <a href='/b'>News</a></nav><header><p>Site {0}</p></header><article>" + body + "</article><aside><p>More</p></aside><footer><p>&copy; {0}</p></footer></body></html>"
    df = spark.createDataFrame([(i, page.format(i)) for i in range(60)], "page_id long, html string")
    model = htmltext.train(df)
    bare = htmltext.without_hints(page.format(77))
    assert "<article" not in bare and "<nav" not in bare
    want = "\n".join(["Title 77", *[f"Sentence {k} of page 77 has some words, and it ends here." for k in range(6)]])
    slots = htmltext._Slots()
    assert htmltext.main_text(page.format(77), model, slots) == want and htmltext.main_text(bare, model, slots) == want
    assert htmltext.examples("<article><p>a</p></article>" + "<p>b</p>" * (htmltext.MAX_BLOCKS + 1), slots) == []


def test_blocks():
    page = "<p>a<br>b&amp;c &copy<div>d<script>var x='</p>'</script><!-- no --> e</div><ul><li>f<li>g</ul>h <i>i</i>\n j<textarea><p>k</textarea><p"
    assert [b.text for b in htmltext.blocks(page)] == ["a b&c ©", "d", "e", "f", "g", "h i j", "<p>k"]  # a form's text is a block, labelled drop
    assert htmltext.blocks("") == [] and htmltext.blocks("<<<") != None  # noqa: E711
    assert [b.text for b in htmltext.blocks("plain &lt;text&gt;")] == ["plain <text>"]
    assert [tuple(t for t, _ in b.path) for b in htmltext.blocks("<p>a<p>b</p></b>c")] == [("p",), ("p",), ()]


def test_viterbi_is_the_best_of_all_paths(field):
    import itertools

    slots = htmltext._Slots()
    found = htmltext.observations(htmltext.blocks(htmltext.seed_pages()[3][0]), slots)[:9]
    p = field.potentials(found)

    def value(path):
        return field.start[path[0]] + sum(p[i, y] for i, y in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:], strict=False))

    assert value(field.decode(found)) == pytest.approx(max(value(x) for x in itertools.product((0, 1), repeat=len(found))))


def test_odd_pages(spark, field):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<html>"), (4, "u", "<article><h1>T</h1><p>" + "word " * 50_000 + "</p></article>"), (4, "u", "<article><p>T</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [r["__text"] for r in htmltext.extract(df, field).collect()]
    assert got[:3] == ["", "", ""] and got[3].startswith("T\nword word") and len(got[3]) == 2 + 250_000 - 1
    assert htmltext.extract(df.where("false"), field).count() == 0
    assert isinstance(htmltext.train(df.where("false")), htmltext.Field)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><meta a=b><body><p>one</p><p>two</p></body></html>", ["one", "two"]),
        ("<head><script>x</script><style>y</style><link a=b><p>one</p>", ["one"]),
        ("<head><noscript><link a=b></noscript><title>t</title></head><p>one</p>", ["one"]),
        ("<head><title>t</title>bare text<p>one</p>", ["bare text", "one"]),
        ("<article><p>one <svg width='1'/> two</p><p>three</p></article>", ["one", "two", "three"]),
        ("<article><p>one <math/> two</p><svg><title/><path d='x'/></svg><p>three</p></article>", ["one", "two", "three"]),
        ("<div><svg><path d='x'><p>one</p><p>two</p></div>", ["one", "two"]),
        ("<p>a<math><mi>x</mi></math></p><noscript><p>b</p></noscript><object>c</object><canvas>d</canvas><textarea>e &lt; <b></textarea><iframe>f</iframe>", ["a", "x", "b", "c", "d", "e < <b>", "f"]),
        ("<p>a</p><script>b</script><style>c</style><template><p>d</p></template><!-- e --><p>f</p>", ["a", "f"]),
    ],
)
def test_blocks_lose_nothing_else(page, want):
    assert [b.text for b in htmltext.blocks(page)] == want


# -- neighbours


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (3, [0.5, 0.5]), (11, [1.0, 2.0, 3.0]), (12, [-3.0, 4.0])]
    df = spark.createDataFrame([(i, x, "e") for i, x in rows], "vec_id long, embedding array<float>, rank string")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("id") % 20 == 0, k=3).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (20, 1, 12, 4.0), (20, 2, 3, 0.5), (20, 3, 0, 0.0)]
    assert neighbours.nearest(df.where("false"), F.col("id") % 20 == 0).count() == 0
    alone = neighbours.nearest(df.where("vec_id = 0"), F.col("id") % 20 == 0)
    assert alone.count() == 0


def test_a_dense_cluster_is_one_of_many(spark, monkeypatch):
    """A third of the vectors nearly alike: all planes have them on one side, so one leaf holds them all."""
    monkeypatch.setattr(neighbours, "LEAF", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    r = np.random.default_rng(11)
    x = np.concatenate([r.standard_normal(16) + 0.02 * r.standard_normal((400, 16)), r.standard_normal((800, 16))]).astype(np.float32)
    recall = neighbour_recall(spark, x, list(range(1, 1201)))
    assert np.mean(list(recall.values())) >= 0.9 and np.mean([v for q, v in recall.items() if q <= 400]) >= 0.9


def test_many_equal_vectors(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.col("id") / 1000, F.lit(0.5))).cast("array<float>").alias("embedding"))
    got = neighbours.nearest(df, F.col("id") % 20 == 0).where("query_id = 60").orderBy("rank").collect()
    assert [r["id"] for r in got] == [3 * i for i in range(21) if 3 * i != 60]


def test_iterations_raise_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    x = np.random.default_rng(2).standard_normal((900, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -2)
    recall = np.mean([len(got[q] & set(np.argsort(-s[q])[:20].tolist())) / 20 for q in range(0, 900, 20)])
    assert recall > 0.95


def neighbour_recall(spark, x, ids):
    """Recall at 20 against brute force, by query; each query must have 20 rows."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    out = {}
    for at, q in enumerate(ids):
        if q % 20 == 0:
            s = x.astype(float) @ x[at].astype(float)
            s[at] = -np.inf
            assert len(got.get(q, ())) == 20, (q, len(got.get(q, ())))
            out[q] = len(set(got[q]) & {ids[i] for i in np.argsort(-s)[:20]}) / 20
    return out


def test_lone_vectors_and_small_far_groups_are_found(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 10)
    r = np.random.default_rng(4)
    line = r.standard_normal(16) + np.linspace(-1, 1, 1000)[:, None] * r.standard_normal(16) + 0.001 * r.standard_normal((1000, 16))  # all planes split it alike
    far = np.concatenate([5 * r.standard_normal((1, 16)) + 0.01 * r.standard_normal((m, 16)) for m in (1, 1, 1, 4, 12)])
    x = np.concatenate([line, far])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = [*range(1, 1001), *range(2000, 2000 + 20 * len(far), 20)]
    recall = neighbour_recall(spark, x, ids)
    assert np.mean([recall[i] for i in ids[1000:]]) >= 0.9 and np.mean(list(recall.values())) >= 0.9


def test_a_search_goes_on_while_nodes_are_open(spark):
    raw = lambda x: neighbours._packed_vectors(np.array([[np.cos(x), np.sin(x)]]))[0].as_py()
    nodes = spark.createDataFrame([(i, bytearray(raw(i / 10))) for i in range(12)], "node long, v binary")
    graph = spark.createDataFrame([(i, [j for j in (i - 1, i + 1) if 0 <= j < 12]) for i in range(12)], "node long, neighbours array<long>")
    queries = spark.createDataFrame([(0, 0, bytearray(raw(1.1)))], "query long, node long, w binary")
    assert {r["node"] for r in neighbours.search(graph, nodes, queries, 1 << 40).collect()} == set(range(12))


def test_packed_vectors_keep_directions_of_any_norm():
    x = np.random.default_rng(7).standard_normal((50, 16)) * 10.0 ** np.arange(-25, 0, 0.5)[:, None] / 16
    column = neighbours._packed_vectors(x)
    got = neighbours._matrix(column, 50, last=False)
    assert np.allclose(got / np.linalg.norm(x, axis=1)[:, None], x / np.linalg.norm(x, axis=1)[:, None], atol=5e-4)
    every = neighbours._matrix(column, 50)
    assert every.shape == (50, 17) and np.allclose((every * every).sum(axis=1), 1, atol=1e-5)


def test_small_vectors_reach_large_ones(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    r = np.random.default_rng(6)
    x = np.concatenate([r.standard_normal((800, 8)), 1e-3 * r.standard_normal((200, 8))]).astype(np.float32)
    recall = neighbour_recall(spark, x, list(range(1, 1001)))
    assert np.mean([v for q, v in recall.items() if q > 800]) >= 0.9


def test_a_query_with_too_few_rows_is_scored_against_all(spark, monkeypatch):
    x = np.random.default_rng(8).standard_normal((200, 4)).astype(np.float32)
    monkeypatch.setattr(neighbours, "search", lambda graph, nodes, queries, *a: queries.select("query", "node"))
    assert set(neighbour_recall(spark, x, list(range(200))).values()) == {1.0}


def test_texts_of_megabytes(spark):
    """A text of 5 MB of prose, its near copy, and one of half a MB without white space, through every operator."""
    r = np.random.default_rng(12)
    words = "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were".split()
    prose = " ".join(np.array(words)[r.integers(0, len(words), 1_300_000)].tolist())
    block = "".join(np.array(list("etaoinshrdlu"))[r.integers(0, 12, 500_000)].tolist())
    rows = [(1, prose, "a"), (2, prose + " end", "b"), (3, block, "c"), (4, "short text", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4, "doc_id")
    assert len(prose) > 4_500_000
    counts = {r["doc_id"]: r for r in tokencount.attribute(df, None, keep_text=False).collect()}
    assert counts[1]["__n_tokens"] >= 1_300_000 and sum(c["n_tokens"] for c in counts[3]["__counts"]) == counts[3]["__n_tokens"]
    model = quality.train(df, spark.createDataFrame([(2, 1), (3, 0), (4, 1)], "doc_id long, quality int"))
    assert quality.score(df, model, keep_text=False).count() == 4
    scores = {r["doc_id"]: r for r in hmm.score(df, F.col("doc_id") == 2).collect()}
    assert scores[1]["n_tokens"] == 1_300_001 and scores[3]["n_tokens"] == 2 and all(np.isfinite(r["score"]) for r in scores.values())
    assert {r["doc_id"]: r["component_id"] for r in simhash.components(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: len(r["spans"]) for r in secrets.scan(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    bench = spark.createDataFrame([(1, " ".join(prose.split(" ")[1000:1040])), (2, "short text")], "item_id long, text string")
    hit = {r["doc_id"]: (r["__n_words"], r["__spans"][0]["start"] if r["__spans"] else None) for r in decontaminate.hits(df, bench).drop("text").collect()}
    assert hit == {1: (1_300_000, 1000), 2: (1_300_001, 1000), 3: (1, None), 4: (2, 0)}
    removed = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in substrings.report(df).collect()}
    assert removed[2] == (len(prose) + 4, len(prose)) and removed[1] == (len(prose), 0) and removed[3] == (500_000, 0)
    coded = pieces.encode(df.where("doc_id <> 2"), pieces.PieceModel.load(), keep_text=False, check=True).collect()
    assert all(r["__same"] for r in coded)
    page = spark.createDataFrame([(1, "<nav><a href='/'>menu</a></nav><article><p>" + prose + "</p></article>" + "<p>x</p>" * 20_000)], "page_id long, html string")
    slots = htmltext._Slots()
    field = htmltext.fit([(htmltext.observations(f, slots), y) for f, y in htmltext.seed_labels()[:80]])
    assert prose in htmltext.extract(page, field).first()["__text"] and htmltext.train(page) is not None


def test_names_that_operators_use_may_clash(spark, odd):
    """Columns of the operators' own names: kept where the input's columns come back, else replaced by what is added."""
    own = "__row __id __y __t __score __spans __items __n_words __n_items __n_hit __contaminated __ids __same __counts __outside __n_tokens __text __fp __hits row row_ hits spans cuts none text_ c0 c1 fp node x v".split()
    df = odd.select("*", *[F.concat(F.lit(f"{n} "), F.col("score").cast("string")).alias(n) for n in own])
    same = lambda out, source: plain(out.collect()) == plain(source.collect())
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(1, 11)], "doc_id long, quality int")
    model = quality.train(df, labels)
    every = quality.keep_good(df, model, threshold=0.0)
    assert every.columns == df.columns and same(every, df)
    scored = quality.score(df, model)
    assert len(scored.columns) == len(df.columns) and all(0 <= r["__score"] <= 1 for r in scored.collect())
    assert same(simhash.deduplicate(df).select("doc_id", *own), df.join(simhash.deduplicate(df).select("__row"), "__row", "left_semi").select("doc_id", *own))
    assert simhash.components(df).count() == df.count() and secrets.scan(df).count() == df.count()
    assert same(secrets.redact(df), df)
    deduplicated = substrings.deduplicate(df)
    assert deduplicated.columns == df.columns and same(deduplicated.drop("text"), df.drop("text")) and substrings.report(df).count() == df.count()
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "item_id long, text string")
    for most in (100, 4):
        found = decontaminate.hits(df, bench, max_words=most)
        assert sorted(found.columns) == sorted(df.columns) and {len(r["__spans"]) for r in found.collect()} == {0}
    assert same(decontaminate.decontaminate(df, bench), df) and same(decontaminate.decontaminate(df, bench, "span"), df)
    coded = pieces.encode(df, pieces.PieceModel.load(), check=True)
    assert len(coded.columns) == len(df.columns) and all(r["__same"] is True for r in coded.collect())
    counted = tokencount.attribute(df, None)
    assert len(counted.columns) == len(df.columns) and all(sum(c["n_tokens"] for c in r["__counts"]) == r["__n_tokens"] for r in counted.collect())
    assert hmm.score(df, F.col("doc_id") == 10).count() == df.count()
    slots = htmltext._Slots()
    field = htmltext.fit([(htmltext.observations(f, slots), y) for f, y in htmltext.seed_labels()[:40]])
    assert len(htmltext.extract(df, field, column="text").columns) == len(df.columns)


def test_json_of_the_odd_rows_is_stable(odd):
    assert json.dumps([r["score"] for r in odd.orderBy("score").collect()]) == json.dumps(list(range(odd.count())))


def test_smallest_hashes_are_those_of_a_full_sort(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    want = [r["k"] for r in df.orderBy(F.xxhash64("k"), "k").limit(20).collect()]
    assert [r["k"] for r in common.smallest_hashes(df, "k", 20).collect()] == want
    assert common.smallest_hashes(df, "k", 5000).count() == 1000 and common.smallest_hashes(df.where("false"), "k", 5).count() == 0
