"""The pipeline against a brute-force version of each stage on its own input."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lakejobs.llm import common, decontaminate, pieces, quality, secrets, simhash


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.saved(stage(spark, out[-1], sf_dir), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_are_in_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_what_scores(spark, sf_dir, stages):
    model = quality.train(stages[0], common.table(spark, sf_dir, "labels"))
    want = {i for i, t in texts(stages[0]).items() if model.score(quality.features([t.encode()]))[0] >= quality.THRESHOLD}
    assert set(texts(stages[1])) == want and len(want) > 100


def test_near_duplicates_leave_one_of_each_group(stages):
    before, after = texts(stages[1]), set(texts(stages[2]))
    ids = sorted(before)
    fp = {}
    for i in ids:
        w = before[i].encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        bits = np.array([[xxhash.xxh64_intdigest(s, 42) >> b & 1 for b in range(64)] for s in shingles]).reshape(-1, 64).sum(axis=0) * 2 > len(shingles)
        fp[i] = sum(1 << b for b in range(64) if bits[b])
    component = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if component[b] > component[a] and (fp[a] ^ fp[b]).bit_count() <= simhash.MAX_DISTANCE:
                    component[b], changed = component[a], True
    assert after == set(component.values())


def test_contaminated_documents_go(spark, sf_dir, stages):
    items = [decontaminate.words((r["text"] or "").encode()) for r in common.table(spark, sf_dir, "benchmark").collect()]
    windows = {tuple(w[k : k + min(13, len(w))]) for w in items if w for k in range(len(w) - min(13, len(w)) + 1)}
    want = set()
    for i, t in texts(stages[2]).items():
        w = decontaminate.words(t.encode())
        hit = {p for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(i)
    assert set(texts(stages[3])) == want


def test_live_secrets_are_masked(spark, stages):
    before, after = texts(stages[3]), texts(stages[4])
    found = {r["doc_id"]: r for r in secrets.scan(stages[3]).collect()}
    for i, t in before.items():
        assert (after[i] == t) == (found[i]["n_live"] == 0)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())
    again = secrets.scan(stages[4]).agg(F.sum("n_live")).first()[0]
    assert again == 0


def test_tokens_decode_to_the_texts(stages):
    model = pieces.PieceModel.load()
    back = pieces.decode(stages[5].drop("text"), model)
    assert texts(back) == texts(stages[4])


def test_run_is_the_stages_in_a_row(spark, sf_dir, stages):
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: r["ids"] for r in stages[5].collect()}
