"""Queries with DuckDB SQL, and whole-table queries against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from oracle_rows import same_rows

from lakejobs.llm import registry

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def documents(spark, sf_dir):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_are_those_of_the_oracle(spark, duck, sf_dir, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLES[name])


def test_simhash_components(spark, sf_dir):
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_simhash"](spark, sf_dir).collect()}
    prints = {}
    for i, t in documents(spark, sf_dir):
        w = t.translate(ASCII_LOWER).split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                counts[b] += h >> b & 1
        prints[i] = sum((2 * c > len(shingles)) << b for b, c in enumerate(counts))
    ids = sorted(prints)
    component = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and component[b] > component[a]:
                    component[b], changed = component[a], True
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", component[i]) for i in ids}


def removed(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        mark = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                mark[p : p + length] = True
            seen.add(w)
        out[i] = mark
    return out


def test_suffix_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    marks = removed(docs)
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_suffix_dedup"](spark, sf_dir).collect()}
    for i, t in docs:
        m = marks[i]
        kept = bytes(b for b, x in zip(t, m, strict=False) if not x)
        spans = int((m[1:] & ~m[:-1]).sum() + m[0])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), int(m.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_hmm_base_and_model(spark, sf_dir):
    docs = documents(spark, sf_dir)
    count, ends = Counter(), 0
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(t.translate(ASCII_LOWER).split())
            ends += 1
    total, distinct = sum(count.values()) + ends, len(count) + 1
    got = {r["doc_id"]: r for r in registry.QUERIES["op3_hmm_scoring"](spark, sf_dir).collect()}
    gain = []
    for i, t in docs:
        w = t.translate(ASCII_LOWER).split()
        base = sum(log10((c + 1) / (total + distinct + 1)) for c in [*(count[x] for x in w), ends])
        r = got[i]
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["n_tokens"] == len(w) + 1
        assert r["n_known"] == sum(count[x] > 0 for x in w) + 1 and r["train_tokens"] == total
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"]) / r["n_tokens"])
    assert np.mean(gain) > 0.1


def test_hmm_scores_by_plain_recursion(spark, sf_dir, monkeypatch):
    """The model that the query trains, applied word by word: emissions, classes and counts taken anew from the texts."""
    from lakejobs.llm import hmm

    seen = {}
    real = hmm.train

    def train(encoded, words, *a, **kw):
        seen["words"], seen["model"] = words, real(encoded, words, *a, **kw)
        return seen["model"]

    monkeypatch.setattr(hmm, "train", train)
    docs = documents(spark, sf_dir)
    got = {r["doc_id"]: r["score"] for r in registry.QUERIES["op3_hmm_scoring"](spark, sf_dir).collect()}
    model, own = seen["model"], {w: i for w, i in seen["words"].known.items() if i < hmm.OWN}
    assert model.emit.sum(axis=0) == pytest.approx(1) and model.move.sum(axis=1) == pytest.approx(1) and model.start.sum() == pytest.approx(1)
    count = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(t.translate(ASCII_LOWER).split())
    weight = Counter()
    for w, c in count.items():
        if w not in own:
            weight[zlib.crc32(w[-4:]) % hmm.CLASSES] += c + 1
    for i, t in docs:
        a, total = None, 0.0
        for w in [*t.translate(ASCII_LOWER).split(), None]:
            if w is None:
                symbol = hmm.END
            elif w in own:
                symbol = own[w]
            else:
                k = zlib.crc32(w[-4:]) % hmm.CLASSES
                symbol = hmm.OWN + k
                total += log10((count[w] + 1) / (weight[k] + 1))
            a = (model.start if a is None else a @ model.move) * model.emit[symbol]
            total += log10(a.sum())
            a = a / a.sum()
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_quality_by_plain_features_and_tables(spark, sf_dir):
    """Features character by character, the same fit, and scores summed table by table."""
    from bisect import bisect_right
    from math import exp, log1p, sqrt

    from lakejobs.llm import quality

    space, symbols = b" \t\n\v\f\r", b"#$%&*+/<=>@[\\]^_`{}~"

    def features(t):
        words, lines = t.split(), t.split(b"\n")
        n, w = max(len(t), 1), max(len(words), 1)
        has = lambda chars: sum(b in chars for b in t)
        upper, lower, high = sum(65 <= b < 91 for b in t), sum(97 <= b < 123 for b in t), sum(b >= 128 for b in t)
        mean = sum(map(len, words)) / w
        known = upper + lower + high + sum(48 <= b < 58 for b in t) + has(space) + has(symbols) + has(b"|") + has(b"!") + has(b".?") + has(b",;:")
        return [
            log1p(len(words)), mean, sqrt(max(sum(len(x) ** 2 for x in words) / w - mean**2, 0)), len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
            len(set(lines)) / len(lines), log1p(len(words) / len(lines)), upper / max(upper + lower + high, 1), sum(48 <= b < 58 for b in t) / n, has(space) / n, has(symbols) / n,
            has(b"|") / n, has(b"!") / n, has(b".?") / n, has(b",;:") / n, (len(t) - known) / n, high / n,
            sum(65 <= x[0] < 91 for x in words) / w, sum(x[-1] in b".?" for x in words) / w, sum(x[-1] in symbols + b"!|" for x in words) / w,
        ]

    docs = documents(spark, sf_dir)
    x = {i: features(t) for i, t in docs}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    rows = sorted((x[i], y) for i, y in labels if i in x and zlib.crc32(str(i).encode()) % 5)
    model = quality.fit(np.array([r for r, _ in rows]), np.array([y for _, y in rows], dtype=float))
    got = {r["doc_id"]: r["score"] for r in registry.QUERIES["op2_quality"](spark, sf_dir).collect()}
    for i, f in x.items():
        raw = model.base + sum(table[bisect_right(edges.tolist(), v)] for v, edges, table in zip(f, model.edges, model.tables, strict=True))
        raw += sum(table[bisect_right(a.tolist(), f[j]), bisect_right(b.tolist(), f[k])] for j, k, a, b, table in model.pairs)
        assert got[i] == pytest.approx(1 / (1 + exp(-raw)), abs=1e-4)


def test_sentencepiece_ids_are_those_of_the_library(spark, sf_dir):
    import sentencepiece

    from lakejobs.llm.pieces import MODEL

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = dict(documents(spark, sf_dir))
    for r in registry.QUERIES["op8_sentencepiece"](spark, sf_dir).collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]].decode()) and r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_token_counts_add_up(spark, sf_dir):
    from lakejobs.llm.tokencount import encoder, read_ranks

    coder, _ = encoder(read_ranks())
    by_doc = {}
    for r in registry.QUERIES["op1_token_counts"](spark, sf_dir).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in documents(spark, sf_dir):
        text = t.decode()
        lines = sorted(by_doc[i], key=lambda r: r["section"])
        spans, at = [], 0
        for line in text.split("\n"):
            spans.append((at, min(at + len(line) + 1, len(text))))
            at = spans[-1][1]
        spans = [s for s in spans if s[0] < s[1]]
        assert [(r["start"], r["end"]) for r in lines if r["section"] >= 0] == spans
        ends = np.cumsum([len(text[a:b].encode()) for a, b in spans])
        want, place = [0] * len(spans), 0
        for token in coder.encode_ordinary(text):
            n = len(coder.decode_single_token_bytes(token))
            shared = [min(place + n, e) - max(place, b) for b, e in zip([0, *ends[:-1]], ends, strict=True)]
            want[shared.index(max(shared))] += 1
            place += n
        assert [r["n_tokens"] for r in lines if r["section"] >= 0] == want and lines[0]["doc_tokens"] == sum(want)


def test_html_texts(spark, sf_dir):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in registry.QUERIES["op9_html_extraction"](spark, sf_dir).collect():
        page = pages[r["page_id"]]
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<br>|</?b>", " " if "<br>" else "", p)).split()) for p in re.split("</?(?:p|h1)>", article.replace("<b>", "").replace("</b>", ""))]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_nearest_neighbours_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows}
    got = {}
    for r in registry.QUERIES["op10_nearest_neighbours"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
    hits = total = 0
    for q in (i for i in x if i % 20 == 0):
        best = sorted((i for i in x if i != q), key=lambda i: (-(x[q] @ x[i]), i))[:20]
        assert sorted(got[q]) == list(range(1, len(best) + 1))
        hits += len(set(best) & {v for v, _ in got[q].values()})
        total += len(best)
    assert hits / total >= 0.9


def test_quality_on_held_out_labels(spark, sf_dir):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_quality"](spark, sf_dir.replace("0.001", "0.01")).collect()}
    held = [(got[i]["score"], y) for i, y in label.items() if got[i]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
