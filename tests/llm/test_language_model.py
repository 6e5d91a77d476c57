"""The language model's inner steps against plain forms of them."""

from __future__ import annotations

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakejobs.llm import hmm


def plain_counts(model, flat, begins, lengths, first):
    """Forward and backward over a padded matrix, scaled at every time."""
    k, steps = len(model.start), int(lengths.max())
    inside = np.arange(steps)[:, None] < lengths
    symbols = np.where(inside, flat[np.where(inside, begins + np.arange(steps)[:, None], 0)], hmm.END)
    emit, move, start = np.zeros((hmm.SYMBOLS, k)), np.zeros((k, k)), np.zeros(k)
    e, alpha, gamma, scale = model.emit[symbols], np.zeros((steps, len(lengths), k)), np.zeros((steps, len(lengths), k)), np.ones(inside.shape)
    begin = np.where(first[:, None], model.start, hmm.stationary(model.move))
    live = inside.sum(axis=1)
    for t, n in enumerate(live):
        a = (begin if t == 0 else alpha[t - 1, :n] @ model.move) * e[t, :n]
        s = a.sum(axis=1)
        alpha[t, :n], scale[t, :n] = a / s[:, None], s
    beta = np.ones((len(lengths), k))
    gamma[-1, : live[-1]] = alpha[-1, : live[-1]]
    for t in range(steps - 2, -1, -1):
        n, m = live[t], live[t + 1]
        right = e[t + 1, :m] * beta[:m] / scale[t + 1, :m, None]
        move += model.move * (alpha[t, :m].T @ right)
        beta[:m] = right @ model.move.T
        gamma[t, :n] = alpha[t, :n] * beta[:n]
    start += gamma[0][first].sum(axis=0)
    for j in range(k):
        emit[:, j] += np.bincount(symbols.ravel(), gamma[:, :, j].ravel(), hmm.SYMBOLS)
    return [emit, move, start], np.where(inside, np.log(scale), 0).sum(axis=0)


def test_expected_counts_are_those_of_the_plain_recursion_and_cost_less():
    r = np.random.default_rng(3)
    k = hmm.STATES
    model = hmm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), np.ascontiguousarray(r.dirichlet(np.full(hmm.SYMBOLS, 0.3), k).T + 1e-12))
    lengths = np.sort(np.concatenate([np.full(400, hmm.SEGMENT), r.integers(1, hmm.SEGMENT, 300)]))[::-1].copy()
    flat = np.minimum(r.pareto(0.7, int(lengths.sum())) * 5, hmm.SYMBOLS - 1).astype(np.int32)
    begins, first = np.cumsum(lengths) - lengths, r.random(len(lengths)) < 0.3
    room, took = hmm._Room(), {"plain": [], "own": []}
    for _ in range(4):
        began = time.process_time()
        want, likelihood = plain_counts(model, flat, begins, lengths, first)
        took["plain"].append(time.process_time() - began)
        got = [np.zeros((hmm.SYMBOLS, k)), np.zeros((k, k)), np.zeros(k)]
        began = time.process_time()
        hmm.expected_counts_of(model, flat, begins, lengths, *got, first, room)
        took["own"].append(time.process_time() - began)
        for a, b in zip(got, want, strict=True):
            assert a == pytest.approx(b, rel=1e-9, abs=1e-12)
    starts = hmm.forward_of(model, flat, begins[first], lengths[first])
    assert starts == pytest.approx(likelihood[first], rel=1e-11)
    assert min(took["own"]) < 0.85 * min(took["plain"])


@pytest.mark.parametrize("block", [3, 8, 20])
def test_blocks_that_scaling_does_not_divide(monkeypatch, block):
    model = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.full((hmm.SYMBOLS, 2), 1e-20))
    monkeypatch.setattr(hmm, "BLOCK", block)
    lengths = np.array([301, 60, 9, 8, 1])
    got = hmm.forward_of(model, np.zeros(301, dtype=np.int32), np.zeros(5, dtype=int), lengths)
    assert got == pytest.approx(lengths * np.log(1e-20))


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_steps_are_those_of_the_pattern(monkeypatch, kind):
    texts = ["", None, " \t\n\x0b\x0c\r ", "A b  a\tB\n", " É é    x\x1c\x1fy\x00 Z", "w" * 500 + " end", " ".join(f"V{i % 7}" for i in range(300)), "last"]
    monkeypatch.setattr(hmm, "STEP", 64)
    monkeypatch.setattr(hmm.parts_of, "__defaults__", (40,))
    found = {i: Counter() for i in range(len(texts))}
    batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], names=["text"])
    for start, _, parts in hmm.word_steps(batch, "text"):
        for words, code, row in parts:
            for c, n in zip(code, row, strict=True):
                found[start + n][words[c].as_py()] += 1
    for i, t in enumerate(texts):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()
        assert found[i] == Counter(re.findall(rb"[^\x20\x09-\x0D]+", lower))
