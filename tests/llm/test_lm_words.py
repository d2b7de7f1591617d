"""Tokens cut by Arrow against plain Python, and scores against double precision."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wordloom.llm import lm_score
from wordloom.llm.lm_score import Model, Vocabulary, coded, log_probabilities, padded, tokens


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("together", [40, 1 << 22])
def test_coded_texts_are_their_tokens(monkeypatch, kind, together):
    monkeypatch.setattr(lm_score, "TOGETHER", together)
    rnd = random.Random(2)
    texts = ["", None, "  ", " a  B ", "\x1c x\x1d\x1f", "\x85 y z w　", "a\tB\nC\x0bD\x0cE\rF", "É ÀB", "\x00 q\x00", "x" * 500]
    texts += ["".join(rnd.choice(" \t\n\x0b\x0c\rabAB\x1c\x85é \x00") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    for part in (texts, [], [None], texts[:1]):
        got = [[known[i] for i in c] for known, codes in coded(pa.array(part, kind)) for c in codes]
        assert got == [tokens(None if t is None else t.encode()) for t in part]
    got = [[known[i] for i in c] for known, codes in coded(pa.array(texts, kind)[3:9]) for c in codes]
    assert got == [tokens(t.encode()) for t in texts[3:9]]


def test_words_are_counted_in_training_texts(monkeypatch):
    monkeypatch.setattr(lm_score, "TOGETHER", 4)
    rows = [(i, t) for i, t in enumerate(["a b", "", None, "B  c", " a", "long words here", "a"] * 9)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["id", "text"])
    found: Counter[bytes] = Counter()
    for b in lm_score._count_words(7, 2)(iter([batch, batch.slice(0, 0)])):
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found[w] += n
    want = Counter(w for i, t in rows if not lm_score.held_out(i, 7, 2) for w in tokens((t or "").encode()))
    assert found == want
    assert sum(b.num_rows for b in lm_score._count_words(7, 2)(iter([batch.slice(0, 0)]))) == 0


@pytest.mark.parametrize("work", ["count", "number"])
def test_a_batch_is_not_copied_whole(monkeypatch, work):
    """What is held besides a batch depends on the size of a piece, not on that of the batch."""
    monkeypatch.setattr(lm_score, "TOGETHER", 1 << 14)
    texts = pa.array([None, *(f"{i} " + "some words of a text " * 100 for i in range(3000))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], names=["id", "text"])
    usual = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    try:
        n = sum(b.num_rows for b in lm_score._count_words(7, 2)(iter([batch]))) if work == "count" else sum(len(c) for _, c in coded(texts))
    finally:
        pa.set_memory_pool(usual)
    assert n > 2500 and texts.nbytes > 6_000_000 and pool.max_memory() < 1_500_000


def test_own_words_need_no_python_rows(spark, monkeypatch):
    """No job of the fit goes through plain Python rows, whose workers would stay beside those of Arrow."""
    docs = spark.createDataFrame(pa.table({"doc_id": range(200), "text": [f"a b c d{i % 7} e{i}" for i in range(200)]}))
    made, plain = [], spark.sparkContext.parallelize
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a, **k: made.append(a) or plain(*a, **k))
    fitted = lm_score.fit(docs, least=2, own=50, warm=100)
    assert not made and fitted.vocabulary.own > 5


@pytest.mark.parametrize(("scale", "quick"), [(0.4, True), (30.0, False)])
def test_scores_of_rare_words_need_no_second_pass(monkeypatch, scale, quick):
    """A bias of -22, as a rare class has, doesn't make a score big; vectors of great length do."""
    flags = []
    plain = lm_score._log_sum
    monkeypatch.setattr(lm_score, "_log_sum", lambda s, small: flags.append(bool(small)) or plain(s, small))
    rng = np.random.default_rng(4)
    counts = {f"w{i}".encode(): 4000 // (i + 1) + 1 for i in range(300)}
    v = Vocabulary(counts, sum(counts.values()), 300, 300, 1, 8)
    classes = v.classes()
    m = Model.start(np.ones(308), classes, 24, 1)
    for k in ("context", "token", "group"):
        setattr(m, k, rng.normal(0, scale, getattr(m, k).shape).astype(np.float32))
    m.context *= 3
    m.bias[:] = rng.uniform(-22, -1, len(m.bias))
    m.offset[:] = rng.uniform(-22, -1, len(m.offset))
    m.offset[-8:] = -22
    flat, real = padded([rng.integers(0, 308, 900), rng.integers(0, 308, 5000)], 0)
    got = log_probabilities(m, v, flat, real)
    h = m.contexts(flat).astype(np.float64)[real[3:]]
    t = flat[3:][real[3:]]
    want = []
    for x, k in zip(h, t):
        s = m.group.astype(np.float64) @ x + m.offset
        p = s[classes[k]] - np.logaddexp.reduce(s)
        if k < v.own:
            lo, hi = v.edges[classes[k]], v.edges[classes[k] + 1]
            s = m.token[lo:hi].astype(np.float64) @ x + m.bias[lo:hi]
            p += s[k - lo] - np.logaddexp.reduce(s)
        want.append(p / np.log(10))
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4) and all(flags) == quick
