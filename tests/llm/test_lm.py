"""The recurrent language model: gradients, whole-document scores, counts and base scores, held-out texts, edges."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import gru, lm
from tesserae.llm.gru import SIZE, UNITS, Gru, windows


@pytest.fixture
def model():
    r = np.random.default_rng(1)
    m = Gru.start(r.integers(1, 50, SIZE + 5), SIZE)
    for p in m.parts():
        p += (r.normal(size=p.shape) * 0.3).astype(np.float32)
    return m


def test_gradients(model):
    r = np.random.default_rng(2)
    docs = [r.integers(0, SIZE + 5, n) for n in (5, 9, 3, 14)]
    x, y, fresh, live = next(windows(docs, 0, 3, lambda k: 16))
    h0 = np.zeros((x.shape[1], UNITS), np.float32)
    _, found = model.gradients(x, y, fresh, live, h0)
    found, at = np.concatenate([g.ravel() for g in found]), model.vector().astype(np.float64)

    def loss(v):
        parts, k = [], 0
        for p in model.parts():
            parts.append(v[k : k + p.size].reshape(p.shape))
            k += p.size
        m = Gru(*parts)
        return -m.output(m.states(x, fresh, h0, False)[0].reshape(-1, UNITS), y.ravel(), live.ravel(), False)[0].sum()

    for i in r.choice(np.flatnonzero(found), 60, replace=False):
        step = np.zeros(len(at))
        step[i] = 1e-3
        assert (loss(at + step) - loss(at - step)) / 2e-3 == pytest.approx(found[i], abs=5e-3, rel=2e-2)


def test_scores_are_those_of_each_document_alone(model):
    """One token at a time, in plain loops, against lanes and windows."""
    r = np.random.default_rng(3)
    docs = [r.integers(0, SIZE + 5, n) for n in (1, 700, 40, 1, 3, 2500, 64)]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def alone(d):
        h, before, total = np.zeros(UNITS), 0, 0.0
        for y in d:
            g, a = model.e[before].astype(float) @ model.x + model.a, h @ model.u
            reset, update = sigmoid(g[:UNITS] + a[:UNITS]), sigmoid(g[UNITS : 2 * UNITS] + a[UNITS : 2 * UNITS])
            new = np.tanh(g[2 * UNITS :] + reset * a[2 * UNITS :])
            h, before = (1 - update) * new + update * h, y
            k = 0 if y < SIZE else 1 + y - SIZE
            p = np.exp(h @ model.v + model.c)
            total += math.log(p[k] / p.sum())
            if y < SIZE:
                q = np.exp(h @ model.w[0] + model.b[0])
                total += math.log(q[y] / q.sum())
        return total

    got = model.scores(docs, 0, lanes=3)
    assert got == pytest.approx([alone(d) for d in docs], rel=1e-4)
    everything = model.scores([np.array([a, b]) for a in range(SIZE + 5) for b in range(SIZE + 5)], 0)
    assert np.exp(everything).sum() == pytest.approx(1, abs=1e-4)  # probabilities of all texts of two symbols


def test_learning_lowers_the_loss():
    r = np.random.default_rng(4)
    docs = [np.tile(np.arange(SIZE, SIZE + 4), 30)[k % 4 :] for k in range(200)] + [r.integers(0, SIZE, 50) for _ in range(20)]
    m = Gru.start(np.bincount(np.concatenate(docs), minlength=SIZE + 4), SIZE)
    before = m.scores(docs, 0).sum()
    for _ in range(4):
        m.learn(docs, 0, 0.01, 16)
    assert m.scores(docs, 0).sum() > 0.6 * before


def words(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold)), "\n"]


def check(rows, got):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows)
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:-1] for x in have] == [x[:-1] for x in want]
    assert [x[-1] for x in have] == pytest.approx([x[-1] for x in want], rel=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_counts_base_scores_and_edges(spark):
    rows = [(i, f"The cat{i % 7} sat\ton THE mat {i} é.") for i in range(90)] + [(None, "a\x85b  c"), (3, None), (3, ""), (3, ""), (4, "x " * 5000), (5, " \n"), (6, "y" * 100 + " z")] + [(i, "y" * 100 + " z") for i in range(600, 640)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("w", F.lit(1)).repartition(3)
    check(rows, lm.score_documents(d).collect())
    assert lm.score_documents(d.limit(0)).count() == 0
    held = d.where(lm.held_out())
    check([x for x in rows if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 7 == 2], lm.score_documents(held).collect())


def test_small_head_leaves_the_rest_to_the_join(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 0)
    rows = [(i, f"some words w{i % 5} {i}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    known = lm.Vocabulary(lm.count_words(d), head=70)
    assert 0 < len(known.words) <= 70 and known.symbols == SIZE // SIZE * (len(known.words) // SIZE) * SIZE
    check(rows, lm.score_documents(d).collect())


def test_held_out_documents_of_the_table_score_above_the_base(spark):
    d = "/root/testdata/sf0.001"
    got = lm.op13_gru_scores(spark, d).collect()
    check([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.08 * sum(r.n_tokens for r in held)


def test_both_ways_to_tell_a_tail(spark):
    import pyarrow as pa

    some = ["a", "é", "ab", "word,", "日本", "\n", "x" * 50]
    got = spark.createDataFrame([(w,) for w in some], "w string").select(lm._tail(F.col("w")).alias("t")).collect()
    assert [r.t for r in got] == lm._tails(pa.array(some)).tolist()


def test_windows_are_sorted_by_16_bit_keys(monkeypatch):
    """numpy sorts these by radix, and wider ones by merging."""
    model, keys, sort = gru.Gru.start(np.arange(140) + 1, 128), [], np.argsort
    x = np.random.default_rng(3).integers(0, 140, (8, 4))
    live = np.ones((8, 4), bool)
    live[6:, 3] = False
    fresh = np.zeros((8, 4), bool)
    fresh[0] = True
    monkeypatch.setattr(gru.np, "argsort", lambda a, **how: keys.append(a.dtype) or sort(a, **how))
    model.gradients(x, x[::-1], fresh, live, np.zeros((4, gru.UNITS), np.float32))
    assert len(keys) == 2 and all(k == np.uint16 for k in keys)
