"""Every operator on empty tables, repeated rows and ids, ties, odd vectors, and columns of clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import embeddings, line_dedup, packing, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, node long, label string, ids string, key int, k int"
VECTORS = "vec_id long, embedding array<double>, label string, node long, v string, a long, m long, dim int, shard int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, 3, "l", "x", 4, 5) for i, t, s in rows], DOCS)


def test_line_dedup(spark):
    d = docs(spark, [(1, "a\nb", "h"), (1, "a\nb", "h"), (2, None, "h"), (3, "", None)])
    got = sorted((r.doc_id, r.text or "", r._ts_dropped) for r in line_dedup.drop_boilerplate(d).collect())
    assert got == [(1, "", 2), (1, "", 2), (2, "", 0), (3, "", 0)]  # lines on two of three pages of the host
    assert line_dedup.drop_boilerplate(d.limit(0)).count() == 0 and line_dedup.drop_boilerplate(d).columns[:12] == d.columns


def test_packing(spark):
    d = docs(spark, [(1, "one two", "h"), (1, "one two", "h"), (None, None, "h"), (2, "", "h")])
    n = len(tokens.Encoder(tokens.default_path()).tokenizer.encode("one two", add_special_tokens=False).ids) + 1
    got = packing.pack_documents(d).collect()
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(1, n), (None, 1), (2, 1)} and sum(r.length for r in got) == 2 * n + 2


def test_toxicity_reads_no_other_column(spark):
    d = docs(spark, [(i, f"plain words {i}" + (" vilevile" if i % 2 else ""), "h") for i in range(40)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(0, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, labels)
    got = {r.doc_id: r.s for r in d.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    assert len(got) == 40 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.train(d, labels.limit(0)).scores([None, ""]).tolist() == [0.0, 0.0]


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, lab, 1, "x", 2, 3, 4, 5) for i, v, lab in rows], VECTORS)


def run(d, **kw):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(d, **kw).collect())


def test_embeddings_repeats_ties_and_odd_vectors(vectors):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    big, tiny = [1e308, 1e308, 0.0], [1e-310, 1e-310, 0.0]
    inf, nan = float("inf"), float("nan")
    rows = [(1, one, "a"), (2, one, "a"), (3, one, "b"), (3, two, "b"), (4, big, "c"), (5, tiny, "c"), (6, [0.0] * 3, "c"), (7, None, "c"), (8, [nan, 1.0, 0.0], "c"), (9, [inf, 1.0, 0.0], "c"), (10, [1.0, 1.0], "c"), (11, [1.0, None, 0.0], "c"), (12, one, None)]
    got = run(vectors(rows))
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)] + [(i, 0, i, True) for i in range(6, 13)]
    assert got == want
    assert embeddings.near_duplicates(vectors(rows).limit(0)).count() == 0


def test_embedding_counts_are_alike_from_both_ends(vectors):
    r = np.random.default_rng(5)
    centre = r.normal(size=(6, 12))
    x = np.concatenate([c + 0.12 * r.normal(size=(60, 12)) for c in centre])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.98
    np.fill_diagonal(link, False)
    got = run(vectors([(i, v.tolist(), "a") for i, v in enumerate(x)]), shard_rows=50)
    assert [n for _, n, _, _ in got] == link.sum(1).tolist()
