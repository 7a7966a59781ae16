"""Near-duplicate components against plain Python, on copies of a template whose similarity lies around the threshold."""

import re

import numpy as np
import pytest

from tesserae.llm import near_dedup

SPACE = "[^\\x20\\x09-\\x0D]+"


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(SPACE, lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def components(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus():
    r = np.random.default_rng(5)
    template, out = [f"t{k}" for k in range(160)], []
    for k in range(120):  # a chain of changes, and copies of the template with up to a fifth of it replaced
        w = list(template)
        for at in r.choice(150, r.integers(0, 8), replace=False):
            w[at] = f"x{k}y{at}"
        out.append(" ".join(w[: r.integers(120, 161)]))
    short = ["a b c d e", "A  B\tc d e", "a b c", "a b c", "", None, "\n", "ü Ü", "a b c d e f g h", "a b c d e f g i", "one two three four five six seven eight nine ten eleven"]
    return out + short + out[:5] + [f"w{k} same line of five words and more of them" for k in range(30)]


@pytest.mark.parametrize("percent", [85, 80])
def test_components_are_those_of_all_pairs(spark, percent):
    texts = dict(enumerate(corpus()))
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == components(texts, percent)


def test_query_on_the_whole_table(spark):
    from __spark_entry__ import queries

    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries()["op3_minhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got == components(texts, 85)


def test_names_of_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)], "doc_id long, text string, id long, n long, node long")
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(df).collect()) == [(1, 2, 1, True), (2, 2, 1, False)]
