"""The divergence audit against plain Python, whatever the sketch, and its edges."""

import re
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import divergence as dv


def terms_of(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))


def plain(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", terms_of(text)) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == lang]
        df = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        v = len(kept)
        count = {s: Counter(t for _, x, ts in mine if x == s for t in ts if df[t] >= min_docs) for s in {x[1] for x in mine}}
        share = lambda c, n, t: 1 + 10**9 * (c.get(t, 0) + 1) // (n + v)  # noqa: E731, B023
        p = {s: {t: share(c, sum(c.values()), t) for t in kept} for s, c in count.items()}
        every = sum(count.values(), Counter())
        q = {t: share(every, sum(every.values()), t) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or k <= top:
                        out.append((lang, s, part, item, value, k))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    common, rare = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)], ["Zürich", "été", "ABC", "x", "ｆｕｌｌ", "Ж"]
    text = lambda: " ".join(r.choice(common + rare, int(r.integers(0, 30)))) + "! 12_3 O'Neil"
    out = [(f"l{r.integers(0, 2)}", f"s{r.integers(0, 5)}", text()) for _ in range(120)]
    return out + [("l0", "s1", out[0][2])] * 30 + [(None, None, "a b"), (None, "s", None), ("l9", "only", "one two"), ("l9", None, ""), ("l1", "bare", None)]


@pytest.mark.parametrize(("depth", "width"), [(3, 1 << 14), (1, 8), (2, 1)])
def test_audit(spark, rows, depth, width):
    d = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    got = sorted(tuple(r) for r in dv.divergence(d, depth=depth, width=width).collect())
    assert got == plain(rows)


def test_ranks_are_cut_and_ties_go_by_item(spark, rows):
    d = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in dv.divergence(d, min_docs=1, top=4, width=64).collect()) == plain(rows, 1, 4)


def test_sketch_never_tells_less_and_discards(spark, rows):
    d = spark.createDataFrame([(a or "", b or "", c or "") for a, b, c in rows], "lang string, source string, text string")
    bits = dv.possible_terms(d, 3, 3, 1 << 14)
    df = Counter((a or "", t) for a, _, c in rows for t in set(terms_of(c)))
    import pyarrow as pa

    keys = sorted(df)
    langs, terms = (dv._hashes(pa.array([k[i] for k in keys])) for i in (0, 1))
    may = np.logical_and.reduce([dv._reach(bits, at) for at in dv.cells(langs, terms, 3, 1 << 14)])
    assert all(m for k, m in zip(keys, may, strict=True) if df[k] >= 3)
    assert sum(m for k, m in zip(keys, may, strict=True) if df[k] < 3) == 0


def test_empty_table_and_other_columns(spark):
    d = spark.createDataFrame([("a", "s", "x y", 1, "v")] * 3 + [("a", "r", "x", 1, "v")], "lang string, source string, text string, c long, term string")
    assert dv.divergence(d.limit(0)).count() == 0
    assert sorted(tuple(r) for r in dv.divergence(d).collect()) == plain([("a", "s", "x y")] * 3 + [("a", "r", "x")])
