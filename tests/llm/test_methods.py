"""The registered queries on a whole small table against plain Python, and what each method changes against its base rules."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tesserae.llm import decontam, pii, secrets, token_counts, tokens, toxicity
from tesserae.llm.spans import spans

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries()[name](spark, SF).collect()


# decontamination


def shingles(text):
    w = regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def leaks(docs, items):
    """(document, item) -> (start, similarity) of the best window, by sliding counts."""
    out = {}
    for i, text in items.items():
        want = Counter(shingles(text))
        n = sum(want.values())
        for d, t in docs.items():
            s = shingles(t)
            if not n or not s or len(set(s) & set(want)) < 0.5 * len(want):
                continue
            best = None
            for p in range(max(1, len(s) - n + 1)):
                both = sum((Counter(s[p : p + n]) & want).values())
                sim = both / (n + len(s[p : p + n]) - both)
                if sim >= 0.8 and (best is None or sim > best[1]):
                    best = (p, sim)
            if best:
                out[d, i] = best
    return out


def test_leaks_are_those_of_all_windows(spark, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = leaks({d: r.text for d, r in documents.items()}, items)
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in run(spark, "op2_simhash_decontamination")}
    assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_leaks_of_edited_passages(spark):
    import random

    r = random.Random(4)
    word = lambda: f"w{r.randrange(5000)}"
    items = {i: [word() for _ in range(n)] for i, n in enumerate((12, 30, 60, 200))}
    docs = {}
    for k in range(60):
        w = list(items[k % 4])
        for _ in range(k // 12):  # none to four edits
            w[r.randrange(len(w))] = word()
        docs[k] = " ".join([word() for _ in range(50)] + w + w[: len(w) // 2] + [word() for _ in range(50)])
    items = {i: " ".join(w) for i, w in items.items()}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.id, x.item): round(x.similarity, 6) for x in decontam.find_leaks(d, b).collect()}
    want = {k: round(v[1], 6) for k, v in leaks(docs, items).items()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and all(want[k] == v for k, v in got.items())


def test_short_items_and_names(spark):
    b = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, ""), (4, "one two three four five six")], "item_id long, text string")
    rows = [(1, "say Alpha, BETA now", 0, 0, 0), (2, "alpha then beta", 0, 0, 0), (3, "gamma gamma", 0, 0, 0), (3, "gamma gamma", 0, 0, 0), (4, None, 0, 0, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, id long, item long, n long")
    assert sorted((x.id, x.item, x.start) for x in decontam.find_leaks(d, b).collect()) == [(1, 1, 1), (3, 2, 0), (3, 2, 0)]
    assert decontam.drop_leaked(d, b).count() == 2 and decontam.find_leaks(d.limit(0), b).count() == 0


# personal data and secrets


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


RULES = {
    "op5_boosted_pii": [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ],
    "op9_ownership_secrets": [
        ("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", None), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m) >= 24),
    ],
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_base_spans(spark, documents, name):
    for row in run(spark, name):
        text, found = documents[row.doc_id].text or "", []
        for k, (kind, pattern, valid) in enumerate(RULES[name]):
            hits = [m.span() for m in re.finditer(pattern, text) if (len(m[1]) >= 6 if valid is None else valid(m[0]))]
            assert row[f"n_{kind}"] == len(hits)
            found += [(a, k, f"{kind}:{a}:{b}") for a, b in hits]
        base = ",".join(x[2] for x in sorted(found))
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(row.spans.split(","))


def test_spans_of_long_texts_take_time_in_proportion(spark):
    t = " ".join(f"u{i}@m.example" for i in range(60_000))
    n = spark.createDataFrame([(t,)], "t string").select(F.size(spans(F.col("t"), pii.EMAIL, 0)).alias("n")).first().n
    assert n == 60_000


def test_boosting_adds_spans_and_ownership_tells_them_apart(spark):
    """What each method changes against its base rules, on planted cases: above nothing."""
    plain = [f"write to user{i}@mail{i % 7}.example.com please, or call +1 (555) 123-{1000 + i} from 10.0.{i % 200}.7 now" for i in range(200)]
    odd = ["so jo(at)web.example(dot)org here", "see 10[.]20[.]30[.]40 here"] * 20
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(plain + odd)], DOCS)
    found = pii.find(d, pii.train(d)).where("size(added) > 0").count()
    assert found == len(odd)
    key = lambda k: hashlib.sha256(str(k).encode()).hexdigest()[:32]
    rows = [(i, f"token = {key(0)}", "en", f"s{i % 9}", 0) for i in range(90)] + [(100 + i, f"token = {key(i + 1)}", "en", f"s{i}", 0) for i in range(5)]
    got = Counter(x["class"] for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect() for x in r.judged)
    assert got["example"] == 180 and got["live"] == 10


@pytest.mark.parametrize("find", [lambda d: pii.find(d, pii.train(d)), secrets.scan])
def test_scans_on_edges(spark, find):
    schema = DOCS + ", id long, text_ string, r long, cand string, base string, found string"
    rows = [(1, None, "en", None, 0), (2, "", "en", "s", 0), (2, "a@b.co token=abcdef1 " * 3000, "en", "s", 0), (2, "a@b.co token=abcdef1 " * 3000, "en", "s", 0), (None, "a@b.co", "en", "s", 0)]
    d = spark.createDataFrame([(*r, 1, "x", 2, "y", "z", "w") for r in rows], schema)
    got = sorted((r.id or -1, len(r.base)) for r in find(d).collect())
    assert [k for k, _ in got] == [-1, 1, 2, 2, 2] and got[-1] == got[-2] and got[-1][1] >= 3000 and find(d.limit(0)).count() == 0


# token counts


def test_rollup_counts_every_document(spark, documents):
    enc, want = tokens.Encoder(tokens.default_path()), defaultdict(lambda: [0, 0])
    for r in documents.values():
        n = len(enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        for k, x in enumerate((1, n)):
            want[r.source, r.lang][k] += x
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in run(spark, "op10_token_rollup")}
    assert got == want and {r.tokenizer for r in run(spark, "op10_token_rollup")} == {"word_bpe_49k"}


def test_rollup_on_edges(spark, tmp_path):
    d = spark.createDataFrame([("a b", "s", "en", 7, 8), (None, None, None, 7, 8)], "text string, source string, lang string, n_words long, n_tokens long")
    assert sorted((r.source or "", r.n_words, r.n_tokens > 0) for r in token_counts.count_tokens(d).collect()) == [("", 0, False), ("s", 2, True)]
    assert token_counts.count_tokens(d.limit(0)).count() == 0
    state = "k int, source string, lang string, tokenizer string, n_tokens long"
    before = spark.createDataFrame([(1, "s", "en", "v", 5), (2, "s", "en", "v", 6), (3, "s", "en", "v", 7), (4, None, "en", "v", 8)], state)
    after = spark.createDataFrame([(1, "s", "en", "v", 5), (2, "s", "en", "v", 9), (3, "t", "en", "v", 7), (5, "s", "en", "v", 1)], state)
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    none = before.limit(0)
    assert r.apply("one", token_counts.changes(none, before, "k")) and r.apply("two", token_counts.changes(before, after, "k"))
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals().collect()} == {("s", 3, 15), ("t", 1, 7)}
    assert sorted(x.op for x in token_counts.changes(before, after, "k").collect()) == ["delete", "delete", "insert", "insert", "revise"]
    other = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert r.compact() and not other.apply("two", none.selectExpr("'insert' op", "source", "lang", "tokenizer", "n_tokens", "n_tokens old_tokens"))
    assert {(x.source, x.n_docs) for x in other.totals().collect()} == {("s", 3), ("t", 1)}


# toxicity


def test_toxic_dictionary_comes_from_whole_texts_and_ids_of_any_kind(spark):
    import random

    r = random.Random(2)
    vocabulary = [f"plain{x}word" for x in range(300)]
    clean = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(f"d{i}", clean(3000 if i % 40 == 0 else 60) + (" rottenvile scumword rottenvile" if i % 4 == 0 else "")) for i in range(320)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", 1, int(i % 4 == 0)) for i in range(320)], "doc_id string, quality int, toxic int")
    a, b = toxicity.train(d, labels), toxicity.train(d.repartition(7), labels)
    assert (a.ordinary, a.toxic, a.weights) == (b.ordinary, b.toxic, b.weights) and b"rottenvile" in a.toxic
    late = clean(6000) + " rottenvile scumword rottenvile"  # beyond 20,000 characters
    assert a.scores([late, clean(6000)])[0] > 0.7 > a.scores([late, clean(6000)])[1]
    assert toxicity.train(d.limit(0), labels).scores(["x"]).tolist() == [0.0]


def test_scores_of_the_query(spark, documents):
    got = run(spark, "op1_compression_toxicity")
    assert len(got) == len(documents) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
