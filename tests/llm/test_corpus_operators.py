"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing names."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontam, embeddings, line_dedup, near_dedup, packing, pii, secrets, tokens, toxicity
from tesserae.llm.spans import spans
from tesserae.llm.token_counts import TokenRollup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(n, seed):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 10**6, n)]


def test_near_duplicates(spark):
    base = words(300, 1)
    near = base[:150] + ["other"] + base[151:]
    far = base[:60] + words(240, 2)
    texts = [" ".join(base), " ".join(near), " ".join(far), " ".join(base).upper().replace("W", "w"), None, "", " \n", "one two", "ONE  two", " ".join(base)]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i].component_id for i in range(10)] == [0, 0, 2, 0, 4, 5, 6, 7, 7, 0]
    assert [got[i].n_shingles for i in (0, 4, 5, 6, 7)] == [296, 0, 0, 0, 1]
    assert [i for i in range(10) if got[i].kept] == [0, 2, 4, 5, 6, 7]


def test_near_duplicates_repeated_ids_and_empty_table(spark):
    t = " ".join(words(50, 3))
    df = spark.createDataFrame([(1, t, 9), (1, t, 9), (None, t, 9), (7, t, 9)], "doc_id long, text string, n long")
    got = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (-1, None, True), (7, 1, False)], key=str)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_line_dedup(spark, monkeypatch):
    rows = [(i, f"Menu\nline {i}\n\nMenu ", "en", "host", 0) for i in range(40)] + [(90, None, "en", "host", 0), (91, "Menu", "en", None, 0), (92, "Menu\nx", "en", "small", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("k", F.lit(2))
    for limit in (line_dedup.BROADCAST_LINES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df).collect()}
        assert got[3].text == "line 3\n" and (got[3]._ts_lines, got[3]._ts_dropped) == (4, 2)
        assert (got[90].text, got[91].text, got[92].text) == (None, "Menu", "Menu\nx") and len(got) == 43


def test_pipeline_drops_lines_of_a_fiftieth_of_a_host(spark):
    import corpus_pipeline

    rows = [(i, f"line {i}" + ("\nShare this" if i % 50 == 0 else "") + ("\nordinary" if i % 125 == 1 else ""), "en", "host", 0) for i in range(500)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_site_lines(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got[50] == "line 50" and got[126] == "line 126\nordinary"


def test_decontamination(spark):
    item, long_ = words(40, 5), words(3000, 6)
    hidden = long_[:2000] + [w.upper() + "," for w in item] + long_[2000:]
    edited = words(20, 7) + item[:20] + item[21:] + words(20, 8)
    part = words(30, 9) + item[:15] + words(30, 10)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, " ".join(words(30, 11)))], "item_id long, text string")
    d = docs(spark, [" ".join(hidden), " ".join(edited), " ".join(part), None, "", " ".join(long_)])
    got = {(r.id, r.item): r for r in decontam.find_leaks(d, bench).collect()}
    assert (0, 1) in got and got[0, 1].similarity == 1.0 and got[0, 1].start == 2000
    assert {k[0] for k in got} <= {0, 1}
    assert sorted(r.doc_id for r in decontam.drop_leaked(d, bench).collect() if r.doc_id > 1) == [2, 3, 4, 5]
    assert decontam.find_leaks(d, bench.limit(0)).count() == 0
    assert decontam.find_leaks(d.union(d.where("doc_id = 0")), bench).where("id = 0").count() == 2


PLAIN = [(pii.EMAIL, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), (pii.IP, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), (pii.CARD, r"[0-9]([\x20-]?[0-9])+"), (pii.PHONE, r"\+[0-9][\x20().0-9-]+[0-9]"),
         (secrets.ASSIGN, r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""), (secrets.ACCESS, r"AKIA[A-Z0-9]+"), (secrets.HEX, r"[0-9a-f]{24,}")]


def test_spans_are_those_of_the_plain_patterns(spark):
    r = np.random.default_rng(4)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "+1 (555) 123-4567", "4111 1111 1111 1111", " ", "é", "😀", "token = 'abcdef01'", "AKIA" + "Z" * 16, "ab" * 14, "%", "-", "x", "9", "\n", "token=", "+"]
    texts = ["".join(bits[k] for k in r.integers(0, len(bits), 12)) for _ in range(150)] + ["", "1" * 20_000, "a" * 20_000, "1 " * 5000, "a@b" + ".c" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for ours, plain in PLAIN:
        got = {x.i: [(y.s, y.e) for y in x.m] for x in d.select("i", spans(F.col("t"), ours, 0).alias("m")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [m.span() for m in re.finditer(plain, t)], (ours, t[:80])


def test_pii_redaction(spark):
    texts = [f"write to user{i}@mail.example.com now or call +1 (555) 123-45{i % 90 + 10}" for i in range(60)] + [None, "", "clean"]
    found = pii.redact(pii.find(docs(spark, texts), pii.train(docs(spark, texts))))
    got = {r.id: r.redacted for r in found.collect()}
    assert got[0] == "write to [email] now or call [phone]" and (got[60], got[61], got[62]) == ("", "", "clean")


def test_pii_adds_what_the_base_rules_miss(spark):
    r = np.random.default_rng(3)
    luhn = lambda d: sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d[::-1])) % 10
    cards = [next([*d, e] for e in range(10) if luhn([*d, e]) == 0) for d in ([4, *r.integers(0, 10, 14).tolist()] for _ in range(60))]
    plain = [f"an {'ox' * (i % 3)} und{i} erst user{i}.x@mail{i % 9}.example.com sonst {i % 250}.{i * 7 % 256}.3.{i} ere {''.join(map(str, c))} and +1 ({200 + i}) 555-{1000 + i * 37} thereof" for i, c in enumerate(cards)]
    dotted = lambda d: ".".join("".join(map(str, d[k : k + 4])) for k in range(0, 16, 4))
    good, bad = cards[0], [*cards[1][:-1], (cards[1][-1] + 1) % 10]
    odd = ["so jo.doe(at)web.example(dot)org here", "so jo.doe @ example.net here", "so 10[.]20[.]30[.]40 here", f"so {dotted(good)} here", "so (212) 555-0187 here", "so +1 (826) 555-4081 190.137.223.204 here"]
    none = ["so 10[.]20[.]300[.]40 here", f"so {dotted(bad)} here", f"so {''.join(map(str, bad))} here", "so 212 555 0187 here", "so jo @ home. There"]
    model = pii.train(docs(spark, plain))
    got = {x.id: [(a.k, x.text[a.s : a.e]) for a in x.added] for x in pii.find(docs(spark, odd + none), model).collect()}
    assert [got[i] for i in range(6)] == [[(0, odd[0][3:-5])], [(0, odd[1][3:-5])], [(1, odd[2][3:-5])], [(2, odd[3][3:-5])], [(3, odd[4][3:-5])], [(3, "(826) 555-4081")]]
    assert [got[i] for i in range(6, 11)] == [[]] * 5


def test_secret_ownership(spark):
    live, copied = "Ab3dEf6hIj9kLmNoPqRsTuVwXyZ0123456", "Zx9cVb6nMq3wErTyUiOpAsDfGhJkL78901"
    rows = [(1, f"key {live} end", "en", "a", 0), (2, f"see {copied}", "en", "a", 0), (3, f"see {copied}", "en", "b", 0), (4, None, "en", None, 0), (4, None, "en", None, 0)]
    got = sorted(((r.id, len(r.added), len(r.examples)) for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == [(1, 1, 0), (2, 0, 1), (3, 0, 1), (4, 0, 0), (4, 0, 0)]


def test_secret_ownership_judges_base_spans(spark):
    copied, own, key = "0f1e2d3c4b5a69788796a5b4c3d2e1f0", "9a8b7c6d5e4f30211203f4e5d6c7b8a9", "AKIA" + "Q7W8E9R0T1Y2U3I4"
    rows = [(i, f"token = '{copied}' and", "en", f"s{i}", 0) for i in range(40)] + [(50, f"say {copied}", "en", "s0", 0), (51, f"password={own}", "en", "s0", 0), (52, f"{key} x", "en", "s1", 0), (53, "api_key: changeme99", "en", "s1", 0), (53, "none", "en", "s1", 0)]
    got = {(r.id, len(r.base)): ([(x.k, x["class"] == "live") for x in r.judged], len(r.examples)) for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0, 2] == got[39, 2] == ([(0, False), (2, False)], 2) and got[50, 1] == ([(2, False)], 1)
    assert got[51, 2] == ([(0, True), (2, True)], 0) and got[52, 1] == ([(1, True)], 0) and got[53, 1] == ([(0, False)], 1) and got[53, 0] == ([], 0)


def test_secret_ownership_counts_repositories(spark):
    hot, twice, moved, wide = "Ab3dEf6hIj9kLmNoPqRsTuVwXyZ0923456", "Zx9cVb6nMq3wErTyUiOpAsDfGhJkL78901", "Mn4bVc7xZa2sDfGhJkLqWeRtYuIoP56483", "Qa8zWs5xEd2cRfVtGbYhNuJmIkOlP73920"
    held = [(hot, i, "a") for i in range(30)] + [(twice, 100, "a"), (twice, 101, "a"), (twice, 101, "a"), (moved, 200, "a"), (moved, 201, "b")] + [(wide, 300 + i, f"s{i}") for i in range(5)]
    got = {r.id: [tuple(x)[3:] for x in r.judged] for r in secrets.scan(spark.createDataFrame([(i, f"key {v} end", "en", o, 0) for v, i, o in held], DOCS)).collect()}
    assert got[0] == [("example", 30, 1)] and got[100] == got[101] == [("live", 2, 1)]
    assert got[200] == got[201] == [("shared", 2, 2)] and got[304] == [("example", 5, 5)]


def test_embeddings(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 16))
    x[100:200] = x[0] + 0.05 * r.normal(size=(100, 16))
    x[200:205] = x[50]
    lab = [int(i % 3 == 0) for i in range(400)]
    rows = [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, lab, strict=True))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, x[0].tolist(), None), (903, [float("nan")] * 16, 1), (904, [1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.array(lab)[:, None] == np.array(lab)[None])
    np.fill_diagonal(link, False)
    comp = list(range(400))
    for _ in range(12):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(400)]
    for rows_ in (4096, 60):
        got = {g.vec_id: g for g in embeddings.near_duplicates(df, shard_rows=rows_).collect()}
        assert all((got[i].n_links, got[i].component_id) == (link[i].sum(), comp[i]) for i in range(400))
        assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))


def test_encoder_and_packing(spark):
    texts = ["It's a test, ABC's <|endoftext|> x.", "İstanbul ΣΑΣ é \x1cfoo １２ nbsp\xa0x %%% a.b!", None, "", "word " * 9000, "one two", "one two"]
    enc = tokens.Encoder(tokens.default_path())
    whole = [np.array(e.ids + [2], "<u4") for e in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts, 2)] == [w.tolist() for w in whole]
    rows = packing.pack_documents(docs(spark, texts)).collect()
    seqs = {}
    at = [0] * len(texts)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and bytes(r.ids) == whole[r.doc_id][r.start : r.start + r.length].tobytes()
        at[r.doc_id] += r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == [len(w) for w in whole]
    for s in seqs.values():
        n = sum(x for _, x in s)
        assert n <= 4096 and n & (n - 1) == 0 and sorted(s) == [(sum(y for _, y in sorted(s)[:k]), sorted(s)[k][1]) for k in range(len(s))]
    assert packing.pack_documents(docs(spark, texts).limit(0)).count() == 0


def test_rollup_is_idempotent(spark, tmp_path):
    r = TokenRollup(spark, f"file://{tmp_path}/r")
    ch = spark.createDataFrame([("insert", "a", "en", "v", 10, None), ("insert", None, "en", "v", 5, None), ("insert", "a", "en", "v", 7, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    more = spark.createDataFrame([("delete", "a", "en", "v", 7, None), ("revise", "a", "en", "v", 12, 10), (None, "a", "en", "v", 3, None)], ch.schema)
    assert r.apply("b1", ch) and r.apply("b2", more) and not r.apply("b1", ch)
    want = {("a", 1, 12), (None, 1, 5)}
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals().collect()} == want
    r.compact()
    assert not r.apply("b2", more) and r.apply("b3", ch.limit(0))
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals().collect()} == want


def test_toxicity(spark):
    r = np.random.default_rng(1)
    vocabulary = [f"plain{x}word" for x in range(400)]
    text = lambda bad: " ".join([*r.choice(vocabulary, 80), *(["rottenvile", "scumword"] * 3 if bad else [])])
    rows = [(i, text(i % 4 == 0), "en", "s", 0) for i in range(400)] + [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(d, labels)
    got = {x.doc_id: x for x in d.select("doc_id", toxicity.score(F.col("text"), model).alias("s"), toxicity.held_out().alias("h")).collect()}
    assert all(got[i].h == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    out = [i for i in range(400) if got[i].h]
    assert np.mean([(got[i].s >= toxicity.REJECT) == (i % 4 == 0) for i in out]) > 0.95
    assert got[1000].s == got[1001].s < toxicity.REJECT
    assert toxicity.train(d, labels.limit(0)).scores(["x"]).tolist() == [0.0]
