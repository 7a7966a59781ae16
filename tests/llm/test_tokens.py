"""The encoder's short ways against the tokenizer's own, and how much a packing task is sent."""

import itertools

import pyarrow as pa

from tesserae.llm import common, tokens


def test_each_distinct_piece_is_encoded_once(monkeypatch):
    enc, seen = tokens.Encoder(tokens.default_path()), []
    plain = tokens.Encoder._bytes
    monkeypatch.setattr(tokens.Encoder, "_bytes", lambda self, words: seen.extend(" ".join(words).split()) or plain(self, words))
    enc.encode(["House, house. HOUSE house's (house)"])
    assert sorted(seen) == sorted(["house", ",", ".", "'s", "(", ")"])


def test_words_have_the_ids_of_the_whole_tokenizer():
    enc = tokens.Encoder(tokens.default_path())
    low = [chr(c) for c in range(0x21, 0x250)]
    words = [*low, *(f"A{c}b" for c in low), *("".join(x) for x in itertools.product("a'S7é.", repeat=4)), "éa", "日本", "ΣΑΣ", "it'LL", "\xa0", "\x1c"]
    want = [e.ids for e in enc.tokenizer.encode_batch(words, add_special_tokens=False)]
    got = enc.encode(words)
    assert [list(memoryview(b).cast("H")) for b in got] == want
    assert [e.ids for e in enc.tokenizer.encode_batch(words, add_special_tokens=False)] == want


def test_arrow_rows_bounds_what_is_sent_at_once(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.arrow_rows(spark, 100):
        sent = [r.n for r in spark.range(1000, numPartitions=1).mapInArrow(count, "n long").collect()]
    assert sent == [100] * 10 and spark.conf.get(name) == before


def test_no_table_of_all_known_words_is_built_for_each_lookup(monkeypatch):
    enc = tokens.Encoder(tokens.default_path())
    want = enc.encode(["one two three", "Two four"], 2)

    def built(*_, **__):
        raise AssertionError

    monkeypatch.setattr(tokens.pc, "index_in", built)
    assert enc.encode(["one two three", "Two four"], 2) == want
    enc.limit = 3  # more words than are remembered
    assert enc.encode(["five six seven", "Two four"], 2)[1] == want[1] and enc.encode(["one two three"], 2) == want[:1]
