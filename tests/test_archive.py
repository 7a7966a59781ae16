"""Sources and sinks as files, seeded numbers, places in texts, and readers on edges."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import chains as C
from tesserae.functions import hijri as H
from tesserae.functions import identifiers as I
from tesserae.operators import corpus, editorial, importing, lifecycle
from tesserae.sources import archive as A


def test_works_records_and_missing_files(spark, tmp_path):
    path = f"{tmp_path}/work.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"pages": [{"vol": "1", "page": 3, "text": "a"}, {"vol": "1", "page": 4, "text": "b"}]}, f, indent=1)
    assert [tuple(r) for r in A.work_pages(spark, f"file://{path}", "w").collect()] == [("w", 0, "1", 3, "a"), ("w", 1, "1", 4, "b")]
    with pytest.raises(FileNotFoundError, match="none.json"):
        A.work_pages(spark, f"file://{tmp_path}/none.json", "w")
    assert A.scan(spark, f"file://{tmp_path}/none", "id long, text string").count() == 0


def test_registry_rows_are_decoded(spark, tmp_path):
    rows = [(1, bytearray(b"\x01\x02"), bytearray(b"\x03\x04\x05"), bytearray(b"\x02\x09"))]
    spark.createDataFrame(rows, "i int, l binary, d binary, b binary").write.parquet(f"file://{tmp_path}/r")
    got = A.registry_entries(spark, f"file://{tmp_path}/r", {1: "x", 2: "y"}, {3: "k", 4: ":", 5: "v"}).first()
    assert (got.name, got.metadata, got.biography) == ("xy", {"k": ["v"]}, "y[09]")


def test_reports_and_relations_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    for _ in range(2):
        A.write_relations({"t": df}, f"file://{tmp_path}/db")
        A.write_reports({"counts": df.groupBy("k").count()}, f"file://{tmp_path}/reports")
    assert spark.read.parquet(f"file://{tmp_path}/db/t").count() == 2 and spark.read.json(f"file://{tmp_path}/reports/counts").count() == 2


def numbers(text, n):
    h = 0x811C9DC5
    for c in text:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    out = []
    for _ in range(n):
        h = h + 0x6D2B79F5 & 0xFFFFFFFF
        t = (h ^ h >> 15) * (h | 1) & 0xFFFFFFFF
        t ^= t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF
        out.append((t ^ t >> 14) / 2**32)
    return out


def test_seeded_numbers_and_shuffles(spark):
    want = numbers("seed|a", 9)
    df = spark.range(1, 10).select(I.nth_random(I.text_seed(F.lit("seed|a")), F.col("id")).alias("u"))
    assert [r.u for r in df.collect()] == want
    items = [f"i{k}" for k in range(10)]
    order = list(items)
    for k, u in zip(range(9, 0, -1), want, strict=True):
        j = int(u * (k + 1))
        order[k], order[j] = order[j], order[k]
    assert spark.range(1).select(I.shuffled(F.array(*[F.lit(x) for x in items]), F.lit("seed|a")).alias("x")).first().x == order


def test_places_lead_back_to_the_raw_page():
    raw = "<span data-type='title'>بَابُ أ</span>\r\n\n\n\nنصّ  &nbsp;⦗ص1⦘ <b>ةﷺ</b> a < b"
    plain, at, titles = C.plain_with_places(raw)
    norm, back = C.folded_with_places(plain)
    assert len(plain) == len(at) and len(norm) == len(back) and all(raw[at[back[i]]] != "ُ" for i in range(len(norm)))
    assert [plain[a:b] for a, b in titles] == ["بَابُ أ"] and "\n\n\n" not in plain and norm.startswith("باب ا") and "صلي الله عليه وسلم" in norm
    assert C.plain_with_places("") == ("", [], []) and C.folded_with_places(" ") == ("", [])


@pytest.mark.parametrize("sent", [1, 50, 2_000_000])
def test_pages_come_back_without_their_places(spark, monkeypatch, sent):
    monkeypatch.setattr(C, "SENT", sent)
    raws = ["<span data-type='title'>بَابُ أ</span>\r\n\n\n\nنصّ  &nbsp;⦗ص1⦘ <b>ةﷺ</b> a < b", "", None, " \n", "<b>x</b>", "É <i>a</i>\t\tb", "<" * 300] * 3
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw string").coalesce(1)
    got = C.prepared_with_span(df, "raw", 1, 4)
    want = df.withColumn("p", C.prepared(F.col("raw"))).select("k", "raw", "p.plain", "p.titles", "p.normalized", C.raw_span(F.col("p.places"), F.lit(1), F.lit(4)).alias("span"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "places" not in got.columns and got.limit(0).count() == 0


def test_number_words_and_dates_on_edges():
    assert H.number([]) is None and H.number(["و"]) is None and H.assertions(None) == [] and H.assertions("مات") == []
    assert H.number("ثلاث عشره ومايتين".split())["value"] == 213 and H.number("الف".split()) is None
    long_ = "مات سنه مايه. " * 5000
    assert len(H.assertions(long_)) == 5000


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "work string, page int, vol string, text string")
    r = importing.records(importing.segments(importing.headings(pages, "work", "page"), "bukhari"), "bukhari")
    assert r.count() == 0 and importing.narrators(importing.chains(r)).count() == 0
    assert importing.entry_fields(importing.entries(pages, "work", "page", "tahdhib")).count() == 0
    assert importing.criticisms(spark.createDataFrame([], "id int, text string"), "id", "text").count() == 0


def test_routes_and_guards(spark):
    assert [(r["start"], r["end"]) for r in C.routes_of("حدثنا مالك عن نافع ح وحدثنا سفيان عن عمرو")] == [(0, 19), (19, 41)] or len(C.routes_of("حدثنا مالك عن نافع ح وحدثنا سفيان عن عمرو")) == 2
    rel = spark.createDataFrame([("r1", True, "x", "y")], "release_id string, is_active boolean, built_at string, activated_at string")
    with pytest.raises(ValueError):
        lifecycle.register(rel, "r1", "z")
    assert lifecycle.rollback_target(rel).count() == 0
    chain = spark.createDataFrame([(str(i), str(i + 1), True) for i in range(12)], "absorbed string, target string, is_active boolean")
    got = lifecycle.resolved(spark.createDataFrame([("0",), ("9",)], "key string"), chain)
    assert {r.key: (r.target, r.truncated) for r in got.collect()} == {"0": ("8", True), "9": ("12", False)}
    none = spark.createDataFrame([], "a string, b string")
    assert editorial.compare_lives(none, spark.createDataFrame([], "k string, birth int, death int"), "k").count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string")
    assert corpus.lookup(twice, "k", spark.createDataFrame([(1, "z")], "k int, name string"), ["name"]).count() == 2
