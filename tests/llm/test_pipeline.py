"""The pipeline on a fixture with planted cases: each stage's rows, and run(), against plain Python."""

import random

import pytest

import corpus_pipeline as P
from tesserae.llm.near_dedup import near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOXIC = "rottenvile scumword rottenvile filthpig"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(6)
    word = lambda: f"plain{r.randrange(4000)}word"
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(40)
    rows = [(i, text(80) + (" " + TOXIC if i % 5 == 0 else ""), "en", f"host{i % 2}", 0) for i in range(400)]
    rows += [(1000 + i, text(60) + "\nShare this page", "en", "host0", 0) for i in range(20)]
    rows += [(1100, rows[1][1], "en", "host1", 0), (1101, rows[2][1] + " more", "en", "host0", 0), (1200, text(20) + " " + item + " " + text(20), "en", "host1", 0)]
    rows += [(1300, None, "en", "host0", 0), (1301, "", None, None, 0), (1302, "one two", "en", "host1", 0)]
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r[1] for r in rows}


def test_stages(spark, sf):
    path, texts = sf
    stages = dict(P.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = {r.doc_id for r in stages["toxicity"](spark, docs, path).collect()}
    assert kept == {i for i, t in texts.items() if not t or "rottenvile" not in t}
    lines = {r.doc_id: r for r in stages["line_dedup"](spark, docs, path).collect()}
    assert lines.keys() == texts.keys() and all(lines[i].text == (t if t is None else t.replace("\nShare this page", "")) for i, t in texts.items())
    assert all(lines[1000 + i].n_chars == len(lines[1000 + i].text) for i in range(20))
    gone = texts.keys() - {r.doc_id for r in stages["near_dedup"](spark, docs, path).collect()}
    assert gone == {1100, 1101}
    assert texts.keys() - {r.doc_id for r in stages["decontamination"](spark, docs, path).collect()} == {1200}
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        assert stages[name](spark, docs, path).columns == docs.columns and stages[name](spark, docs.limit(0), path).count() == 0


def test_run(spark, sf):
    path, texts = sf
    out = P.run(spark, path).collect()
    assert {r.doc_id for r in out} == {i for i, t in texts.items() if (not t or "rottenvile" not in t) and i not in (1100, 1101, 1200)}
    assert all(r.length > 0 and r.ids_crc32 >= 0 for r in out)


def test_repeated_and_missing_ids_keep_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    d = spark.createDataFrame([(7, a, "en", "s", 1), (7, b, "en", "s", 2), (7, b, "en", "s", 3), (3, a, "en", "s", 4), (None, b, "en", "s", 5), (None, None, "en", "s", 6), (8, "", "en", "s", 7)], DOCS)
    got = sorted((r.doc_id or -1, (r.text or "")[:1]) for r in P.drop_near_duplicates(spark, d, "").collect())
    assert got == [(-1, ""), (3, "a"), (7, "b"), (8, "")]
    assert near_duplicates(d.limit(0)).count() == 0


def test_rows_without_an_id_lose_leaks_and_extra_columns_stay(spark, sf):
    path, texts = sf
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    long_ = " ".join(f"far{i}" for i in range(20_000))
    d = spark.createDataFrame([(None, f"x {item} y", "en", "s", 1, 9), (None, "clean text", "en", "s", 2, 9), (5, f"{long_} {item}", "en", "s", 3, 9), (5, "clean", "en", "s", 4, 9), (None, None, "en", "s", 5, 9)], DOCS + ", id long")
    kept = P.drop_benchmark_leaks(spark, d, path)
    assert kept.columns == d.columns and sorted(r.n_chars for r in kept.collect()) == [2, 4, 5]


def test_run_on_empty_tables(spark, sf, tmp_path):
    path, _ = sf
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
