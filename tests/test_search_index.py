"""Snapshots behind one pointer, and the positional index on top of them."""

import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators.search_index import SPACES, SearchIndex
from tesserae.sources import snapshots as S


@pytest.fixture
def store(spark):
    return S.Snapshots(spark, "file://" + tempfile.mkdtemp(prefix="tesserae-test-"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "a long")


def test_versions_batches_and_rollback(spark, store):
    assert store.publish({"t": {"x": frame(spark, 1, 2), "y": frame(spark, 3)}, "u": {"x": frame(spark, 9)}}) == 1
    old = store.read("t")
    assert store.publish({"t": {"x": None}, "u": {"x": frame(spark, 8)}}) == 2
    assert rows(old) == [(1,), (2,), (3,)] and rows(store.read("t")) == [(3,)] and rows(store.read("t", 1)) == [(1,), (2,), (3,)]
    assert rows(store.read("u")) == [(8,)] and rows(store.read("t", 1, ["y"])) == [(3,)]
    assert store.rollback(1) == 3 and rows(store.read("u")) == [(9,)]
    store.publish({"t": {"x": None, "y": None}})
    assert rows(store.read("t")) == [] and store.read("t").columns == ["a"]


def test_a_run_killed_between_two_tables_leaves_the_old_version(spark, store):
    store.publish({"t": {"x": frame(spark, 1)}, "u": {"x": frame(spark, 1)}})
    broken = frame(spark, 2).select((F.col("a") + F.raise_error(F.lit("killed")).cast("long")).alias("a"))
    with pytest.raises(Exception, match="killed"):
        store.publish({"t": {"x": frame(spark, 2)}, "u": {"x": broken}})
    assert store.versions() == [1] and rows(store.read("t")) == rows(store.read("u")) == [(1,)]
    assert store.publish({"t": {"x": frame(spark, 3)}}) == 2
    gone = store.vacuum(1, 0)
    assert len(gone) >= 2 and rows(store.read("t")) == [(3,)] and rows(store.read("u")) == [(1,)]


def test_checks_columns_and_conflicts(spark, store, monkeypatch):
    store.publish({"t": {"x": frame(spark, 1)}})
    with pytest.raises(S.Invalid, match="too many"):
        store.publish({"t": {"y": frame(spark, 1)}}, check=lambda read: ["too many"] if read("t").count() > 1 else [])
    with pytest.raises(S.Invalid, match="other columns"):
        store.publish({"t": {"y": spark.createDataFrame([("q",)], "a string")}})
    assert store.versions() == [1]
    real, other = S.Snapshots._commit, S.Snapshots(spark, store.path)

    def meanwhile(batch):
        def commit(self, manifest):
            monkeypatch.setattr(S.Snapshots, "_commit", real)
            other.publish({"t": {batch: frame(spark, 5)}})
            return real(self, manifest)

        return commit

    monkeypatch.setattr(S.Snapshots, "_commit", meanwhile("z"))
    assert store.publish({"t": {"y": frame(spark, 4)}}) == 3 and rows(store.read("t")) == [(1,), (4,), (5,)]
    monkeypatch.setattr(S.Snapshots, "_commit", meanwhile("y"))
    with pytest.raises(S.Conflict):
        store.publish({"t": {"y": frame(spark, 6)}})
    assert rows(store.read("t")) == [(1,), (5,), (5,)]


def test_batches_are_loaded_reused_and_reloaded(spark, store):
    assert store.load({"t": {"x": frame(spark, 1, 2), "y": frame(spark, 7)}}) == {("t", "x"): "load", ("t", "y"): "load"}
    assert store.load({"t": {"x": frame(spark, 2, 1)}}) == {("t", "x"): "reuse"} and store.versions() == [1]
    assert store.load({"t": {"x": frame(spark, 2, 3), "y": frame(spark, 7)}}) == {("t", "x"): "reload", ("t", "y"): "reuse"}
    assert rows(store.read("t")) == [(2,), (3,), (7,)] and rows(store.read("t", 1)) == [(1,), (2,), (7,)]


def plain(docs, words, pattern):
    out = []
    for k, text in docs:
        ts = [w for w in re.split(pattern, text or "") if w]
        starts = [i for i in range(len(ts) - len(words) + 1) if ts[i : i + len(words)] == words]
        if starts:
            out.append((k, starts))
    return sorted(out)


@pytest.mark.parametrize(("pattern", "separators"), [(r"[^a-z]+", None), (r"\s+", SPACES)])
def test_phrases(spark, store, pattern, separators):
    r = np.random.default_rng(1)
    docs = [(i, " ".join(r.choice(["a", "b", "c,", "dd", "a.b"], int(r.integers(0, 40))))) for i in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(docs, "id long, text string")
    index = SearchIndex(store, **({"separators": separators} if separators else {}))
    assert index.add(df.where("id < 30"), "id", F.col("text"), frequent=50) == 30
    assert index.add(df, "id", F.col("text")) == 32 and index.add(df, "id", F.col("text")) == 0
    for words in (["a", "b"], ["a", "a"], ["dd", "a", "b"], ["b"], ["zz"], ["a", "zz"], ["a", "b", "a", "b"]):
        got = sorted((x.key, list(x.starts)) for x in index.phrase(words).collect())
        assert got == plain(docs, words, pattern)
        inside = [k for k, s in plain(docs, words, pattern) if any(i + len(words) < len([w for w in re.split(pattern, dict(docs)[k]) if w]) for i in s)]
        assert sorted(x.key for x in index.phrase(words, inside=True).collect()) == inside
    assert index.phrase([]).count() == 62


def test_added_documents_are_found_and_old_versions_stay(spark, store):
    index = SearchIndex(store)
    index.add(spark.createDataFrame([(1, "of the sea")], "id long, text string"), "id", F.col("text"))
    before = index.phrase(["of", "the"])
    index.add(spark.createDataFrame([(2, "out of the sea"), (1, "changed")], "id long, text string"), "id", F.col("text"))
    assert [r.key for r in before.collect()] == [1] and sorted(r.key for r in index.phrase(["of", "the"]).collect()) == [1, 2]
    assert sorted(r.key for r in index.having("ea", "ends").collect()) == [1, 2] and [r.key for r in index.having("ou").collect()] == [2]
    assert index.having("zz").count() == 0


def test_only_the_folders_of_the_tokens_are_read(spark, store):
    index = SearchIndex(store)
    index.add(spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 40))) for i in range(50)], "id long, text string"), "id", F.col("text"))
    plan = index.phrase(["w3", "w4"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket#", plan)) == len(re.findall(r"PushedFilters: \[[^\]]*token", plan)) == 2
    scan = index.postings(["w3"])
    read = scan._jdf.queryExecution().executedPlan().toString()
    files = {r.f for r in scan.select(F.input_file_name().alias("f")).collect()}
    assert "PartitionFilters" in read and files and all(f"bucket={index._buckets(['w3'])[0]}/" in f for f in files)


def test_postings_are_written_without_a_shuffle(spark, store, monkeypatch):
    plans = {}
    real = store._write
    monkeypatch.setattr(store, "_write", lambda df, by: plans.update({tuple(df.columns): df._jdf.queryExecution().executedPlan().toString()}) or real(df, by))
    docs = spark.createDataFrame([(i, "b a b") for i in range(20)] + [(3, "b a b"), (50, None)], "id long, text string")
    assert SearchIndex(store).add(docs.where("id <> 3"), "id", F.col("text")) == 20
    assert "hashpartitioning" not in plans["bucket", "token", "key", "positions"]
    assert SearchIndex(store).add(docs, "id", F.col("text")) == 1
    got = store.read("postings").where("token = 'b'").select("key", "positions").collect()
    assert sorted((r.key, r.positions) for r in got) == [(i, [0, 2]) for i in range(20)]
