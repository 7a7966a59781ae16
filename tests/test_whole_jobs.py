"""Queries that must do the whole of their operator's job, not a part that is easier to say in SQL."""

import pytest

from tesserae import queries
from tesserae.operators import identities

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: queries.QUERIES[name](spark, SF).collect()


def test_prepared_pages_have_all_forms(rows):
    got = rows("prepared_pages")
    assert {r.integrity for r in got} == {"verbatim", "contains-markup"}
    assert sum(r.title is not None for r in got) > len(got) // 2
    assert all(r.plain and "<" not in r.plain and r.normalized == r.normalized.strip() for r in got)


def test_imported_criticisms_have_all_kinds(rows):
    got = rows("imported_criticisms")
    assert {r.kind for r in got} == {"critic", "hearing_evidence", "disconnection", "comparison", "other"}
    assert {r.critic for r in got if r.kind == "hearing_evidence"} == {"إثبات السماع"}


def test_archive_measures_have_all_measures(rows):
    got = {(r["measure"], r["name"]): r["value"] for r in rows("archive_measures")}
    assert {m for m, _ in got} == {"forms", "index", "batch", "relatives_by_kinship", "relatives_by_match"}
    assert got["forms", "by_flag"] > 0 and got["forms", "by_form"] > 0
    assert got["batch", "forms"] == got["forms", "forms"] == got["batch", "low"] + got["batch", "unresolved"]


def _table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")


def test_a_family_has_all_its_members(spark, tmp_path):
    docs = [(i, "same", "en", "web") for i in range(70)] + [(100, "same", "de", "web"), (101, None, "fr", "web"), (102, None, "fr", "web"), (103, "x", None, "web"), (104, "x", "en", None)]
    _table(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string")
    got = {r.members: r for r in queries.QUERIES["family_members"](spark, str(tmp_path)).collect()}
    all_ = ",".join(map(str, range(70)))
    assert set(got) == {all_, "100", "101,102", "103,104"} and got[all_].n == 70 and got[all_].representative
    assert [got[k].withheld for k in (all_, "100", "101,102", "103,104")] == [False, True, False, False]
    assert got["101,102"].representative is None and got["103,104"].cluster is None


def test_machines_review_at_any_number(spark, tmp_path):
    _table(spark, tmp_path, "orders", [(1, 20), (2, 90_000), (3, 1_000_009), (4, None), (5, 7)], "o_orderkey long, o_custkey long")
    got = sorted(tuple(r) for r in queries.QUERIES["machine_reviewers"](spark, str(tmp_path)).select("o_orderkey", "column", "editor").collect())
    assert got == [(1, "o_custkey", 20), (2, "o_custkey", 90_000), (3, "second", 1_000_010)]


def test_hits_are_counted_without_being_paired(spark, tmp_path):
    _table(spark, tmp_path, "part", [(25 * i, "a" if i % 2 else "b", 1 + i % 5) for i in range(3000)] + [(50, None, 1), (75, "c", None)], "p_partkey long, p_name string, p_size int")
    _table(spark, tmp_path, "supplier", [(i, 0) for i in range(1, 2001, 2)] + [(3000, 1)], "s_suppkey long, s_nationkey int")
    df = queries.QUERIES["chain_lookup"](spark, str(tmp_path))
    # forms a are of odd parts, whose keys end on 5: exact with every entry on 5 where the size is under 3; keys of b end on 0, as no entry does
    small = sum(1 for i in range(3000) if i % 2 and 1 + i % 5 < 3)
    assert sorted(tuple(r) for r in df.collect()) == [("a", 5, small * 200, "unresolved"), ("b", 1, 1500 * 1000, "unresolved"), ("c", 1, 1000, "unresolved")]
    made, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "QueryStage" in node.nodeName() or node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan())
        if "Join" in node.nodeName():
            made = max(made, node.metrics().apply("numOutputRows").value())
    assert 0 < made < 1000


def test_each_surface_is_read_once(spark):
    rows = [("c", i, raw, i == 3) for i, raw in enumerate(["عن أبيه", "مالك", None, "موسى", "موسي", "", "رجل", "أبيه عروة"] * 200)] + [("d", 0, "مالك", None)]
    df = spark.createDataFrame(rows, "chain string, position int, raw string, prophet boolean")
    got = identities.classified(df)
    kinds = [(r.raw, r.kind) for r in got.collect()]
    assert len(kinds) == len(rows) and set(kinds) == {("عن أبيه", "relative"), ("مالك", "name"), (None, "empty"), ("موسى", "prophet"), ("موسى", "prophet-form"), ("موسي", "prophet-form"), ("", "empty"), ("رجل", "relative"), ("أبيه عروة", "name")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "NestedLoop" not in plan  # what follows reads stored surfaces
