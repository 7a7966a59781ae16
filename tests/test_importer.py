import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae import queries
from tesserae.functions import text as X
from tesserae.operators import chains, editorial, scoring
from tesserae.plans import importer

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in queries.QUERIES.items() if f.__module__ == importer.__name__ and n in queries.ORACLES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df, sql = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, sql.select(*[f'"{c}"' for c in cols]).fetchall()))


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_year_phrases(spark):
    (got,) = one(spark, X.year_phrases(F.lit("مات سنة ١٤٥ أو ١٤٦ أو ١٤٧ وقيل ١٤٤")))
    assert [(y.year, y.relation, y.qualifier) for y in got] == [(145, "primary", None), (146, "alternative", None), (147, "alternative", None), (144, "reported", None)]
    (got,) = one(spark, X.year_phrases(F.lit("بعد 150، ص 2000، 150، 150")))
    assert [(y.year, y.relation, y.qualifier, y.offset) for y in got] == [(150, "primary", "after", 4), (150, "additional", None, 17)]
    assert one(spark, X.year_phrases(F.lit(None).cast("string")), X.year_phrases(F.lit("x")), X.first_year(F.lit("12345 x 77"))) == ([], [], 77)


def test_text(spark):
    assert one(spark, X.surface_tokens(F.lit("عن عن (مالك)، بن"), particles=("عن",)), X.surface_tokens(F.lit("عن"), particles=("عن",))) == (["مالك", "بن"], [])
    assert one(spark, X.places(F.lit("a، b,a: ")), X.trim_head(F.lit(" .a b)")), X.length_band(F.lit("abcd"), [3, 5])) == (["a", "b"], "a b", "L1")
    assert one(spark, X.strip_markup(F.lit("<p>a <b")), X.title_spans(F.lit('<span data-type="title">T</span>')), X.section_kind(F.lit("المقارنة"))) == (" a <b", ["T"], "comparison")
    assert one(spark, X.has_kunya(F.lit("ابو بكر")), X.has_nisba(F.lit("مالك المدني"))) == (True, True)


@pytest.mark.parametrize(
    ("a", "b", "kinds"),
    [
        ("a b c", "a b c", ["equal"]),
        ("a b c", "a x c", ["equal", "replacement", "equal"]),
        ("a b", "a b c", ["equal", "addition"]),
        ("a b c", "b c a", ["reorder", "equal", "reorder"]),
        ("", "", []),
    ],
)
def test_word_difference(a, b, kinds):
    steps = X._difference(a.split(), b.split())
    assert [s[0] for s in steps] == kinds
    assert " ".join(s[1] for s in steps if s[1]) == a and " ".join(s[2] for s in steps if s[2]) == b


def test_word_difference_is_longest_and_bounded():
    import random

    r = random.Random(3)
    for n, m in ((0, 5), (7, 0), (60, 50), (300, 280)):
        a, b = [r.choice("abcdefg") for _ in range(n)], [r.choice("abcdefg") for _ in range(m)]
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        steps = X._difference(a, b)
        assert sum(len(s[1].split()) for s in steps if s[0] == "equal") == table[0][0]
        assert " ".join(s[1] for s in steps if s[1]).split() == a and " ".join(s[2] for s in steps if s[2]).split() == b


def test_paths_from_strings_and_their_cut(spark):
    e = spark.createDataFrame([("a", "b", "transmitted_from"), ("b", "c", "transmitted_from"), ("b", "a", "transmitted_to"), ("c", "a", "transmitted_from"), ("c", "d", "transmitted_from")], "src string, dst string, relation string")
    got = [tuple(r) for r in chains.bounded_paths(e, "a", 8, 10, "teachers").collect()]
    assert got == [(1, "a", "b", "|a|b|", False), (2, "b", "c", "|a|b|c|", False), (3, "c", "d", "|a|b|c|d|", False)]
    cut = chains.bounded_paths(e, "a", 8, 2)
    assert [r.depth for r in cut.collect()] == [1, 2] and cut.first().truncated and [r.node for r in chains.path_nodes(cut).collect()] == ["a", "b", "c"]


def test_years_of_a_long_text(spark):
    t = " ".join(f"{k % 1100 + 1} und" for k in range(20_000))
    assert len(one(spark, X.year_phrases(F.lit(t)))[0]) == 1101


def test_redirects(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 51), (51, 50)], "key int, target int")
    got = {r.key: (r.target, r.hops, r.truncated) for r in editorial.resolve_redirects(spark.createDataFrame([(0,), (9,), (50,), (99,)], "key int"), chain).collect()}
    assert got == {0: (8, 8, True), 9: (12, 3, False), 50: (50, 8, True), 99: (99, 0, False)}


def test_quotas(spark):
    cells = spark.createDataFrame([("a", 1), ("b", 10), ("c", 100)], "cell string, n long")
    take = lambda total: {r.cell: r.quota for r in editorial.quotas(cells, "cell", "n", total).collect()}
    assert take(2) == {"a": 1, "b": 1, "c": 1} and take(1000) == {"a": 1, "b": 10, "c": 100} and sum(take(37).values()) == 37


def test_rules(spark):
    df = spark.createDataFrame([(1, "merge", "x", "x"), (2, "merge", "x", "y"), (3, "note", "x", "x")], "id int, kind string, a string, b string")
    assert [r[0] for r in df.select(editorial.may_finalize(F.col("kind"), F.col("a"), F.col("b"))).collect()] == [False, True, True]
    kept, moved = editorial.quarantine(df, "late", F.col("id") < 3)
    assert (kept.count(), [r.code for r in moved.collect()]) == (2, ["late"])


def test_weights():
    assert round(sum(w for w in scoring.WEIGHTS.values() if w > 0), 2) == 0.90
