import duckdb
import pytest
from given import archive  # noqa: F401  it fills the catalogue, as do the queries
from pyspark.sql import functions as F

from tesserae import queries  # noqa: F401
from tesserae.functions import scalars as S
from tesserae.operators import chains, records, resolve
from tesserae.plans import catalogue
from tesserae.sources import readers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


ALL = {("table", n): (catalogue.QUERIES[n], q) for n, q in catalogue.ORACLES.items()} | {("given", n): (catalogue.GIVEN[n], q) for n, q in catalogue.GIVEN_ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ALL), ids="-".join)
def test_matches_sql(spark, duck, name):
    query, oracle = ALL[name]
    df, sql = query(spark, SF), duck.sql(oracle)
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(map(repr, sql.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_normalize(spark):
    df = spark.createDataFrame([("  Éa\tibn  Bin x ",), ("أحمد بن مُحمَّد ـة",), (None,)], "s string")
    got = [r[0] for r in df.select(S.normalize(F.col("s"))).collect()]
    assert got == ["ea b b x", "احمد بن محمد ه", ""]
    assert [r[0] for r in spark.createDataFrame([(g,) for g in got], "s string").select(S.normalize(F.col("s"))).collect()] == got


def test_bounds_verdict(spark):
    rows = [(300, None, None, 200), (100, None, 120, None), (100, 150, 150, 200), (None, 120, 100, 150), (None, None, 100, 150), (100, 120, 135, 200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = [tuple(r[0]) for r in df.select(resolve.bounds_verdict(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == [("impossible", "a-after-b"), ("possible", "no-contradiction"), ("possible", "no-contradiction"), ("insufficient", "no-birth"), ("insufficient", "undated"), ("impossible", "b-after-a")]


def test_budget_counts_distinct_entries(spark):
    index = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(4)] + [("c", i) for i in range(20, 30)] + [("z", i) for i in range(50)], "token string, id int")
    tokens = spark.createDataFrame([("f", "a", 3), ("f", "b", 4), ("f", "c", 10), ("g", "z", 50), ("h", "z", 50), ("h", "c", 10)], "form string, token string, n long")
    got = sorted((r.form, r.token) for r in resolve.within_budget(tokens, index, 9).where("used").collect())
    assert got == [("f", "a"), ("f", "b"), ("g", "z"), ("h", "c")]


def test_cursor_and_levels(spark):
    assert records.decode_cursor(records.encode_cursor(40)) == 40
    assert [records.decode_cursor(x) for x in (None, "x", "%%")] == [0, 0, 0]
    df = spark.createDataFrame([(0.95,), (0.7,), (0.1,), (None,)], "s double")
    assert [r[0] for r in df.select(S.level(F.col("s"))).collect()] == ["high", "medium", "low", "unresolved"]


def test_upsert_and_missing(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, readers.upsert(old, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c")]
    assert readers.scan_or_empty(spark, str(tmp_path / "none"), "k int").count() == 0


def test_adjacency_of_one_node_is_empty(spark):
    df = spark.createDataFrame([("c", 0, "x"), ("d", 0, "y"), ("d", 1, "z")], "chain string, p int, n string")
    assert sorted((r.src, r.dst, r.relation) for r in chains.adjacency(df, "chain", "n", ["p"]).collect()) == [("y", "z", "transmitted_from"), ("z", "y", "transmitted_to")]
