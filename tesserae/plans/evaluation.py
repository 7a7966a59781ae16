"""Bindings of frames, annotations, adjudication and the comparison of lives to the rows of the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import normalize
from tesserae.operators import editorial, gold, resolve
from tesserae.plans.answers import _ENTRIES, _entries
from tesserae.plans.catalogue import query, t
from tesserae.plans.rendered import NAMES, _pick, _sql
from tesserae.sources import archive as A

_DECISIONS = ["identified", "ambiguous", "identified", "unreadable", "maybe"]


def _said(spark, d, annotator: str, shift: int, every: int):
    """What an annotator said of the orders, but for each `every`-th."""
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").where(k % every > 0)
    return o.select(k.alias("id"), F.lit(annotator).alias("annotator"), _pick(_DECISIONS, (k + shift) % 5).alias("decision"), F.when((k + shift) % 7 > 2, (k + shift) % 3).alias("narrator"), F.when((k + shift) % 4 > 0, k % 4).alias("revision"))


def _sql_said(name: str, annotator: str, shift: int, every: int) -> str:
    k = f"(o_orderkey + {shift})"
    return f"{name} AS (SELECT o_orderkey AS id, '{annotator}' AS annotator, {_sql(_DECISIONS)}[({k} % 5 + 1)::INTEGER] AS decision, CASE WHEN {k} % 7 > 2 THEN {k} % 3 END AS narrator, CASE WHEN {k} % 4 > 0 THEN o_orderkey % 4 END AS revision FROM orders WHERE o_orderkey % {every} > 0)"


_A, _B, _C = _sql_said("a", "u", 0, 9), _sql_said("b", "v", 2, 11), _sql_said("c", "w", 5, 2)


@query(
    f"""WITH {_A}, {_B}, x AS (SELECT * FROM a UNION ALL SELECT * FROM b), e AS (SELECT id, annotator, CASE WHEN decision = 'maybe' THEN 'unknown-decision' WHEN decision = 'identified' AND narrator IS NULL THEN 'person-missing' WHEN decision = 'identified' AND revision IS NULL THEN 'revision-missing'
WHEN decision <> 'identified' AND narrator IS NOT NULL THEN 'person-unwanted' END AS code FROM x) SELECT * FROM e WHERE code IS NOT NULL"""
)
def annotation_errors(spark, d):
    """Annotations of orders that break a rule."""
    return gold.annotation_errors(_said(spark, d, "u", 0, 9).unionByName(_said(spark, d, "v", 2, 11)))


@query(
    f"""WITH {_A}, {_B}, j AS (SELECT a.decision AS da, b.decision AS db, a.narrator AS na, b.narrator AS nb FROM a JOIN b USING (id)), s AS (SELECT count(*) AS n, count(*) FILTER (da = db) AS same_decision, count(*) FILTER (da = 'identified' AND db = 'identified') AS both_identified,
count(*) FILTER (da = 'identified' AND db = 'identified' AND na = nb) AS same_person FROM j) SELECT *, CASE WHEN both_identified > 0 THEN round(same_person::DOUBLE / both_identified, 6) END AS exact FROM s"""
)
def annotator_agreement(spark, d):
    return gold.agreement(_said(spark, d, "u", 0, 9), _said(spark, d, "v", 2, 11))


@query(
    f"""WITH {_A}, {_B}, {_C}, j AS (SELECT id, a.decision AS da, b.decision AS db, a.narrator AS na, b.narrator AS nb, c.decision AS dc, c.narrator AS nc, c.id IS NOT NULL AS third FROM a JOIN b USING (id) LEFT JOIN c USING (id)), s AS (SELECT *, da = db AND na IS NOT DISTINCT FROM nb AS same FROM j)
SELECT id, CASE WHEN same THEN da WHEN third THEN dc END AS decision, CASE WHEN same THEN na WHEN third THEN nc END AS narrator, CASE WHEN same THEN 'both' WHEN third THEN 'third' ELSE 'open' END AS "by" FROM s"""
)
def adjudication(spark, d):
    """What both annotators said of an order alike, else a third."""
    return gold.adjudicated(_said(spark, d, "u", 0, 9), _said(spark, d, "v", 2, 11), _said(spark, d, "w", 5, 2))


@query(
    """WITH p AS (SELECT o_orderkey AS id, o_orderpriority AS s FROM orders), c AS (SELECT s, count(*) AS n FROM p GROUP BY s), f AS (SELECT id, s, n + CASE WHEN s LIKE '1%' THEN 1 ELSE 0 END AS cell_size FROM p JOIN c USING (s) WHERE id % 10 = 0 AND s NOT LIKE '5%'),
q AS (SELECT s, count(*) AS q FROM f GROUP BY s), w AS (SELECT f.*, CASE WHEN f.s LIKE '2%' THEN 2.0 ELSE cell_size END / q AS weight FROM f JOIN q USING (s)), g AS (SELECT s, max(cell_size) AS cell_size, sum(weight) AS w FROM w GROUP BY s)
SELECT 'duplicate_id' AS "check", (SELECT count(*) FROM f WHERE id % 100 = 0) AS n UNION ALL SELECT 'unknown_id', (SELECT count(*) FROM f WHERE id % 70 = 0) UNION ALL SELECT 'cell_size', (SELECT count(*) FROM g JOIN c USING (s) WHERE g.cell_size <> c.n)
UNION ALL SELECT 'weight_sum', (SELECT count(DISTINCT s) FROM f WHERE s LIKE '2%' OR id % 100 = 0 OR id % 70 = 0) UNION ALL SELECT 'empty_cell', (SELECT count(*) FROM c WHERE s LIKE '5%') UNION ALL SELECT 'digest', 1"""
)
def frame_checks(spark, d):
    """A frame of each tenth order by priority against all orders: rows twice, rows of no order, wrong cells and weights, a cell without rows."""
    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stratum"))
    sizes = p.groupBy("stratum").agg(F.count("*").alias("n"))
    f = p.where((F.col("id") % 10 == 0) & ~F.startswith("stratum", F.lit("5"))).join(sizes, "stratum").withColumn("cell_size", F.col("n") + F.startswith("stratum", F.lit("1")).cast("int"))
    quota = f.groupBy("stratum").agg(F.count("*").alias("q"))
    f = f.join(quota, "stratum").select("id", "stratum", "cell_size", (F.when(F.startswith("stratum", F.lit("2")), 2.0).otherwise(F.col("cell_size")) / F.col("q")).alias("weight"))
    more = f.where("id % 100 = 0").unionByName(f.where("id % 70 = 0").withColumn("id", -F.col("id") - 1))
    return gold.check_frame(f.unionByName(more), p, "0" * 32)


# lives of customers: years of finished orders are births, of open ones deaths
_LIVES = """b AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate)::INTEGER AS birth FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 > 0), e AS (SELECT DISTINCT o_custkey AS k, (year(o_orderdate) + o_custkey % 3)::INTEGER AS death FROM orders WHERE o_orderstatus = 'O'),
l AS (SELECT DISTINCT b.k, birth, death FROM b JOIN e USING (k) WHERE birth <= death), p AS (SELECT c_custkey AS a, c_custkey % 37 AS b FROM customer)"""


def _dates(spark, d):
    o, k, y = t(spark, d, "orders"), F.col("o_custkey").alias("k"), F.year("o_orderdate")
    births = o.where("o_orderstatus = 'F' and o_custkey % 5 > 0").select(k, y.alias("birth")).distinct()
    return births, o.where("o_orderstatus = 'O'").select(k, (y + (F.col("o_custkey") % 3).cast("int")).alias("death")).distinct()


def _wanted(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") % 37).alias("b"))


@query(
    f"""WITH {_LIVES}, x AS (SELECT p.a, p.b, least(x.death, y.death) - greatest(x.birth, y.birth) AS o FROM p JOIN l x ON x.k = p.a JOIN l y ON y.k = p.b), g AS (SELECT a, b, max(o) FILTER (o > 0) AS overlap_years, min(-o) FILTER (o < 0) AS gap FROM x GROUP BY a, b)
SELECT a, b, CASE WHEN g.a IS NULL THEN 'insufficient' WHEN overlap_years IS NOT NULL THEN 'possible' ELSE 'impossible' END AS verdict, overlap_years, CASE WHEN overlap_years IS NULL THEN gap END AS gap_years FROM p LEFT JOIN g USING (a, b)""".replace("WHEN g.a IS NULL", "WHEN NOT coalesce(met, false)").replace("SELECT a, b, max(o)", "SELECT a, b, true AS met, max(o)")
)
def interval_verdicts(spark, d):
    """Possible lives of customers compared: overlaps, gaps, touching years, missing births."""
    return editorial.compare_lives(_wanted(spark, d), editorial.life_intervals(*_dates(spark, d), "k"), "k")


@query(f"WITH {_LIVES}, h AS (SELECT DISTINCT k FROM l), s AS (SELECT k, birth AS year, 'birth' AS event FROM b UNION ALL SELECT k, death, 'death' FROM e) SELECT p.a, p.b, count(*) AS dates, min(year) AS first, max(year) AS last FROM p JOIN s ON s.k = p.a OR s.k = p.b AND p.a <> p.b WHERE p.a IN (SELECT k FROM h) AND p.b IN (SELECT k FROM h) AND p.a <> p.b GROUP BY p.a, p.b")
def interval_evidence(spark, d):
    """The dates that a comparison of two customers rests on; none where it is insufficient."""
    births, deaths = _dates(spark, d)
    said = births.select("k", F.col("birth").alias("year"), F.lit("birth").alias("event")).unionByName(deaths.select("k", F.col("death").alias("year"), F.lit("death").alias("event")))
    e = editorial.chronology_evidence(_wanted(spark, d).where("a <> b"), editorial.life_intervals(births, deaths, "k"), said, "k")
    return e.groupBy("a", "b").agg(F.count("*").alias("dates"), F.min("year").alias("first"), F.max("year").alias("last"))


@query(
    f"""WITH {_LIVES}, g AS (SELECT c_custkey AS k, (SELECT min(birth) FROM b WHERE b.k = c_custkey) AS birth, (SELECT max(death) FROM e WHERE e.k = c_custkey) AS death FROM customer),
j AS (SELECT p.a, p.b, x.birth AS ab, x.death AS ad, y.birth AS bb, y.death AS bd, y.k IS NOT NULL AS known FROM p JOIN g x ON x.k = p.a LEFT JOIN g y ON y.k = p.b),
r AS (SELECT a, b, CASE WHEN NOT known THEN 'unknown' WHEN (ab IS NULL AND ad IS NULL) OR (bb IS NULL AND bd IS NULL) THEN 'undated' WHEN ab > bd THEN 'a-after-b' WHEN bb > ad THEN 'b-after-a' WHEN ab IS NULL OR bb IS NULL THEN 'no-birth' ELSE 'no-contradiction' END AS reason FROM j)
SELECT a, b, CASE WHEN reason IN ('unknown', 'undated', 'no-birth') THEN 'insufficient' WHEN reason = 'no-contradiction' THEN 'possible' ELSE 'impossible' END AS verdict, reason FROM r"""
)
def bounds_verdicts(spark, d):
    """The same pairs by their earliest birth and latest death, with reasons."""
    births, deaths = _dates(spark, d)
    g = t(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(births.groupBy("k").agg(F.min("birth").alias("birth")), "k", "left").join(deaths.groupBy("k").agg(F.max("death").alias("death")), "k", "left")
    p = _wanted(spark, d).join(g.toDF("a", "ab", "ad"), "a").join(g.toDF("b", "bb", "bd").withColumn("known", F.lit(True)), "b", "left")
    return p.select("a", "b", resolve.bounds_verdict(F.col("ab"), F.col("ad"), F.col("bb"), F.col("bd"), F.col("known")).alias("v")).select("a", "b", "v.verdict", "v.reason")


@query(f"WITH {_ENTRIES}, c AS (SELECT unnest({_sql(NAMES)}) AS cluster) SELECT cluster, id, death FROM c JOIN entries ON name = cluster WHERE death IS NOT NULL")
def dated_clusters(spark, d):
    """Dates of every name by the entries that have exactly that head."""
    e = _entries(spark, d)
    asked = e.select(normalize(F.col("teacher_phrase")).alias("cluster")).unionByName(e.select(normalize(F.col("name")).alias("cluster")).where("cluster not like '% بن دينار'")).distinct()
    return asked.join(e.where("death is not null").select("id", "death", normalize(F.col("name")).alias("cluster")), "cluster")


@query(
    """WITH r AS (SELECT CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 1 ELSE p_partkey END::VARCHAR AS "externalId", p_partkey AS k, p_partkey % 10 IN (8, 9) AS pair FROM part)
SELECT "externalId", 'missing-collection' AS code FROM r WHERE k % 4 = 1 UNION ALL SELECT "externalId", 'missing-matn' FROM r WHERE k % 6 = 0 UNION ALL SELECT "externalId", 'empty-link' FROM r WHERE k % 7 = 2
UNION ALL SELECT "externalId", 'duplicate-id' FROM r GROUP BY 1 HAVING count(*) > 1"""
)
def curated_errors(spark, d):
    """Chains of all parts that break a rule: missing fields, links without a name, ids that stand twice."""
    k = F.col("p_partkey")
    chain = F.concat_ws(" ← ", _pick(NAMES, k % 20), F.when(k % 7 == 2, "").otherwise(_pick(NAMES, (k + 3) % 20)), _pick(NAMES, (k + 5) % 20))
    rows = t(spark, d, "part").select(F.when(k % 10 == 9, k - 1).otherwise(k).cast("string").alias("externalId"), F.when(k % 4 != 1, "b").otherwise(" ").alias("collection"), chain.alias("rawIsnad"), F.when(k % 6 > 0, "x").alias("matn"))
    return A.curated_errors(rows, ["externalId", "collection", "rawIsnad", "matn"])
