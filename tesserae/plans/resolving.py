"""Bindings of the whole resolve to the rows of the tables: all names asked of a registry of all customers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import identities, scoring
from tesserae.plans.catalogue import query, t
from tesserae.plans.relations import _FORMS, _surfaces
from tesserae.plans.rendered import FIRST, NAMES, PLACES, _pick, _sql

# A customer's entry has one of the names, every fourth with a father, a place and a year of death; asked are all names of customers, in
# Medina in the year 150, and the regions' names, which no entry has.
_SCORED = f"""e AS (SELECT 'e-' || c_custkey AS id, {_sql(NAMES)}[(c_custkey % {len(NAMES)} + 1)::INTEGER] AS form, 0.36::DOUBLE + CASE WHEN c_custkey % 4 = 0 THEN 0.08 ELSE 0 END - CASE WHEN 120 + c_custkey % 90 < 150 THEN 0.25 ELSE 0 END AS s FROM customer),
s AS (SELECT form, id, round(round(s, 4), 3) AS score, count(*) OVER (PARTITION BY form) AS n, row_number() OVER (PARTITION BY form ORDER BY round(round(s, 4), 3) DESC, id) AS place FROM e),
p AS (SELECT form, id, score, 'low' AS level, false AS auto_link, n AS n_candidates FROM s WHERE place = 1 UNION ALL SELECT lower(r_name), NULL, NULL, 'unresolved', false, 0 FROM region)"""


def _asked(spark, d):
    names = t(spark, d, "customer").select(_pick(NAMES, F.col("c_custkey") % len(NAMES)).alias("form")).distinct()
    context = [F.lit(PLACES[0]).alias("region"), F.lit(150).alias("year"), F.lit("possible").alias("chronology")]
    return names.unionByName(t(spark, d, "region").select(F.lower("r_name").alias("form"))).select("form", *context)


def _registry(spark, d):
    k, none = F.col("c_custkey"), F.lit(None).cast("array<string>")
    name = F.concat(_pick(NAMES, k % len(NAMES)), F.when(k % 4 == 1, " بن دينار").otherwise(""))
    null = lambda c: F.lit(None).cast("string").alias(c)
    return t(spark, d, "customer").select(
        F.concat(F.lit("e-"), k.cast("string")).alias("id"), name.alias("name"), null("name_chain"), none.alias("chain_names"), null("kunya"), none.alias("nisbas"), _pick(PLACES, k % 4).alias("region"), null("residence"),
        (120 + k % 90).cast("int").alias("death"), none.alias("teachers"), none.alias("students"), none.alias("sigla"),
    )


@query(f"WITH {_SCORED} SELECT form, id, score, false AS blocked FROM s WHERE place <= 8 AND score > 0")
def archive_scores(spark, d):
    """The eight best candidates of each name with their scores."""
    return identities.ranked(_asked(spark, d), _registry(spark, d)).select("form", "id", "score", "blocked")


@query(f"WITH {_SCORED} SELECT * FROM p")
def archive_proposals(spark, d):
    """The proposal of every form; unknown names stay unresolved."""
    return identities.batch(_asked(spark, d), _registry(spark, d))


@query(
    f"""WITH {_SCORED} SELECT count(*) AS forms, count(*) FILTER (n_candidates = 0) AS without, sum(n_candidates)::BIGINT AS total, round(avg(n_candidates), 1) AS mean, max(n_candidates) AS most, 0::BIGINT AS high, 0::BIGINT AS medium, count(*) FILTER (level = 'low') AS low, count(*) FILTER (level = 'unresolved') AS unresolved, 0::BIGINT AS conflict, 0::BIGINT AS auto_link FROM p"""
)
def batch_report(spark, d):
    return identities.batch_stats(identities.batch(_asked(spark, d), _registry(spark, d)))


# Some mentions of one name are marked as the prophet's, so that all its mentions are his. Only two names of forms are in the registry.
_MEASURED = f"""{_FORMS}, p AS (SELECT *, kind = 0 AND l_suppkey % 12 = 0 AND l_partkey % {len(FIRST)} = 3 AS flag FROM r), q AS (SELECT *, NOT flag AND kind = 0 AND name IN (SELECT name FROM p WHERE flag) AS his FROM p), m AS (SELECT *, NOT flag AND NOT his AND NOT unresolvable AS named FROM q),
n AS (SELECT c_custkey AS id, {_sql(NAMES)}[(c_custkey % {len(NAMES)} + 1)::INTEGER] || CASE WHEN c_custkey % 4 = 1 THEN ' بن دينار' ELSE '' END AS name FROM customer), w AS (SELECT DISTINCT id, unnest(string_split(name, ' ')) AS token FROM n), c AS (SELECT token, count(*) AS n FROM w WHERE token <> 'بن' GROUP BY token),
a AS (SELECT count(*) AS n, count(*) FILTER (flag) AS by_flag, count(*) FILTER (his) AS by_form, count(*) FILTER (relative) AS relative, count(DISTINCT rest) FILTER (named) AS forms, count(*) FILTER (named) AS covered FROM m),
g AS (SELECT form, coalesce(n, 0) AS n FROM (SELECT DISTINCT rest AS form FROM m WHERE named) LEFT JOIN c ON token = string_split(form, ' ')[1])"""


@query(
    f"""WITH {_MEASURED} SELECT 'index' AS measure, unnest(['tokens', 'postings', 'largest', 'singletons']) AS name, unnest([count(*), sum(n), max(n), count(*) FILTER (n = 1)])::DOUBLE AS value FROM c
UNION ALL SELECT 'forms', unnest(['occurrences', 'by_flag', 'by_form', 'relative', 'empty', 'forms', 'covered', 'factor']), unnest([n::DOUBLE, by_flag, by_form, relative, 0, forms, covered, CASE WHEN forms > 0 THEN round(covered / forms, 2) ELSE 0 END]) FROM a
UNION ALL SELECT 'batch', unnest(['forms', 'without', 'total', 'mean', 'most', 'high', 'medium', 'low', 'unresolved', 'conflict', 'auto_link']), unnest([count(*)::DOUBLE, count(*) FILTER (n = 0), coalesce(sum(n), 0)::DOUBLE, round(avg(n), 1), max(n), 0, 0, count(*) FILTER (n > 0), count(*) FILTER (n = 0), 0, 0]) FROM g
UNION ALL SELECT 'relatives_by_kinship', kinship, count(*)::DOUBLE FROM m WHERE relative GROUP BY kinship UNION ALL SELECT 'relatives_by_match', "match", count(*)::DOUBLE FROM m WHERE relative GROUP BY "match\""""
)
def archive_measures(spark, d):
    """The whole run over the forms of all chains measured: forms, relatives by kinship and place, the registry's index, proposals."""
    prophet = (F.col("l_suppkey") % 12 == 0) & (F.col("l_partkey") % len(FIRST) == 3)
    o = _surfaces(spark, d).select(F.col("l_orderkey").cast("string").alias("chain"), "position", "raw", prophet.alias("prophet"))
    return identities.measures(o, _registry(spark, d))


@query("SELECT o_custkey AS form, o_orderkey AS id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linenumber % 3 = 0) AS source_conflict FROM orders")
def source_conflicts(spark, d):
    """Candidates that a source rules out, with a passage for it: a returned third line."""
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("id"))
    li = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 3 == 0, "p. 3").when(F.col("l_linenumber") % 3 == 1, "").alias("passage"))
    return scoring.source_conflicts(o, o.join(li, "id").select("form", "id", "passage"), "form", "id")


@query(
    """WITH r AS (SELECT p_name AS form, s_suppkey AS id, CASE WHEN p_partkey % 10 = s_suppkey % 10 AND p_size < 3 THEN 0 ELSE 1 END AS rank FROM part JOIN supplier ON s_nationkey = p_partkey % 25), b AS (SELECT form, bool_or(rank = 0) AS exact FROM r GROUP BY form),
m AS (SELECT r.* FROM r JOIN b USING (form) WHERE NOT exact OR rank = 0) SELECT form, arg_min(id, rank * 1000000 + id) AS id, count(*) AS hits, 'unresolved' AS level FROM m GROUP BY form"""
)
def chain_lookup(spark, d):
    """Registry hits of each form: exact ones if there are any, else all; the first and how many."""
    digit = lambda c: (F.col(c) % 10).alias("digit")
    # parts and entries that are alike in all that a hit's rank depends on are joined once, with how many they are
    p = t(spark, d, "part").groupBy(F.col("p_name").alias("form"), (F.col("p_partkey") % 25).cast("int").alias("s_nationkey"), digit("p_partkey"), (F.col("p_size") < 3).alias("small")).agg(F.count("*").alias("parts"))
    e = t(spark, d, "supplier").groupBy("s_nationkey", digit("s_suppkey").alias("id_digit")).agg(F.min("s_suppkey").alias("id"), F.count("*").alias("entries"))
    r = p.join(e, "s_nationkey").select("form", "id", F.when((F.col("digit") == F.col("id_digit")) & F.col("small"), 0).otherwise(1).alias("rank"), (F.col("parts") * F.col("entries")).alias("n"))
    return identities.chosen(r, "form", "n")
