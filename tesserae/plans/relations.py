"""Bindings of relative forms and of statements about teachers and students to the rows of the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import relative as R
from tesserae.functions import statements as T
from tesserae.operators import identities
from tesserae.plans.catalogue import query, t
from tesserae.plans.rendered import FIRST, STUDENTS, TEACHERS, _pick, _sql

#: What a lineitem's form is written as, by the supplier: a name, a father, a man, some, a father and his name, a brother within.
_KINDS = 6
_FORMS = f"""o AS (SELECT l_orderkey, l_linenumber - 1 AS position, l_suppkey, l_partkey, l_suppkey % {_KINDS} AS kind, {_sql(FIRST)}[(l_partkey % {len(FIRST)} + 1)::INTEGER] AS name FROM lineitem),
f AS (SELECT *, kind > 0 AS relative, ['none', 'whole', 'whole', 'whole', 'leading-apposition', 'internal'][(kind + 1)::INTEGER] AS "match", CASE kind WHEN 1 THEN 'father' WHEN 2 THEN 'unnamed_man' WHEN 3 THEN 'unnamed_group' WHEN 4 THEN 'father' WHEN 5 THEN 'brother' END AS kinship, kind IN (1, 2, 3) AS unresolvable,
CASE kind WHEN 0 THEN name WHEN 4 THEN name WHEN 5 THEN name || ' الاكبر' ELSE '' END AS rest FROM o),
r AS (SELECT *, CASE WHEN NOT relative THEN NULL WHEN kind = 2 THEN 'none' WHEN position > 0 THEN 'citing-narrator' ELSE 'collector-outside-chain' END AS anchor, CASE WHEN kind IN (1, 3, 4, 5) AND position > 0 THEN position - 1 END AS anchor_position, CASE WHEN relative THEN kind <> 3 END AS complete,
CASE WHEN NOT relative THEN NULL WHEN kind = 2 THEN 'anonymous-surface-no-anchor' WHEN position <= 0 THEN 'relative-anchor-outside-chain' WHEN unresolvable THEN 'relative-anchored-unnamed' ELSE 'relative-anchored-named-apposition' END AS reason FROM f)"""


def _surfaces(spark, d):
    k, name = F.col("l_suppkey") % _KINDS, _pick(FIRST, F.col("l_partkey") % len(FIRST))
    raw = F.when(k == 0, name).when(k == 1, "عن أَبِيهِ").when(k == 2, "رجل").when(k == 3, "بعض أصحابه").when(k == 4, F.concat(F.lit("أبيه "), name)).otherwise(F.concat(name, F.lit(" أخيه الأكبر")))
    return t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("position"), "l_suppkey", "l_partkey", raw.alias("raw"))


@query(f'WITH {_FORMS} SELECT l_orderkey, position, l_suppkey, l_partkey, relative, "match", kinship, unresolvable, rest, anchor, anchor_position, complete, reason FROM r')
def relative_forms(spark, d):
    """Relative words in the forms of all chains, where they stand, and whom they hang on."""
    f = _surfaces(spark, d).withColumn("a", R.analysis(F.col("raw"))).withColumn("r", R.resolution(F.col("a"), F.col("position")))
    return f.select("l_orderkey", "position", "l_suppkey", "l_partkey", "a.relative", "a.match", "a.kinship", "a.unresolvable", "a.rest", "r.anchor", "r.anchor_position", "r.complete", "r.reason")


@query(f'WITH {_FORMS} SELECT kinship, "match", anchor, reason, count(*) AS n FROM r WHERE relative GROUP BY ALL')
def relative_references(spark, d):
    """The relative forms of all chains by kinship, place and anchor."""
    o = _surfaces(spark, d).select(F.col("l_orderkey").cast("string").alias("chain"), "position", "raw", F.lit(False).alias("prophet"))
    return identities.relatives(o).groupBy("kinship", "match", "anchor", "reason").agg(F.count("*").alias("n"))


# an entry for each customer with lists of teachers and students: names, a crowd, a relative, one twice, one that its text has not
_STATED = f"""c AS (SELECT c_custkey AS k, 'c-' || c_custkey AS id, c_custkey % 10 = 0 AS unnamed, c_custkey % 10 = 5 AS textless, {_sql(TEACHERS)}[(c_custkey % 4 + 1)::INTEGER] AS a, {_sql(TEACHERS)}[((c_custkey + 1) % 4 + 1)::INTEGER] AS b, {_sql(STUDENTS)}[(c_custkey % 3 + 1)::INTEGER] AS s, {_sql(FIRST)}[(c_custkey % 7 + 1)::INTEGER] AS head FROM customer),
m AS (SELECT k, id, unnamed, textless, head, 'teacher' AS list, 0 AS "index", a AS surface, NULL AS code FROM c UNION ALL SELECT k, id, unnamed, textless, head, 'teacher', 1, 'جماعة', 'no_person_named' FROM c UNION ALL SELECT k, id, unnamed, textless, head, 'teacher', 2, 'أبيه', 'relative_form' FROM c
UNION ALL SELECT k, id, unnamed, textless, head, 'teacher', 3, CASE k % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE 'غايب' END, CASE k % 3 WHEN 0 THEN 'duplicate' WHEN 2 THEN 'phrase_not_in_passage' END FROM c UNION ALL SELECT k, id, unnamed, textless, head, 'student', 0, s, NULL FROM c
UNION ALL SELECT k, id, unnamed, textless, head, 'student', 1, head, 'self_reference' FROM c WHERE k % 4 = 1 UNION ALL SELECT k, id, unnamed, textless, head, 'student', 1, '', 'empty_after_cleaning' FROM c WHERE k % 4 = 2),
v AS (SELECT k, id, list, "index"::INTEGER AS "index", CASE WHEN unnamed THEN '' ELSE surface END AS surface, head, CASE WHEN unnamed THEN 'subject_not_named' WHEN textless AND coalesce(code, '') NOT IN ('no_person_named', 'relative_form', 'empty_after_cleaning') THEN 'entry_text_missing' ELSE code END AS code FROM m)"""


def _stated(spark, d):
    k = F.col("c_custkey")
    a, b, s, head = _pick(TEACHERS, k % 4), _pick(TEACHERS, (k + 1) % 4), _pick(STUDENTS, k % 3), _pick(FIRST, k % 7)
    text = F.concat_ws(" ", F.lit("روى عن"), a, F.lit("وجماعة وأبيه"), b, F.lit("وعنه"), s, head)
    students = F.array_compact(F.array(F.concat(s, F.lit(" (خ)")), F.when(k % 4 == 1, F.concat(F.lit("و"), head)).when(k % 4 == 2, " ")))
    return t(spark, d, "customer").select(
        k.alias("k"), F.concat(F.lit("c-"), k.cast("string")).alias("id"), F.when(k % 10 > 0, head).alias("head"), F.when(k % 10 != 5, text).alias("text"),
        F.array(a, F.lit("وجماعة"), F.lit("أبيه"), F.when(k % 3 == 0, F.concat(F.lit("«و"), a, F.lit("»"))).when(k % 3 == 1, F.concat(F.lit("و"), b)).otherwise("غايب")).alias("teachers"), students.alias("students"),
    )


@query(f'WITH {_STATED} SELECT id, list, "index", surface, code FROM v')
def mention_verdicts(spark, d):
    """Mentions of teachers and students in all entries, cleaned, with the reason for which each is left out."""
    return T.statements(_stated(spark, d)).select("id", "list", "index", "surface", "code")


@query(f"WITH {_STATED} SELECT 'rijal_statement_' || coalesce(code, 'identity_unresolved') AS code, count(*) AS n FROM v GROUP BY 1")
def rejection_histogram(spark, d):
    """The review queue's rows by code."""
    return T.review_rows(T.statements(_stated(spark, d))).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {_STATED} SELECT id, 'UNC-' || substr(sha1(CASE WHEN list = 'teacher' THEN surface ELSE head END), 1, 12) AS teacher, 'UNC-' || substr(sha1(CASE WHEN list = 'teacher' THEN head ELSE surface END), 1, 12) AS student FROM v WHERE code IS NULL")
def statement_relations(spark, d):
    """Accepted statements of all entries as relations from teacher to student."""
    return T.statements(_stated(spark, d)).where("code is null").select("id", "teacher", "student")
