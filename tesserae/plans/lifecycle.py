"""Bindings of proposals, guards, identities and releases to rows, each with the rows that must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import editorial, lifecycle as L
from tesserae.plans.catalogue import given, query, t
from tesserae.plans.literal import Literal, ctes

REDIRECTS = Literal("events_", "event int, kind string, absorbed string, target string, at int", [(1, "merge", "b", "a", 1), (2, "merge", "c", "b", 2), (3, "merge", "d", "a", 3), (4, "split", "d", "a", 4), (5, "merge", "e", "c", 5), (6, "merge", "f", "a", 6), (7, "split", "f", "a", 7), (8, "merge", "f", "c", 8)])
KEYS = Literal("keys_", "key string", [("a",), ("b",), ("d",), ("e",), ("f",), ("x",)])
ALIASES = Literal("aliases_", "key string, alias string, is_active boolean", [("a", "UNC-a", True), ("b", "UNC-b", True), ("b", "UNC-b2", False), ("c", "UNC-c", True), ("d", "UNC-d", True), ("e", "UNC-e", True)])


@given("SELECT * FROM (VALUES ('b', 'a', 1, true), ('c', 'b', 2, true), ('d', 'a', 3, false), ('e', 'c', 5, true), ('f', 'a', 6, false), ('f', 'c', 8, true)) v(absorbed, target, cause, is_active)")
def redirect_log(spark, d):
    """Merges and splits as redirects, all on record, the last of a key active."""
    return L.redirects_of(REDIRECTS.df(spark))


@given("SELECT * FROM (VALUES ('a', 'a', '', false), ('b', 'a', 'b', false), ('d', 'd', '', false), ('e', 'a', 'e>c>b', false), ('f', 'a', 'f>c>b', false), ('x', 'x', '', false)) v(key, target, path, truncated)")
def redirect_paths(spark, d):
    return L.resolved(KEYS.df(spark), L.redirects_of(REDIRECTS.df(spark)))


@query("WITH RECURSIVE r AS (SELECT c_custkey AS absorbed, c_custkey - 3 AS target FROM customer WHERE c_custkey % 40 > 3), w(key, p, n) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT w.key, r.absorbed, n + 1 FROM w JOIN r ON r.target = w.p WHERE n < 8) SELECT DISTINCT key::VARCHAR AS key, 'UNC-' || p AS alias FROM w WHERE p % 2 = 1")
def absorbed_aliases(spark, d):
    """The aliases of a person and of all whom he has absorbed."""
    c = t(spark, d, "customer")
    r = c.where("c_custkey % 40 > 3").selectExpr("cast(c_custkey as string) absorbed", "cast(c_custkey - 3 as string) target", "true is_active")
    a = c.selectExpr("cast(c_custkey as string) key", "concat('UNC-', c_custkey) alias", "c_custkey % 2 = 1 is_active")
    return L.aliases(c.where("c_custkey % 10 = 1").selectExpr("cast(c_custkey as string) key"), r, a)


ASKED = Literal(
    "asked",
    "request int, entity_type string, entity_id string, action string, rationale string, passage string, after_value string, proposed_by string",
    [
        (1, "narrator", "n1", "accept", "well attested in both", "p1", '{"name": "malik", "status": "low"}', "u"), (2, "narrator", "n1", "delete", "well attested in both", "p1", "{}", "u"), (3, "narrator", "n1", "merge", "short", "p1", "{}", "u"),
        (4, "narrator", "n1", "merge", "well attested in both", "p1", "[1]", "u"), (5, "narrator", "n9", "merge", "well attested in both", "p1", "{}", "u"), (6, "narrator", "n1", "merge", "well attested in both", "p9", "{}", "u"),
        (7, "rijal_entry", "e1", "verify", "well attested in both", "p2", "{}", "u"), (8, "rijal_entry", "e1", "verify", "well attested in both", "p1", '{"id":"e1","head":"malik"}', "u"), (9, "rijal_entry", "e1", "verify", "well attested in both", "p1", '{"head":"malik b anas","id":"e1"}', "u"),
        (10, "narrator", "n1", "accept", "well attested in both", "p1", None, "u"),
    ],
)
REVISIONS = Literal("revisions", "revision_id int, entity_type string, entity_id string, revision_index int, after_value string, reverts_revision_id int", [(1, "narrator", "n1", 1, '{"name":"malik"}', None), (2, "narrator", "n1", 2, '{"name":"anas"}', None), (3, "narrator", "n1", 3, '{"name":"malik"}', 2)])


@given(
    """SELECT * FROM (VALUES (1, NULL, '{"name":"malik"}', '{"name":"malik","status":"low"}', 3, false), (2, 'unknown-action', NULL, NULL, NULL, NULL), (3, 'rationale-too-short', NULL, NULL, NULL, NULL), (4, 'no-object', NULL, NULL, NULL, NULL), (5, 'unknown-entity', NULL, NULL, NULL, NULL),
(6, 'unknown-passage', NULL, NULL, NULL, NULL), (7, 'passage-of-another', NULL, NULL, NULL, NULL), (8, 'no-change', NULL, NULL, NULL, NULL), (9, NULL, '{"head":"malik","id":"e1"}', '{"head":"malik b anas","id":"e1"}', NULL, true), (10, 'no-object', NULL, NULL, NULL, NULL)) v(request, code, before, after, baseline, requires_second)"""
)
def proposal_checks(spark, d):
    """New proposals against snapshots, revisions and the passages that bear on their entities."""
    df = spark.createDataFrame
    snap = L.snapshots("narrator", df([("n1", "m")], "id string, name string"), ["id", "name"]).unionByName(L.snapshots("rijal_entry", df([("e1", "malik")], "id string, head string"), ["id", "head"]))
    bears = L.belongings({"rijal_entry": df([("e1", "p1")], "id string, passage string")}, {}, df([("narrator", "n1", "p1"), ("rijal_entry", "e1", "p2")], "entity_type string, entity_id string, passage string"))
    out = L.new_proposals(ASKED.df(spark), L.current_values(snap, REVISIONS.df(spark)), df([("p1",), ("p2",)], "passage string"), bears)
    return out.select("request", "code", "before", "after", "baseline", "requires_second")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'deleted' ELSE 'changed' END AS code FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0")
def append_only_guard(spark, d):
    c = t(spark, d, "customer")
    after = c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return L.appended_only(c, after, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'deleted' WHEN c_custkey % 11 = 0 THEN 'changed' ELSE 'set-twice' END AS code FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0")
def merge_guard(spark, d):
    """An approved merge may only be marked as taken back, and that once."""
    c = t(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 13 == 0, "u").alias("reverted_by"))
    after = c.where("c_custkey % 7 <> 0").withColumns({"c_name": F.when(F.col("c_custkey") % 11 == 0, "x").otherwise(F.col("c_name")), "reverted_by": F.lit("v")})
    return L.changed_but(c, after, "c_custkey", ["reverted_by"])


@query("SELECT o_orderkey, 'o_custkey' AS \"column\", o_custkey AS editor FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT o_orderkey, 'second', o_custkey + 1 FROM orders WHERE (o_custkey + 1) % 10 = 0")
def machine_reviewers(spark, d):
    """Places of a reviewer that a machine's account stands in."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") + 1).alias("second"))
    e = o.select(F.explode(F.array("o_custkey", "second")).alias("editor_id")).distinct().withColumn("is_machine", F.col("editor_id") % 10 == 0)
    return L.by_machines(o, "o_orderkey", ["o_custkey", "second"], e)


LINKS = Literal(
    "links",
    "id int, subject string, object string, evidence_kind string, type string, chain string, subject_occurrence int, object_occurrence int, entry string, phrase string, subject_date int, object_date int, valid_from int, valid_to int, score double, level string, origin string, method string, reviewed_by string, reviewed_at string, review_status string",
    [
        (1, "a", "b", "isnad_link", "transmitted_from", "c1", 1, 2, None, None, None, None, None, None, 0.8, "medium", "machine", "parser", None, None, "machine_unreviewed"),
        (2, "a", "a", "isnad_link", "transmitted_from", "c1", 1, None, None, None, None, None, 120, 100, 0.95, "medium", "machine", "manual", "u", None, "accepted"),
        (3, "a", "b", "chronology_only", "teacher", "c1", None, None, None, None, 1, None, None, None, None, "verified", "machine", "parser", None, None, "in_review"),
        (4, "a", "b", "rijal_statement", "teacher", None, 3, 3, None, None, None, None, None, None, 0.5, "low", "machine", "parser", None, None, "accepted"),
        (5, "a", "b", "chronology_only", "contemporary", None, None, None, None, None, 1, 2, 100, 110, None, "verified", "editorial", "manual", "u", "2026", "accepted"),
    ],
)


@given("SELECT * FROM (VALUES ('distinct_persons', 1::BIGINT), ('valid_range', 1), ('isnad_needs_positions', 1), ('statement_needs_passage', 1), ('chronology_has_no_chain', 1), ('chronology_needs_dates', 1), ('chronology_is_never_transmission', 1), ('distinct_occurrences', 1), ('level_threshold', 1), ('verified_is_editorial', 1), ('score_is_machine', 1), ('review_pair', 1), ('decision_needs_reviewer', 1)) v(rule, n)")
def relationship_constraints(spark, d):
    return editorial.violations(LINKS.df(spark), L.relationship_rules())


@query("SELECT l_orderkey, l_linenumber, l_suppkey, first FROM (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_quantity > 40) JOIN (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) USING (l_orderkey, l_suppkey)")
def filled_positions(spark, d):
    """Occurrences of a link's ends filled in from its chain."""
    li = t(spark, d, "lineitem")
    links = li.where("l_quantity > 40").selectExpr("l_orderkey chain", "l_linenumber", "l_suppkey subject", "-1L object", "cast(null as int) subject_occurrence", "cast(null as int) object_occurrence")
    out = L.filled_positions(links, li.selectExpr("l_linenumber id", "l_orderkey chain", "l_suppkey person"))
    return out.select(F.col("chain").alias("l_orderkey"), "l_linenumber", F.col("subject").alias("l_suppkey"), F.col("subject_occurrence").alias("first"))


RELEASES = Literal("releases", "release_id string, is_active boolean, built_at string, activated_at string", [("r1", False, "2026-01", "2026-02"), ("r2", False, "2026-02", "2026-05"), ("r3", True, "2026-03", "2026-06"), ("r4", False, "2026-04", None)])


@given("SELECT 'r2' AS release_id, 5::BIGINT AS n, 1::BIGINT AS active")
def release_rollback(spark, d):
    """The release to go back to, and the table after it went active again beside a new one."""
    from tesserae.operators.workflow import activate

    r = L.register(RELEASES.df(spark), "r5", "2026-07")
    target = L.rollback_target(r).first()["release_id"]
    return activate(r, target, "2026-08").agg(F.max(F.when(F.col("is_active"), F.col("release_id"))).alias("release_id"), F.count("*").alias("n"), F.count_if("is_active").alias("active"))
