"""Bindings of the editors' workflow, the route layers and the entry fields, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import entries
from tesserae.operators import workflow
from tesserae.plans.catalogue import query, t


@query(
    """WITH q AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE sha256('key-' || lpad(CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 7 = 0 THEN 8 ELSE 32 END, '0')) END AS h, o_orderkey % 7 = 0 AS short FROM orders),
k AS (SELECT c_custkey AS editor_id, sha256('key-' || lpad(CAST(c_custkey AS VARCHAR), 32, '0')) AS h FROM customer WHERE c_custkey % 13 <> 0 AND (c_custkey % 17 <> 0) AND c_custkey % 11 <> 0 AND c_custkey % 4 <> 0)
SELECT request_id, editor_id, CASE WHEN editor_id IS NULL THEN 401 WHEN editor_id % 3 = 0 THEN 200 ELSE 403 END::INTEGER AS status FROM q LEFT JOIN k ON q.h = k.h AND NOT short"""
)
def editor_sessions(spark, d):
    key = lambda n, w: F.concat(F.lit("key-"), F.lpad(F.col(n).cast("string"), w, "0"))
    bearer = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Bearer ").otherwise("bearer "), F.when(F.col("o_orderkey") % 7 == 0, key("o_custkey", 8)).otherwise(key("o_custkey", 32)))
    requests = t(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 5 == 0, "Basic x").otherwise(bearer).alias("authorization"))
    c, now = t(spark, d, "customer"), F.lit("2026-01-01").cast("timestamp")
    credentials = c.select(F.sha2(key("c_custkey", 32), 256).alias("token_sha256"), F.col("c_custkey").alias("editor_id"), F.expr("case when c_custkey % 13 = 0 then timestamp'2025-01-01' when c_custkey % 2 = 0 then timestamp'2027-01-01' end expires_at"), F.expr("case when c_custkey % 17 = 0 then timestamp'2025-01-01' end revoked_at"))
    editors = c.selectExpr("c_custkey editor_id", "c_custkey % 11 <> 0 is_active", "c_custkey % 4 = 0 is_machine")
    roles = c.selectExpr("c_custkey editor_id", "c_custkey % 3 = 0 may_review", "cast(null as timestamp) revoked_at")
    return workflow.authenticate(requests, credentials, editors, roles, now)


_REV = """r AS (SELECT o_orderkey AS revision_id, o_custkey AS entity_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS proposal_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision_index FROM orders WHERE o_orderkey % 4 = 0)"""


def _revisions(spark, d):
    return t(spark, d, "orders").where("o_orderkey % 4 = 0").selectExpr(
        "o_orderkey revision_id", "o_custkey entity_id", "case when o_orderkey % 3 = 0 then o_orderkey + 1 end proposal_id", "row_number() over (partition by o_custkey order by o_orderkey) revision_index",
        "true is_active", "o_orderstatus before_value", "o_orderpriority after_value", "case when o_orderkey % 5 = 0 then o_orderkey - 4 end reverts_revision_id",
    )


@query(
    f"""WITH {_REV}, h AS (SELECT entity_id, max(revision_index) AS top, max_by(revision_id, revision_index) AS head FROM r GROUP BY entity_id),
p AS (SELECT o_orderkey AS proposal_id, o_custkey AS entity_id, CASE o_orderkey % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'verify' ELSE 'accept' END AS action, o_orderkey % 10 AS proposed_by, o_custkey % 10 AS approver, o_orderkey % 6 <> 2 AS fresh FROM orders WHERE o_orderkey % 4 <> 0),
s AS (SELECT p.*, top, CASE WHEN proposal_id IN (SELECT proposal_id FROM r WHERE proposal_id IS NOT NULL) THEN 'already-finalized'
WHEN action = 'merge' AND approver % 2 = 0 OR action = 'verify' AND approver % 3 = 0 THEN 'role-missing' WHEN action <> 'accept' AND proposed_by = approver THEN 'second-editor-required'
WHEN NOT fresh AND head IS NOT NULL THEN 'stale' ELSE 'finalized' END AS status FROM p LEFT JOIN h USING (entity_id))
SELECT proposal_id, entity_id, status, CASE WHEN status = 'finalized' THEN (coalesce(top, 0) + 1)::BIGINT END AS revision_index, CASE WHEN status = 'finalized' AND action <> 'accept' THEN approver END AS approved_by FROM s"""
)
def proposal_finalization(spark, d):
    rev = _revisions(spark, d).withColumn("revision_index", F.col("revision_index").cast("long"))
    heads = rev.groupBy("entity_id").agg(F.max_by("revision_id", "revision_index").alias("now"))
    p = t(spark, d, "orders").where("o_orderkey % 4 <> 0").selectExpr("o_orderkey proposal_id", "o_custkey entity_id", "case o_orderkey % 3 when 0 then 'merge' when 1 then 'verify' else 'accept' end action", "o_orderkey % 10 proposed_by", "o_custkey % 10 approver")
    p = p.join(heads, "entity_id", "left").withColumn("baseline_revision_id", F.expr("case when proposal_id % 6 <> 2 then now end")).drop("now")
    return workflow.finalize(p, rev, spark.range(10).selectExpr("id editor_id", "id % 2 = 1 may_merge", "id % 3 <> 0 may_verify"))


@query(
    f"""WITH {_REV}, top AS (SELECT entity_id, max(revision_index) AS top FROM r GROUP BY entity_id),
w AS (SELECT o.o_orderkey AS id, r.entity_id, o_orderstatus AS b, o_orderpriority AS a FROM orders o JOIN r ON r.revision_id = o.o_orderkey WHERE o_orderkey % 8 = 0 AND o_orderkey + 4 NOT IN (SELECT revision_id FROM r WHERE revision_id % 5 = 0))
SELECT entity_id, 'revert' AS action, a AS before_value, b AS after_value, id AS reverts_revision_id, (top + row_number() OVER (PARTITION BY entity_id ORDER BY id))::INTEGER AS revision_index FROM w JOIN top USING (entity_id)"""
)
def revision_revert(spark, d):
    rev = _revisions(spark, d)
    return workflow.revert(rev, rev.where("revision_id % 8 = 0"))


@query(
    """SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2) THEN CASE event_id % 10 WHEN 0 THEN 'verified' WHEN 1 THEN 'conflict' ELSE 'unresolved' END WHEN event_id % 10 = 3 THEN 'unresolved'
WHEN value / 100 >= 0.9 THEN 'high' WHEN value / 100 >= 0.7 THEN 'medium' WHEN value IS NOT NULL THEN 'low' ELSE 'unresolved' END AS level FROM events"""
)
def status_levels(spark, d):
    status = F.expr("case event_id % 10 when 0 then 'verified' when 1 then 'conflict' when 2 then 'unresolved' when 3 then null else 'candidate' end")
    return t(spark, d, "events").select("event_id", workflow.status_level(status, F.col("value") / 100).alias("level"))


@query(
    """WITH RECURSIVE m AS (SELECT max(p_partkey) AS m FROM part), e AS (SELECT p_partkey AS s, 2 * p_partkey AS t FROM part, m WHERE p_partkey > 0 AND 2 * p_partkey <= m UNION SELECT p_partkey, 3 * p_partkey + 1 FROM part, m WHERE p_partkey % 5 = 1 AND 3 * p_partkey + 1 <= m),
w(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT t FROM e) UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON e.s = w.node) SELECT node, max(depth)::INTEGER AS depth FROM w GROUP BY node"""
)
def route_layers(spark, d):
    part = t(spark, d, "part")
    a = part.where("p_partkey > 0").selectExpr("p_partkey source", "2 * p_partkey target")
    b = part.where("p_partkey % 5 = 1").selectExpr("p_partkey source", "3 * p_partkey + 1 target")
    return workflow.layers(part.selectExpr("p_partkey node", "p_partkey place"), a.unionByName(b))


@query(
    r"""WITH l AS (SELECT page_id, unnest(string_split_regex(html, '\r?\n')) AS x, generate_subscripts(string_split_regex(html, '\r?\n'), 1) AS i FROM pages),
s AS (SELECT page_id, i, regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS x FROM l),
p AS (SELECT page_id, i, regexp_replace(split_part(x, ':', 1), '[ \t\n\x0B\f\r]+$', '', 'g') AS key, regexp_replace(substr(x, instr(x, ':') + 1), '^[ \t\n\x0B\f\r]+', '', 'g') AS v FROM s WHERE instr(x, ':') > 1)
SELECT page_id, key, string_agg(v, chr(31) ORDER BY i) AS "values" FROM p WHERE v <> '' GROUP BY page_id, key"""
)
def metadata_lines(spark, d):
    m = t(spark, d, "pages").select("page_id", F.explode(entries.metadata_fields(F.col("html"))).alias("key", "v"))
    return m.select("page_id", "key", F.array_join("v", "\x1f").alias("values"))


@query("SELECT c_custkey, trim(regexp_replace(translate(c_name, 'Cus', '<>-'), '#', '[23]', 'g')) AS decoded FROM customer")
def byte_decoding(spark, d):
    table = {b: {"C": "<", "u": ">", "s": "-"}.get(chr(b), chr(b)) for b in range(32, 127) if chr(b) != "#"}
    return t(spark, d, "customer").select("c_custkey", entries.decode_bytes(F.encode("c_name", "utf-8"), table).alias("decoded"))


@query(
    """WITH a AS (SELECT l_orderkey AS entry, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, CASE WHEN l_partkey % 2 = 0 THEN 'death' ELSE 'birth' END AS kind, CAST(l_quantity AS INTEGER) AS y, l_suppkey % 3 <> 0 AS x, l_suppkey % 5 = 0 AS near, coalesce(l_linenumber % 3 = 0, false) AS bound FROM lineitem),
c AS (SELECT entry, arg_min(y, i) FILTER (kind = 'death' AND x AND NOT near AND NOT bound) AS death_year, arg_min(y, i) FILTER (kind = 'death' AND x AND bound) AS death_bound, arg_min(y, i) FILTER (kind = 'birth' AND x) AS birth_year FROM a GROUP BY entry)
SELECT *, round(0.35 + 0.3 * 0.9 + CASE WHEN death_year IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN entry % 2 = 0 THEN 0.07 ELSE 0 END + CASE WHEN entry % 3 = 0 THEN 0.05 ELSE 0 END, 3)::DOUBLE AS confidence FROM c"""
)
def entry_dates(spark, d):
    item = F.expr("struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, case when l_partkey % 2 = 0 then 'death' else 'birth' end kind, cast(l_quantity as int) value_ah, l_suppkey % 3 <> 0 explicit, false shared, l_suppkey % 5 = 0 approximate, case when l_linenumber % 3 = 0 then 'range' end qualifier)")
    e = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entry")).agg(F.array_sort(F.collect_list(item)).alias("a"))
    e = e.select("entry", entries.date_candidates(F.col("a")).alias("c")).select("entry", "c.*")
    return e.withColumn("confidence", entries.entry_confidence(F.lit(0.9), F.col("death_year").isNotNull(), F.col("entry") % 2 == 0, F.col("entry") % 3 == 0))
