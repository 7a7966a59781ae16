"""Editors' sessions, proposals that become revisions, releases, and the layers of a route graph."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def authenticate(requests: DataFrame, credentials: DataFrame, editors: DataFrame, roles: DataFrame, now: Column) -> DataFrame:
    """requests (request_id, authorization) with editor_id and status: 401 without a valid token of an active person, 403
    without a role that reviews, else 200. credentials (token_sha256, editor_id, expires_at, revoked_at), editors
    (editor_id, is_active, is_machine), roles (editor_id, may_review, revoked_at). Tokens have 32 to 512 characters."""
    token = F.regexp_extract("authorization", r"^(?i:Bearer)\s+(\S{32,512})$", 1)
    valid = credentials.where("revoked_at is null").where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    people = valid.join(editors.where("is_active and not is_machine"), "editor_id").select("token_sha256", "editor_id")
    review = roles.where("revoked_at is null").groupBy("editor_id").agg(F.bool_or("may_review").alias("may_review"))
    known = people.join(review, "editor_id", "left")
    out = requests.withColumn("token_sha256", F.when(token != "", F.sha2(token, 256))).join(known, "token_sha256", "left")
    return out.select("request_id", "editor_id", F.when(F.col("editor_id").isNull(), 401).when(F.col("may_review"), 200).otherwise(403).alias("status"))


def finalize(proposals: DataFrame, revisions: DataFrame, permissions: DataFrame) -> DataFrame:
    """Each proposal (proposal_id, entity_id, action, proposed_by, approver, baseline_revision_id) with status and, for
    those that become a revision, revision_index and approved_by. revisions (revision_id, entity_id, proposal_id,
    revision_index, is_active), permissions (editor_id, may_merge, may_verify). Merging and verifying take a
    permission and a second person; a proposal whose entity has moved on since its baseline is stale."""
    done = revisions.where("proposal_id is not null").select("proposal_id", F.lit(True).alias("done")).distinct()
    heads = revisions.groupBy("entity_id").agg(F.max("revision_index").alias("top"), F.max_by("revision_id", F.when(F.col("is_active"), F.col("revision_index"))).alias("head"))
    out = proposals.join(done, "proposal_id", "left").join(heads, "entity_id", "left").join(permissions.withColumnRenamed("editor_id", "approver"), "approver", "left")
    sensitive = F.col("action").isin("merge", "verify")
    allowed = F.when(F.col("action") == "merge", F.col("may_merge")).when(F.col("action") == "verify", F.col("may_verify")).otherwise(True)
    status = (
        F.when(F.coalesce("done", F.lit(False)), "already-finalized").when(~F.coalesce(allowed, F.lit(False)), "role-missing")
        .when(sensitive & (F.col("proposed_by") == F.col("approver")), "second-editor-required")
        .when(~F.col("head").eqNullSafe(F.col("baseline_revision_id")), "stale").otherwise("finalized")
    )
    ok = F.col("status") == "finalized"
    out = out.withColumn("status", status)
    return out.select("proposal_id", "entity_id", "status", F.when(ok, F.coalesce("top", F.lit(0)) + 1).alias("revision_index"), F.when(ok & sensitive, F.col("approver")).alias("approved_by"))


def revert(revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """New rows that undo the wanted (revision_id): before and after swapped, the index after the entity's last. A
    revision that was reverted before gives no row; several of one entity follow each other by revision_id."""
    reverted = revisions.where("reverts_revision_id is not null").select(F.col("reverts_revision_id").alias("revision_id"))
    tops = revisions.groupBy("entity_id").agg(F.max("revision_index").alias("top"))
    rows = revisions.join(wanted.select("revision_id").distinct(), "revision_id", "left_semi").join(reverted, "revision_id", "left_anti").join(tops, "entity_id")
    nth = F.row_number().over(Window.partitionBy("entity_id").orderBy("revision_id"))
    return rows.select("entity_id", F.lit("revert").alias("action"), F.col("after_value").alias("before_value"), F.col("before_value").alias("after_value"), F.col("revision_id").alias("reverts_revision_id"), (F.col("top") + nth).alias("revision_index"))


def activate(releases: DataFrame, release_id: str, at: str) -> DataFrame:
    """releases (release_id, is_active, activated_at) with exactly that one active. An unknown release is an error."""
    if releases.where(F.col("release_id") == release_id).limit(1).count() == 0:
        raise ValueError(f"no such release: {release_id}")
    on = F.col("release_id") == release_id
    return releases.withColumns({"is_active": on, "activated_at": F.when(on, F.lit(at)).otherwise(F.col("activated_at"))})


def status_level(status: Column, score: Column) -> Column:
    """The level of an identity: its own status, and for a candidate that of its score."""
    by_score = F.when(score >= 0.90, "high").when(score >= 0.70, "medium").when(score.isNotNull(), "low")
    return F.coalesce(F.when(status.isin("verified", "unresolved", "conflict"), status).when(status == "candidate", by_score), F.lit("unresolved"))


def checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local session gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesserae-"))


def layers(nodes: DataFrame, edges: DataFrame, columns: int = 6) -> DataFrame:
    """nodes (node, place) with depth, the longest path from a node without predecessors along edges (source, target).

    A round places the nodes whose predecessors all are placed and drops their edges, so that round and depth are one.
    What a cycle holds back lies one below its deepest placed predecessor, else at place % columns. Edges between
    unknown nodes are left out, rows that repeat count once. Each round is checkpointed."""
    checkpoint_dir(nodes.sparkSession)
    known = nodes.select("node").distinct()
    edges = edges.select("source", "target").distinct()
    for side in ("source", "target"):
        edges = edges.join(known.withColumnRenamed("node", side), side, "left_semi")
    open_, left, placed, below, depth = known, edges.checkpoint(), None, None, 0
    while True:
        free = open_.join(left.select(F.col("target").alias("node")), "node", "left_anti").checkpoint()
        if free.limit(1).count() == 0:
            break
        out = left.join(free.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node"), F.lit(depth + 1).alias("least"))
        rows = free.withColumn("depth", F.lit(depth))
        placed, below = (rows, out) if placed is None else (placed.unionByName(rows), below.unionByName(out))
        left = left.join(free.withColumnRenamed("node", "source"), "source", "left_anti").checkpoint()
        open_ = open_.join(free, "node", "left_anti").checkpoint()
        depth += 1
    if placed is None:
        return nodes.select("node", (F.col("place") % columns).cast("int").alias("depth"))
    least = below.groupBy("node").agg(F.max("least").alias("least"))
    return nodes.join(placed, "node", "left").join(least, "node", "left").select("node", F.coalesce("depth", "least", (F.col("place") % columns).cast("int")).alias("depth"))
