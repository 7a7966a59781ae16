"""The life of identities and proposals: new proposals and their checks, snapshots, guards, merges and splits, releases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.identifiers import canonical_json

#: What may be proposed, which of it takes two persons, the least length of a rationale, the most of a value.
ACTIONS, SENSITIVE, LEAST_RATIONALE, MOST_JSON = ["accept", "reject", "merge", "verify"], ["merge", "verify"], 12, 16_384
#: Entities whose own row names their passage.
DIRECT = ["rijal_entry", "date_assertion", "relationship_assertion"]
HOPS = 8


def snapshots(kind: str, rows: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(entity_type, entity_id, value) of entities of one kind: the columns that a proposal is measured against, as JSON."""
    return rows.select(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def current_values(snapshot: DataFrame, revisions: DataFrame) -> DataFrame:
    """(entity_type, entity_id, value, baseline): the value after the last revision that none has reverted, else the snapshot's.
    revisions (revision_id, entity_type, entity_id, revision_index, after_value, reverts_revision_id)."""
    undone = revisions.where("reverts_revision_id is not null").select(F.col("reverts_revision_id").alias("revision_id"))
    last = revisions.join(undone, "revision_id", "left_anti").groupBy("entity_type", "entity_id").agg(F.max_by(F.struct("revision_id", "after_value"), "revision_index").alias("r"))
    met = snapshot.join(last, ["entity_type", "entity_id"], "left")
    return met.select("entity_type", "entity_id", F.coalesce("r.after_value", "value").alias("value"), F.col("r.revision_id").alias("baseline"))


def belongings(direct: dict[str, DataFrame], routes: dict[str, DataFrame], evidence: DataFrame) -> DataFrame:
    """(entity_type, entity_id, passage): which passages bear on which entity. direct: rows with id and passage; routes: (id,
    passage) found by joins of their own; evidence: (entity_type, entity_id, passage) of all other kinds."""
    one = lambda kind, rows: rows.select(F.lit(kind).alias("entity_type"), F.col("id").cast("string").alias("entity_id"), "passage")
    known = [*direct, *routes]
    parts = [one(k, r) for k, r in {**direct, **routes}.items()] + [evidence.where(~F.col("entity_type").isin(known)).select("entity_type", F.col("entity_id").cast("string").alias("entity_id"), "passage")]
    return reduce(lambda a, b: a.unionByName(b), parts).where("passage is not null").distinct()


def new_proposals(asked: DataFrame, current: DataFrame, passages: DataFrame, bears: DataFrame) -> DataFrame:
    """asked (request, entity_type, entity_id, action, rationale, passage, after_value, proposed_by) with code, the first check
    that fails, and, without one, before, after, baseline and requires_second."""
    rows = asked.withColumn("after", canonical_json(F.col("after_value")))
    met = rows.join(current.withColumnRenamed("value", "before"), ["entity_type", "entity_id"], "left").join(passages.select("passage", F.lit(True).alias("_p")).distinct(), "passage", "left")
    met = met.join(bears.withColumn("_b", F.lit(True)), ["entity_type", "entity_id", "passage"], "left").withColumn("before", canonical_json(F.col("before")))
    code = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown-action").when(F.length(F.trim(F.coalesce("rationale", F.lit("")))) < LEAST_RATIONALE, "rationale-too-short")
        .when(~F.coalesce(F.startswith("after", F.lit("{")), F.lit(False)), "no-object").when(F.length("after") > MOST_JSON, "too-large").when(F.col("before").isNull(), "unknown-entity")
        .when(F.col("_p").isNull(), "unknown-passage").when(F.col("_b").isNull(), "passage-of-another").when(F.col("before") == F.col("after"), "no-change")
    )
    ok = F.col("code").isNull()
    met = met.withColumn("code", code)
    return met.select("request", "entity_type", "entity_id", "code", *[F.when(ok, F.col(c)).alias(c) for c in ("before", "after", "baseline")], F.when(ok, F.col("action").isin(*SENSITIVE)).alias("requires_second"))


def appended_only(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, code) of rows that a later state of an append-only table lost or changed. Rows are compared as a whole."""
    row = lambda d, n: d.select(key, F.xxhash64(*sorted(d.columns)).alias(n))
    met = row(before, "a").join(row(after, "b"), key, "left")
    return met.select(key, F.when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed").alias("code")).where("code is not null")


def changed_but(before: DataFrame, after: DataFrame, key: str, free: list[str]) -> DataFrame:
    """(key, code) of rows that changed in other columns than those that may still be set; a set one may not be set anew."""
    fixed = [c for c in before.columns if c != key and c not in free]
    met = before.select(key, *[F.col(c).alias(f"a_{c}") for c in fixed + free]).join(after.select(key, *[F.col(c).alias(f"b_{c}") for c in fixed + free]), key, "left")
    differ = lambda cs: reduce(lambda x, y: x | y, [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in cs], F.lit(False))
    gone = reduce(lambda x, y: x & y, [F.col(f"b_{c}").isNull() for c in fixed])
    again = reduce(lambda x, y: x | y, [F.col(f"a_{c}").isNotNull() & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in free], F.lit(False))
    return met.select(key, F.when(gone, "deleted").when(differ(fixed), "changed").when(again, "set-twice").alias("code")).where("code is not null")


def by_machines(rows: DataFrame, key: str, columns: list[str], editors: DataFrame) -> DataFrame:
    """(key, column, editor): places of a person that a machine's account stands in."""
    who = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("editor")) for c in columns])).alias("x")).select(key, "x.*")
    return who.join(editors.where("is_machine").select(F.col("editor_id").alias("editor")), "editor", "left_semi")


def relationship_rules() -> dict[str, Column]:
    """The rules of a relationship, by name; one that is null holds. Kinds of evidence never stand in for each other."""
    kind = lambda k: F.col("evidence_kind") == k
    chronology, both = kind("chronology_only"), F.col("subject_occurrence").isNotNull() & F.col("object_occurrence").isNotNull()
    return {
        "distinct_persons": F.col("subject") != F.col("object"),
        "valid_range": F.col("valid_from") <= F.col("valid_to"),
        "isnad_needs_positions": ~kind("isnad_link") | (F.col("chain").isNotNull() & both),
        "statement_needs_passage": ~kind("rijal_statement") | F.col("entry").isNotNull() | F.col("phrase").isNotNull(),
        "chronology_has_no_chain": ~chronology | (F.col("chain").isNull() & F.col("subject_occurrence").isNull() & F.col("object_occurrence").isNull()),
        "chronology_needs_dates": ~chronology | (F.col("subject_date").isNotNull() & F.col("object_date").isNotNull()),
        "chronology_is_never_transmission": ~chronology | (F.col("type") == "contemporary"),
        "distinct_occurrences": F.col("subject_occurrence") != F.col("object_occurrence"),
        **state_rules(),
    }


def state_rules() -> dict[str, Column]:
    """The rules of every judged row: levels by their scores, verification and decisions by persons, scores by machines."""
    s, lv = F.col("score"), F.col("level")
    by_score = (lv.isin("verified", "unresolved", "conflict")) | ((lv == "high") & (s >= 0.90)) | ((lv == "medium") & (s >= 0.70) & (s < 0.90)) | ((lv == "low") & (s < 0.70))
    return {
        "level_threshold": s.isNull() | by_score,
        "verified_is_editorial": (lv != "verified") | ((F.col("origin") == "editorial") & F.col("reviewed_by").isNotNull()),
        "score_is_machine": s.isNull() | (F.col("method") != "manual"),
        "review_pair": F.col("reviewed_by").isNull() == F.col("reviewed_at").isNull(),
        "decision_needs_reviewer": F.col("review_status").isin("machine_unreviewed", "in_review") | F.col("reviewed_by").isNotNull(),
    }


def redirects_of(events: DataFrame) -> DataFrame:
    """(absorbed, target, cause, is_active) of merges and splits (event, kind, absorbed, target, at): a merge redirects, a split
    takes back the redirect that stood; every one stays on record, at most the last of a key is active."""
    w = Window.partitionBy("absorbed").orderBy(F.desc("at"), F.desc("event"))
    last = events.withColumn("_n", F.row_number().over(w))
    return last.where("kind = 'merge'").select("absorbed", "target", F.col("event").alias("cause"), (F.col("_n") == 1).alias("is_active"))


def resolved(asked: DataFrame, redirects: DataFrame, hops: int = HOPS) -> DataFrame:
    """asked (key) with target, path (keys gone through, joined by >) and truncated, along active redirects (absorbed,
    target). A step joins the redirects once; there are at most `hops`."""
    step = redirects.where("is_active").select(F.col("absorbed").alias("_a"), F.col("target").alias("_t"))
    out = asked.select("key", F.col("key").alias("target"), F.array().cast("array<string>").alias("path"))
    for _ in range(hops):
        on = F.col("_t").isNotNull()
        met = out.join(step, F.col("target") == F.col("_a"), "left")
        out = met.select("key", F.when(on, F.col("_t")).otherwise(F.col("target")).alias("target"), F.when(on, F.concat("path", F.array("target"))).otherwise(F.col("path")).alias("path"))
    more = step.select(F.col("_a").alias("target"), F.lit(True).alias("_more"))
    return out.join(more, "target", "left").select("key", "target", F.array_join("path", ">").alias("path"), F.coalesce("_more", F.lit(False)).alias("truncated"))


def aliases(asked: DataFrame, redirects: DataFrame, known: DataFrame, hops: int = HOPS) -> DataFrame:
    """(key, alias): the active aliases (key, alias, is_active) of each key and of all that it has absorbed, however many
    steps away, up to `hops`."""
    back = redirects.where("is_active").select(F.col("target").alias("_t"), F.col("absorbed").alias("_a"))
    level = asked.select("key", F.col("key").alias("person")).distinct()
    found = level
    for _ in range(hops):
        level = level.join(back, F.col("person") == F.col("_t")).select("key", F.col("_a").alias("person"))
        found = found.unionByName(level)
    return found.distinct().join(known.where("is_active").select(F.col("key").alias("person"), "alias"), "person").select("key", "alias").distinct()


def register(releases: DataFrame, release_id: str, built_at: str) -> DataFrame:
    """releases with one more, not active. A known id is an error."""
    if releases.where(F.col("release_id") == release_id).limit(1).count():
        raise ValueError(f"release exists: {release_id}")
    row = releases.sparkSession.createDataFrame([(release_id, False, built_at, None)], "release_id string, is_active boolean, built_at string, activated_at string")
    return releases.unionByName(row)


def rollback_target(releases: DataFrame) -> DataFrame:
    """The release that was active last and is not now; one that never was is none."""
    return releases.where("not is_active and activated_at is not null").orderBy(F.desc("activated_at"), F.desc("release_id")).limit(1)


def filled_positions(links: DataFrame, occurrences: DataFrame) -> DataFrame:
    """links (chain, subject, object, and both occurrences) with the occurrences of their ends in their chain, where they have
    none. occurrences (id, chain, person)."""
    for end in ("subject", "object"):
        known = occurrences.groupBy(F.col("chain").alias("_c"), F.col("person").alias("_p")).agg(F.min("id").alias("_id"))
        met = links.join(known, (F.col("chain") == F.col("_c")) & (F.col(end) == F.col("_p")), "left")
        links = met.withColumn(f"{end}_occurrence", F.coalesce(f"{end}_occurrence", "_id")).drop("_c", "_p", "_id")
    return links
