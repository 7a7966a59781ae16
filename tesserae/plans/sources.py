"""Bindings of sources and sinks to the driver's tables and to files of their own, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.plans.catalogue import given, query, t
from tesserae.plans.literal import Literal
from tesserae.plans.search import _CONTENT, _content
from tesserae.sources import archive as A
from tesserae.sources.scratch import folder

REGISTRY = Literal("registry", "key string, kind string, rights string, fields array<string>", [("bukhari", "source", "cleared", ["isnad", "matn"]), ("external-texts", "external", "review-required", [])])


_scratch = folder


@given("SELECT 'source:' || key AS id, key, kind, rights, fields FROM (VALUES ('bukhari', 'source', 'cleared', '[\"isnad\",\"matn\"]'), ('external-texts', 'external', 'review-required', '[]')) v(key, kind, rights, fields)")
def source_works(spark, d):
    return A.source_works(REGISTRY.df(spark))


@query(f"WITH {_CONTENT}, c AS (SELECT source, count(*) FILTER (n_chars > 500) AS a, count(*) FILTER (n_chars <= 500) AS r FROM documents GROUP BY source) SELECT 'batch:' || source || ':' || substr(h, 1, 12) AS id, source, h AS sha256, a + r AS rows, '{{\"accepted\":' || a || ',\"rejected\":' || r || '}}' AS report FROM c JOIN h USING (source)")
def import_batches(spark, d):
    """Provenance by the hash of what was read."""
    c = t(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 500).alias("accepted"), F.count_if(F.col("n_chars") <= 500).alias("rejected"))
    return A.import_batches(c, _content(t(spark, d, "documents"), "source"))


@query("SELECT source AS id, CASE WHEN n % 3 = 0 THEN 'load' WHEN n % 3 = 1 THEN 'reuse' ELSE 'reload' END AS state FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def import_guard(spark, d):
    """Batches to load, to leave, and to load anew."""
    found = t(spark, d, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("rows"))
    known = found.where("rows % 3 <> 0").select("id", F.when(F.col("rows") % 3 == 1, F.col("rows")).otherwise(F.col("rows") + 1).alias("rows"))
    return A.to_reload(known, found)


@query("SELECT c.corpus_order, c.collection, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 0 ELSE 1 END AS corpus_order, lang AS collection FROM documents WHERE lang IN ('en', 'fr')) c GROUP BY ALL")
def written_and_scanned(spark, d):
    """Tables written a work each and scanned again in their order; a missing one is empty."""
    path, docs = _scratch(spark), t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    A.write_relations({k: docs.where(F.col("lang") == k) for k in ("en", "fr")}, path)
    out = A.scan_all(spark, {k: f"{path}/{k}" for k in ("en", "fr", "none")}, "doc_id long, lang string, n_chars long", "collection")
    return out.groupBy("corpus_order", "collection").agg(F.count("*").alias("n"))


@query("SELECT lang, count(DISTINCT n_chars) FILTER (source NOT LIKE 'a%') AS numbers, count(*) AS rows, 0::BIGINT AS unparsed, 100.0::DOUBLE AS accounted FROM documents GROUP BY lang")
def completeness_report(spark, d):
    r = t(spark, d, "documents").withColumn("k", F.when(F.startswith("source", F.lit("a")), "heading").otherwise("hadith"))
    return A.completeness(r, "lang", "n_chars", "k", "heading")


@query(f"WITH {_CONTENT} SELECT substr(sha256(string_agg(source || ':' || h, chr(10) ORDER BY source || ':' || h)), 1, 16) AS data_version, count(*) AS tables FROM h")
def data_versions(spark, d):
    """The version of a set of tables by what they hold."""
    return A.data_version(_content(t(spark, d, "documents"), "source").withColumnRenamed("source", "name"))


CURATED = Literal("curated", "externalId string, collection string, rawIsnad string, matn string", [("1", "b", "مالك ← نافع ← ابن عمر", "x"), ("2", "b", "مالك ←  ← عمر", "y"), ("3", "", "هشام ← أبيه", None), ("3", "m", "هشام", "z")])


@given("SELECT * FROM (VALUES ('2', 'empty-link'), ('3', 'missing-collection'), ('3', 'missing-matn'), ('3', 'duplicate-id')) v(\"externalId\", code)")
def curated_errors(spark, d):
    return A.curated_errors(CURATED.df(spark), ["externalId", "collection", "rawIsnad", "matn"])


@given("SELECT * FROM (VALUES ('1', 0, 'مالك'), ('1', 1, 'نافع'), ('1', 2, 'ابن عمر'), ('2', 0, 'مالك'), ('2', 2, 'عمر'), ('3', 0, 'هشام'), ('3', 1, 'أبيه'), ('3', 0, 'هشام')) v(\"externalId\", position, mention)")
def curated_mentions(spark, d):
    return A.curated_mentions(CURATED.df(spark))


@given("SELECT * FROM (VALUES ('manifest.json', '{\"release_id\":\"r1\",\"data_version\":\"v\",\"tables\":[\"a\",\"b\"]}'), ('register.sql', 'INSERT INTO release (release_id, data_version, is_active) VALUES (''r1'', ''v'', 0);'), ('activate.sql', 'UPDATE release SET is_active = (release_id = ''r1'');'), ('latest.env', 'RELEASE_ID=r1')) v(file, content)")
def release_files(spark, d):
    return A.release_files("r1", spark.createDataFrame([("b",), ("a",)], "name string"), "v")


@query("SELECT s_suppkey, '{\"s_name\":\"' || s_name || '\",\"s_nationkey\":' || s_nationkey || '}' AS body FROM supplier")
def responses(spark, d):
    return A.as_responses(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")


@query("SELECT doc_id, n_chars, coalesce(bool_or(x), false) AS whole, CASE WHEN coalesce(bool_or(x), false) THEN 0.995 ELSE 0.95 END::DOUBLE AS confidence FROM (SELECT doc_id, n_chars, NOT regexp_matches(text || CASE WHEN doc_id % 2 = 0 THEN '[0a]' ELSE '' END, '\\[[0-9a-f]{2}\\]') AS x FROM documents) GROUP BY ALL")
def decoded_texts(spark, d):
    """Whether a decoded text still has unknown bytes."""
    x = A.is_decoded(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "[0a]").otherwise("")))
    return t(spark, d, "documents").select("doc_id", "n_chars", x.alias("x")).select("doc_id", "n_chars", "x.whole", "x.confidence")
