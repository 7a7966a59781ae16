"""Answers of the archive's endpoints over an archive made of the tables' rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import identifiers as I
from tesserae.functions import scalars as S
from tesserae.operators import chains, gold, profiles as P
from tesserae.operators import records, resolve
from tesserae.plans.catalogue import query, t
from tesserae.plans.rendered import NAMES, NISBAS, _pick, _sql
from tesserae.sources import archive as A

# An archive of the tables: a chain for each order, whose links are its lineitems; an entry for each customer, in one of two sources.
_FORM = f"CASE WHEN l_suppkey % 7 = 3 THEN 'أبيه' ELSE {_sql(NAMES)}[((l_suppkey * 3 + l_linenumber) % {len(NAMES)} + 1)::INTEGER] END"
_LINKS = f"""links AS (SELECT 'r' || l_orderkey || '#0' AS chain, 'r' || l_orderkey AS record, l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) - 1 AS position, {_FORM} AS form, l_suppkey % 7 = 3 AS relative FROM lineitem),
named AS (SELECT *, CASE WHEN relative THEN 'ابيه' ELSE form END AS name FROM links),
n AS (SELECT chain, position, name AS a, lead(name) OVER (PARTITION BY chain ORDER BY position) AS b FROM named),
relations AS (SELECT chain, position, a AS src, b AS dst, 'transmitted_from' AS relation FROM n WHERE b IS NOT NULL UNION ALL SELECT chain, position, b, a, 'transmitted_to' FROM n WHERE b IS NOT NULL)"""
_ENTRIES = f"""entries AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'm-' ELSE 't-' END || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'mizan' ELSE 'taqrib' END AS source, c_custkey::INTEGER AS number,
{_sql(NAMES)}[(c_custkey % {len(NAMES)} + 1)::INTEGER] || CASE WHEN c_custkey % 4 = 1 THEN ' بن دينار' ELSE '' END AS name, {_sql(NAMES)}[((c_custkey * 3 + 1) % {len(NAMES)} + 1)::INTEGER] AS teacher,
CASE WHEN c_custkey % 5 < 3 THEN (60 + c_custkey % 90)::INTEGER END AS birth, CASE WHEN c_custkey % 7 > 0 THEN (120 + c_custkey % 90)::INTEGER END AS death, (c_custkey % 60 + 40) / 100.0::DOUBLE AS confidence,
CASE WHEN c_custkey % 2 = 0 THEN 'ابو عبد الله' END AS kunya, (c_custkey % 30)::INTEGER AS page FROM customer)"""
REGISTRY = [("taqrib", "cleared", ["entry_number", "name_surface", "date_assertions", "biographical_fields", "teacher_student_phrases"]), ("mizan", "review-required", ["name_surface", "teacher_student_phrases", "criticism_references"])]


def _links(spark, d):
    k = F.col("l_suppkey")
    form = F.when(k % 7 == 3, F.lit("أبيه")).otherwise(_pick(NAMES, (k * 3 + F.col("l_linenumber")) % len(NAMES)))
    li = chains.positions(t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity"])
    record = F.concat(F.lit("r"), "l_orderkey")
    return li.select(F.concat(record, F.lit("#0")).alias("chain"), record.alias("record"), F.col("l_orderkey").alias("k"), F.col("position").cast("long").alias("position"), form.alias("form"))


def _entries(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(
        k.alias("k"), F.concat(F.when(k % 3 == 0, "m-").otherwise("t-"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "mizan").otherwise("taqrib").alias("source"), k.cast("int").alias("number"),
        F.concat(_pick(NAMES, k % len(NAMES)), F.when(k % 4 == 1, " بن دينار").otherwise("")).alias("name"), F.concat(F.lit("روى عَن "), _pick(NAMES, (k * 3 + 1) % len(NAMES))).alias("text"),
        F.when(k % 5 < 3, 60 + k % 90).cast("int").alias("birth"), F.when(k % 7 > 0, 120 + k % 90).cast("int").alias("death"), ((k % 60 + 40) / 100.0).alias("confidence"), F.when(k % 2 == 0, "ابو عبد الله").alias("kunya"),
        _pick(NAMES, (k * 3 + 1) % len(NAMES)).alias("teacher_phrase"), (k % 30).cast("int").alias("page"),
    )


def _nodes(spark, d):
    x = _links(spark, d)
    return x.withColumn("node", I.bucket_id(F.col("record"), F.substring_index("chain", "#", -1).cast("int"), F.col("position"), F.col("form"))).withColumn("name", S.normalize(F.col("form")))


def _relations(spark, d):
    return chains.adjacency(_nodes(spark, d), "chain", "name", ["position"]).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_LINKS} SELECT chain, position, form, CASE WHEN k % 2 = 0 THEN 'isnad of ' || record ELSE 'isnad withheld' END AS raw FROM links")
def answer_chains(spark, d):
    """The chains of every record; the raw chain is left out where its source is not cleared."""
    x = _links(spark, d).withColumn("raw", F.concat(F.lit("isnad of "), "record")).withColumn("source", F.when(F.col("k") % 2 == 0, "bukhari").otherwise("muslim"))
    reg = spark.createDataFrame([("bukhari", "cleared", ["raw"]), ("muslim", "review-required", ["raw"])], "key string, rights string, fields array<string>")
    return records.gate(x, F.broadcast(reg), "source", ["raw"]).select("chain", "position", "form", F.when(F.col("text_withheld"), "isnad withheld").otherwise(F.col("raw")).alias("raw"))


@query(
    f"""WITH {_ENTRIES} SELECT id, CASE WHEN source = 'taqrib' THEN number END AS number, name, CASE WHEN source = 'taqrib' THEN death END AS death, CASE WHEN source = 'taqrib' THEN kunya END AS kunya, CASE WHEN source = 'taqrib' THEN teacher END AS teacher_phrase,
NULL::INTEGER AS page, source = 'mizan' AS text_withheld, source = 'mizan' AS criticisms_withheld FROM entries"""
)
def public_entries(spark, d):
    """Registry entries behind the licence, field by field."""
    registry = spark.createDataFrame(REGISTRY, "key string, rights string, fields array<string>")
    return records.public_entries(_entries(spark, d), registry, "source").select("id", "number", "name", "death", "kunya", "teacher_phrase", "page", "text_withheld", "criticisms_withheld")


@query(
    f"""WITH {_ENTRIES}, f AS (SELECT * FROM entries WHERE source = 'taqrib' AND teacher = 'نافع' ORDER BY number LIMIT 40), e AS (SELECT count(*) AS result_count, round(min(confidence), 3) AS score, string_agg(id, ',' ORDER BY id) AS ids FROM f)
SELECT result_count, score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN score IS NULL THEN 'unresolved' ELSE 'low' END AS level, coalesce(ids, 'none') AS ids FROM e"""
)
def answer_entries(spark, d):
    """A source's first 40 entries whose text has the words asked for, in their envelope."""
    e = _entries(spark, d).where("source = 'taqrib'")
    found = records.page(records.search_substring(e, S.normalize(F.col("text")), "روي عن نافع"), ["number"], 0, 40)
    return P.envelope(found, [], "confidence", "id", "none").select("result_count", "score", "level", F.array_join("references", ",").alias("ids"))


@query(
    f"""WITH {_ENTRIES}, r AS (SELECT *, CASE WHEN name = 'مالك' THEN 0 WHEN starts_with(name, 'مالك') THEN 1 WHEN contains(name, 'مالك') THEN 2 WHEN teacher = 'مالك' THEN 3 END AS rank FROM entries)
SELECT id, rank, ['exact_name', 'name_prefix', 'name_contains', 'biography_mention'][rank + 1] AS kind FROM (SELECT * FROM r WHERE rank IS NOT NULL ORDER BY rank, length(name), number, id LIMIT 24)"""
)
def answer_candidates(spark, d):
    """Entries as candidates for a name: how each matches; sources are never merged."""
    r = resolve.rank_names(_entries(spark, d), S.normalize(F.col("name")), "مالك", S.normalize(F.col("text")))
    kinds = F.array(*[F.lit(k) for k in resolve.MATCHES])
    return r.orderBy("rank", F.length("name"), F.coalesce("number", F.lit(0)), "id").limit(24).select("id", "rank", F.get(kinds, F.col("rank")).alias("kind"))


@query(f"WITH {_LINKS} SELECT CASE WHEN relative THEN 'UNC-REL-' || substr(sha1(record || ':0:' || position || ':ابيه'), 1, 12) ELSE 'UNC-' || substr(sha1(form), 1, 12) END AS node, count(*) AS occurrence_count, form AS labels, count(*) > 50 AS truncated FROM links GROUP BY 1, form")
def answer_profiles(spark, d):
    """Every bucket of names with its forms and occurrences; relative forms of two chains are two."""
    b = P.buckets(_nodes(spark, d), "node", "form", ["chain", "position"])
    return b.select("node", "occurrence_count", F.array_join("labels", ",").alias("labels"), "truncated")


@query(f"WITH {_LINKS} SELECT chain, position, dst, relation, (SELECT count(*) FROM relations WHERE src = 'نافع') > 60 AS has_next FROM relations WHERE src = 'نافع' ORDER BY chain, position, relation, dst LIMIT 60")
def answer_relations(spark, d):
    """A page of a narrator's relations, and whether there are more."""
    r = _relations(spark, d).where("src = 'نافع'")
    return records.page(r.select("chain", "position", "dst", "relation"), ["chain", "position", "relation", "dst"], 0, 60)


@query(f"WITH {_ENTRIES} SELECT id, 'death' AS event, death AS year FROM entries WHERE name = 'مالك' AND death IS NOT NULL UNION ALL SELECT id, 'birth', birth FROM entries WHERE name = 'مالك' AND birth IS NOT NULL")
def answer_timeline(spark, d):
    """All dates that entries of exactly this name assert, never averaged."""
    e = _entries(spark, d).where(S.normalize(F.col("name")) == "مالك")
    dates = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("event"), F.col(c).alias("year"))) for c in ("death", "birth")]))
    return e.select("id", F.explode(dates).alias("x")).select("id", "x.event", "x.year")


@query(
    f"""WITH {_ENTRIES}, {_LINKS}, l AS (SELECT name, min(birth) AS birth, max(death) AS death FROM entries GROUP BY name), p AS (SELECT DISTINCT x.name AS a, {_sql(NAMES)}[((x.k * 3 + 2) % {len(NAMES)} + 1)::INTEGER] AS b FROM entries x),
m AS (SELECT src AS a, dst AS b, count(*) AS n FROM relations GROUP BY ALL),
j AS (SELECT p.a, p.b, x.birth AS ab, x.death AS ad, y.birth AS bb, y.death AS bd, coalesce(n, 0) AS n FROM p LEFT JOIN l x ON x.name = p.a LEFT JOIN l y ON y.name = p.b LEFT JOIN m ON m.a = p.a AND m.b = p.b),
v AS (SELECT *, CASE WHEN coalesce(ab, ad) IS NULL OR coalesce(bb, bd) IS NULL THEN 'unknown' WHEN ab > bd THEN 'a-after-b' WHEN bb > ad THEN 'b-after-a' WHEN ab IS NULL OR bb IS NULL THEN 'no-birth' ELSE 'no-contradiction' END AS reason FROM j),
w AS (SELECT *, CASE WHEN reason IN ('unknown', 'no-birth') THEN 'insufficient' WHEN reason = 'no-contradiction' THEN 'possible' ELSE 'impossible' END AS chronology FROM v)
SELECT a, b, chronology, reason, CASE WHEN n > 0 THEN 'asserted_isnad' ELSE 'not_asserted' END AS meeting, CASE WHEN chronology <> 'insufficient' OR n > 0 THEN 'high' ELSE 'unresolved' END AS level FROM w"""
)
def answer_comparisons(spark, d):
    """Persons compared two by two: their dates' verdict, and whether a chain has them side by side."""
    entries = _entries(spark, d)
    e = entries.groupBy(S.normalize(F.col("name")).alias("n")).agg(F.min("birth").alias("birth"), F.max("death").alias("death"))
    pairs = entries.select(F.col("name").alias("a"), _pick(NAMES, (F.col("k") * 3 + 2) % len(NAMES)).alias("b")).distinct()
    met = _relations(spark, d).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count("*").alias("meetings"))
    x = pairs.join(e.toDF("a", "ab", "ad"), "a", "left").join(e.toDF("b", "bb", "bd"), "b", "left").join(met, ["a", "b"], "left")
    known = F.coalesce("ab", "ad").isNotNull() & F.coalesce("bb", "bd").isNotNull()
    v = resolve.bounds_verdict(F.col("ab"), F.col("ad"), F.col("bb"), F.col("bd"), known)
    return x.select("a", "b", P.comparison(v, F.coalesce("meetings", F.lit(0))).alias("c")).select("a", "b", "c.*")


@query("SELECT o_custkey AS src, o_orderpriority AS dst, count(*) AS n, bool_or(o_orderstatus = 'F') AS highlighted FROM orders GROUP BY ALL")
def highlighted_family(spark, d):
    e = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")).agg(F.count("*").alias("n"), F.collect_set("o_orderstatus").alias("families"))
    return P.highlighted(e, "families", "F").drop("families")


@query("SELECT p_partkey, p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AS reviewed FROM part")
def review_states(spark, d):
    """Rows in one of the states asked for."""
    state = F.when(F.col("p_size").between(10, 20), "machine_unreviewed").otherwise("accepted")
    return t(spark, d, "part").select("p_partkey", (state.isin("machine_unreviewed", "in_review") & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).alias("reviewed"))


@query(f"SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN {_sql(NISBAS)}[(c_custkey % 4 + 1)::INTEGER] WHEN 1 THEN 'rank ' || c_mktsegment END AS first FROM customer")
def first_fields(spark, d):
    """The first value under the first of several keys, in metadata of all customers."""
    from tesserae.functions.entries import metadata_fields

    k, other, rank = F.col("c_custkey"), F.lit("النسب: ثان"), F.concat(F.lit("الرتبة: rank "), "c_mktsegment")
    text = F.when(k % 3 == 0, F.concat_ws("\n", rank, F.concat(F.lit("النسب: "), _pick(NISBAS, k % 4)), other)).when(k % 3 == 1, rank).otherwise("x")
    return t(spark, d, "customer").select(k.alias("k"), I.first_value(metadata_fields(text), ["النسب", "الرتبة"]).alias("first"))


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.vec_id, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS c FROM e x JOIN e y ON y.vec_id = x.vec_id + 1 AND x.label = y.label) SELECT vec_id, round(c, 6) AS cosine, round(0.35 * 0.2 + 0.25 * 3 / 22 + 0.4 * c, 4) AS similarity FROM p")
def semantic_similarity(spark, d):
    """Similarity of two wordings with a similarity of meaning."""
    e = t(spark, d, "embeddings")
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("embedding").alias("v2"))
    c = S.cosine(F.col("embedding"), F.col("v2"))
    both = e.join(y, ["vec_id", "label"]).withColumn("c", c)
    return both.select("vec_id", F.round("c", 6).alias("cosine"), S.text_similarity(F.lit("alpha beta gamma"), F.lit("alpha delta omega"), F.col("c")).alias("similarity"))


@query("SELECT count(*) AS n, count(DISTINCT p_name) AS forms FROM (SELECT DISTINCT p_name, lower(p_name) AS l FROM part WHERE length(p_name) BETWEEN 3 AND 120)")
def normalization_pairs(spark, d):
    """Distinct pairs of a form and its normalized form, at most 260."""
    f = A.normalization_fixture(t(spark, d, "part").select("p_name", F.lower("p_name").alias("l")), "p_name", "l")
    return f.agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("forms"))


@query("SELECT true AS same, false AS other")
def stored_frame(spark, d):
    """A frame that is stored is found again; another is not."""
    from tesserae.plans.sources import _scratch

    path, f = _scratch(spark), gold.simple_frame(t(spark, d, "part"), "p_partkey", 20, "s")
    A.write_derived(f, path)
    return spark.createDataFrame([(A.frame_matches(spark, f, path), A.frame_matches(spark, gold.simple_frame(t(spark, d, "part"), "p_partkey", 20, "x"), path))], "same boolean, other boolean")
