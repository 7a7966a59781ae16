"""Bindings of identifiers, projections, identities, rules and releases to the rows of the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import identifiers as I
from tesserae.functions import scalars as S
from tesserae.operators import corpus as C
from tesserae.operators import editorial, identities
from tesserae.operators import lifecycle as L
from tesserae.operators import profiles as P
from tesserae.operators.records import CLEARED
from tesserae.plans.answers import _LINKS, _links
from tesserae.plans.catalogue import query, t
from tesserae.plans.rendered import NAMES, TEACHERS, _pick, _sql
from tesserae.sources import archive as A

# names of lineitems as they are written: with marks, with white space, in Latin letters, relative ones
_WRITTEN = f"""w AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, {_sql(NAMES)}[((l_partkey * 3 + l_linenumber) % {len(NAMES)} + 1)::INTEGER] AS name, l_suppkey % 6 AS kind FROM lineitem),
names AS (SELECT *, CASE kind WHEN 3 THEN 'ابيه' WHEN 4 THEN 'b ' || lower('Sirin') WHEN 5 THEN '' ELSE name END AS norm FROM w)"""


def _written(spark, d):
    li = t(spark, d, "lineitem").withColumn("name", _pick(NAMES, (F.col("l_partkey") * 3 + F.col("l_linenumber")) % len(NAMES)))
    k = F.col("l_suppkey") % 6
    form = F.when(k == 0, F.col("name")).when(k == 1, F.concat(F.substring("name", 1, 1), F.lit("َ"), F.expr("substring(name, 2)"), F.lit("ٌ"))).when(k == 2, F.concat(F.lit("  "), F.regexp_replace("name", " ", "  "), F.lit("\t"))).when(k == 3, F.lit("أَبِيهِ")).when(k == 4, F.lit("Ibn Sīrīn"))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", form.alias("form"))


@query(f"WITH {_WRITTEN} SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, norm AS normalized, kind = 3 AS relative FROM names")
def normalized_names(spark, d):
    """Search forms of written names: marks, letter variants, white space, Latin ibn, and nothing."""
    n = _written(spark, d)
    return n.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", S.normalize(F.col("form")).alias("normalized"), F.coalesce(I.is_relative(F.col("form")), F.lit(False)).alias("relative"))


@query(
    f"""WITH {_WRITTEN} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN norm = '' OR kind = 3 THEN 'UNC-REL-' || substr(sha1('b-' || l_orderkey || ':0:' || l_linenumber || ':' || norm), 1, 12) ELSE 'UNC-' || substr(sha1(norm), 1, 12) END AS bucket,
CASE WHEN norm <> '' AND kind <> 3 THEN 'UNC-' || substr(sha1(norm), 1, 12) END AS cluster FROM names"""
)
def bucket_ids(spark, d):
    """Buckets of all written names; a relative or empty one has a bucket of its own place."""
    record = F.concat(F.lit("b-"), "l_orderkey")
    return _written(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", I.bucket_id(record, F.lit(0), F.col("l_linenumber"), F.col("form")).alias("bucket"), I.cluster_of_name(F.col("form")).alias("cluster"))


_STATES = ["high", "unresolved-relative", "prophet-mention", "conflict", "verified", "low", "medium"]


@query(
    f"""WITH c AS (SELECT c_custkey AS k, {_sql(_STATES)}[(c_custkey % 7 + 1)::INTEGER] AS status, ['high', 'medium', 'low'][(c_custkey % 3 + 1)::INTEGER] AS level, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 101) / 100.0::DOUBLE END AS score FROM customer)
SELECT k, CASE WHEN status IN ('unresolved-relative', 'prophet-mention') THEN 'unresolved' ELSE status END AS status, score IS NULL OR level = CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS sound,
least(k % 400, 240)::INTEGER AS q, CASE WHEN k % 4 = 0 THEN 20 ELSE greatest(1, least(100, k % 130)) END::INTEGER AS n, CASE k % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'date' END AS sort, k % 2 = 0 AS same, CASE WHEN k % 6 = 5 THEN 'no json' ELSE '{{"a":[1,2],"b":' || k || '}}' END AS kept FROM c"""
)
def parameters_and_states(spark, d):
    """Parameters within their bounds, states in the common vocabulary, levels against their scores, JSON by its canonical form."""
    k = F.col("c_custkey")
    score, text = F.when(k % 5 > 0, (k % 101) / 100.0), k.cast("string")
    a = F.concat(F.lit('{"b": '), text, F.lit(', "a": [1, 2]}'))
    b = F.concat(F.lit('{"a":[1,2],"b":'), F.when(k % 2 == 0, text).otherwise("-1"), F.lit("}"))
    same = F.coalesce(I.canonical_json(a) == I.canonical_json(b), F.lit(False))
    return t(spark, d, "customer").select(
        k.alias("k"), I.occurrence_status(_pick(_STATES, k % 7)).alias("status"), I.level_matches(_pick(["high", "medium", "low"], k % 3), score).alias("sound"), F.length(I.cut_query(F.repeat(F.lit("é"), (k % 400).cast("int")))).alias("q"),
        I.clamp_int(F.when(k % 4 == 0, "x").otherwise((k % 130).cast("string")), 1, 100, 20).alias("n"), I.one_of(_pick(["name", "date", "other"], k % 3), ["name", "date"]).alias("sort"), same.alias("same"), I.parse_or_keep(F.when(k % 6 == 5, "no json").otherwise(a)).alias("kept"),
    )


@query(f"SELECT c_custkey AS id, 0 AS chain_order, i::INTEGER AS position, {_sql(NAMES)}[((c_custkey + i) % {len(NAMES)} + 1)::INTEGER] AS raw FROM customer, range(0, 4) x(i) WHERE c_custkey % 2 = 0 AND i < c_custkey % 5")
def fallback_chains(spark, d):
    """Records without chains get one of their surface forms."""
    k = F.col("c_custkey")
    forms = F.when(k % 7 >= 0, F.transform(F.sequence(F.lit(0), (k % 5 - 1).cast("int")), lambda i: _pick(NAMES, (k + i) % len(NAMES))))
    forms = F.when(k % 5 > 0, forms).when(k % 3 > 0, F.array().cast("array<string>"))
    none = F.lit(None).cast("array<struct<chain_order:int,occurrences:array<struct<position:int,raw:string>>>>")
    c = t(spark, d, "customer").where(k % 2 == 0).select(k.alias("id"), F.explode(C.chains_or_forms(none, forms)).alias("c")).select("id", "c.chain_order", F.explode("c.occurrences").alias("o"))
    return c.select("id", "chain_order", "o.position", "o.raw")


_PHRASES, _RIGHTS, _REGIONS = ["سَمِعَ من نافع", "لم يثبت", "روى عن أبيه"], ["cleared", "review-required", "public-domain"], ["Medina", "Mecca", "Kufa", "Basra"]


@query(
    f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS n, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 9 END AS markers, {_sql(_PHRASES)}[(c_custkey % 4 + 1)::INTEGER] AS phrase, {_sql(_RIGHTS)}[(c_custkey % 3 + 1)::INTEGER] AS rights, c_custkey % 5 AS f,
{_sql(_REGIONS)}[(c_custkey % 4 + 1)::INTEGER] AS r1, {_sql(_REGIONS)}[(c_custkey % 3 + 1)::INTEGER] AS r2, c_mktsegment, c_nationkey FROM customer)
SELECT k, CASE WHEN n > 0 THEN n ELSE coalesce(markers, 1) END::INTEGER AS chain_count, CASE WHEN rights <> 'review-required' AND f IN (1, 2) THEN phrase END AS phrase, coalesce(k % 4 IN (0, 2), false) AS hearing,
CASE WHEN r1 = r2 THEN r1 ELSE r1 || ',' || r2 END AS regions, CASE k % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_nationkey::VARCHAR END AS picked, c_mktsegment || ':' || c_nationkey AS reference FROM c"""
)
def record_projections(spark, d):
    """Chain counts with their fallbacks, statements behind the licence, hearing, joined regions, dynamic columns, references."""
    k, c = F.col("c_custkey"), t(spark, d, "customer")
    label = F.array(F.lit("teacher_student_phrases"))
    fields = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 < 3, label).when(k % 5 == 3, F.array(F.lit("other")))
    phrase, rights = _pick(_PHRASES, k % 4), _pick(_RIGHTS, k % 3)
    ref = C.reference(F.col("c_mktsegment"), F.col("c_nationkey"))
    return c.select(
        k.alias("k"), C.chain_count((k % 3).cast("int"), F.when(k % 4 > 0, (k % 9).cast("int"))).alias("chain_count"), C.statement_phrase(phrase, rights.isin(*CLEARED), fields).alias("phrase"), C.tells_of_hearing(phrase).alias("hearing"),
        F.array_join(C.distinct_joined(F.array(_pick(_REGIONS, k % 4)), F.array(_pick(_REGIONS, k % 3), _pick(_REGIONS, k % 4))), ",").alias("regions"),
        C.column_named(c.select("c_mktsegment", "c_nationkey"), _pick(["c_mktsegment", "c_nationkey", "nothing"], k % 3)).alias("picked"), F.concat_ws(":", ref["source_work"], ref["number"].cast("string")).alias("reference"),
    )


@query(
    f"""WITH {_LINKS}, p AS (SELECT chain, position, form, string_agg(CASE WHEN relative THEN form || '@' || chain || '.' || position ELSE form END, '>') OVER w AS path, string_agg(CASE WHEN relative THEN form || '@' || chain || '.' || position ELSE form END, '>') OVER (PARTITION BY chain ORDER BY position DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent,
count(*) OVER w AS depth FROM links WINDOW w AS (PARTITION BY chain ORDER BY position DESC ROWS UNBOUNDED PRECEDING)), m AS (SELECT depth::INTEGER AS depth, path, parent, form, count(DISTINCT chain) AS n_chains FROM p GROUP BY ALL)
SELECT m.depth, m.form, m.n_chains, c.form AS child, c.n_chains AS child_chains FROM m LEFT JOIN m c ON c.parent = m.path WHERE m.n_chains > 1"""
)
def merged_chains(spark, d):
    """Chains of all orders merged from their deepest end; relative forms are never merged."""
    c = _links(spark, d).withColumn("relative", F.col("form") == "أبيه").withColumn("term", F.lit("عن"))
    return P.shared_segments(P.merged_from_end(c, "chain", "position", "form", "term", "relative"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS e, o_orderkey % 5 AS s, (o_orderkey % 90 + 100)::INTEGER AS y, o_orderkey % 3 AS g FROM orders)
SELECT k, CASE WHEN s = 4 THEN 'uncertain' WHEN e = 0 THEN 'isnad' WHEN e = 1 THEN 'statement' WHEN e = 2 THEN 'chronology' ELSE 'uncertain' END AS evidence, CASE WHEN s = 4 THEN 'conflict' WHEN g = 0 THEN 'low' ELSE 'high' END AS status,
CASE WHEN g = 0 THEN y || ' / ' || (y + 2) WHEN g = 1 THEN y::VARCHAR WHEN s > 0 THEN (y + 5)::VARCHAR END AS death,
CASE WHEN g = 0 THEN 'overlap of ' || s || ' years (mizan, taqrib)' WHEN g = 1 THEN 'gap of ' || (s + 1) || ' years (mizan)' ELSE 'insufficient' END AS label FROM o"""
)
def edge_classes(spark, d):
    """Evidence of edges, the most cautious status, displayed years of death, comparisons in words."""
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    y, s, g = (k % 90 + 100).cast("int"), (k % 5).cast("int"), k % 3
    kinds = F.when(k % 4 == 0, F.array(F.lit("chronology_only"), F.lit("isnad_link"))).when(k % 4 == 1, F.array(F.lit("rijal_statement"), F.lit("chronology_only"))).when(k % 4 == 2, F.array(F.lit("chronology_only"))).otherwise(none)
    years = F.when(g == 0, F.array(y, y + 2)).when(g == 1, F.array(y)).otherwise(F.array().cast("array<int>"))
    sources = F.when(g == 0, F.array(F.lit("taqrib"), F.lit("mizan"), F.lit("taqrib"))).when(g == 1, F.array(F.lit("mizan"))).otherwise(none)
    status = F.when(s == 4, "conflict").otherwise("low")
    evidence, several = P.edge_evidence(kinds, status), F.when(s == 4, F.array(F.lit("verified"), F.lit("conflict"))).when(g == 0, F.array(F.lit("high"), F.lit("low"), F.lit("verified"))).otherwise(F.array(F.lit("verified"), F.lit("high")))
    return t(spark, d, "orders").select(k.alias("k"), evidence.alias("evidence"), P.most_cautious(several).alias("status"), P.displayed_death(years, F.when(s > 0, y + 5)).alias("death"), P.chronology_label(F.when(g == 0, s), F.when(g == 1, s + 1), sources).alias("label"))


@query("SELECT n_name AS key, CASE WHEN n_regionkey = 4 THEN 'external' ELSE 'source' END AS kind, CASE n_regionkey % 3 WHEN 0 THEN 'cleared' WHEN 1 THEN 'public-domain' ELSE 'review-required' END AS rights FROM nation")
def answer_sources(spark, d):
    """The registry's sources and external data sets, as one list."""
    n = t(spark, d, "nation").select(F.col("n_name").alias("key"), "n_regionkey", _pick(["cleared", "public-domain", "review-required"], F.col("n_regionkey") % 3).alias("rights"))
    a, b = n.where("n_regionkey <> 4").withColumn("kind", F.lit("source")), n.where("n_regionkey = 4").withColumn("kind", F.lit("external"))
    return a.unionByName(b).select("key", "kind", "rights")


@query("SELECT 'source:' || n_name AS id, n_name AS key, 'source' AS kind, CASE n_regionkey % 2 WHEN 0 THEN 'cleared' ELSE 'review-required' END AS rights, CASE n_regionkey % 2 WHEN 0 THEN '[\"isnad\",\"matn\"]' ELSE '[]' END AS fields FROM nation")
def source_works(spark, d):
    """The registry's sources as works."""
    even = F.col("n_regionkey") % 2 == 0
    return A.source_works(t(spark, d, "nation").select(F.col("n_name").alias("key"), F.lit("source").alias("kind"), F.when(even, "cleared").otherwise("review-required").alias("rights"), F.when(even, F.array(F.lit("isnad"), F.lit("matn"))).otherwise(F.array().cast("array<string>")).alias("fields")))


@query(
    """WITH m AS (SELECT c_custkey AS k, c_custkey % 40 > 3 AS merged, c_custkey % 5 = 0 AS split FROM customer)
SELECT k AS absorbed, k - 3 AS target, 2 * k AS cause, NOT split AS is_active FROM m WHERE merged UNION ALL SELECT k, k - 2, 2 * k + 1000000, true FROM m WHERE merged AND split AND k % 10 = 0"""
)
def redirect_log(spark, d):
    """Merges and splits of customers as redirects, all on record, the last of a key active."""
    return L.redirects_of(_events(spark, d))


def _events(spark, d):
    """Who has a number over 3 in his forty is merged into the third before; each fifth is split off again, each tenth then merged into the second before."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer").where(k % 40 > 3)
    event = lambda df, kind, target, id_, at: df.select(id_.alias("event"), F.lit(kind).alias("kind"), k.alias("absorbed"), target.alias("target"), F.lit(at).alias("at"))
    again = event(c.where(k % 10 == 0), "merge", k - 2, 2 * k + 1_000_000, 3)
    return event(c, "merge", k - 3, 2 * k, 1).unionByName(event(c.where(k % 5 == 0), "split", k - 3, 2 * k + 1, 2)).unionByName(again)


@query(
    """WITH RECURSIVE r AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 2 ELSE c_custkey - 3 END AS t FROM customer WHERE c_custkey % 40 > 3 AND (c_custkey % 5 > 0 OR c_custkey % 10 = 0)),
w(key, target, path, n) AS (SELECT c_custkey, c_custkey, '', 0 FROM customer UNION ALL SELECT key, t, CASE WHEN path = '' THEN target::VARCHAR ELSE path || '>' || target END, n + 1 FROM w JOIN r ON r.a = w.target WHERE n < 8),
l AS (SELECT key, max(n) AS n FROM w GROUP BY key) SELECT key, target, path, target IN (SELECT a FROM r) AS truncated FROM w JOIN l USING (key, n)"""
)
def redirect_paths(spark, d):
    """Where each customer's redirects lead, through whom, eight steps at most."""
    return L.resolved(t(spark, d, "customer").select(F.col("c_custkey").alias("key")), L.redirects_of(_events(spark, d)))


_RULES = """distinct_persons|subject = object
valid_range|valid_from > valid_to
isnad_needs_positions|evidence_kind = 'isnad_link' AND (chain IS NULL OR so IS NULL OR oo IS NULL)
statement_needs_passage|evidence_kind = 'rijal_statement' AND entry IS NULL
chronology_has_no_chain|evidence_kind = 'chronology_only' AND (chain IS NOT NULL OR so IS NOT NULL OR oo IS NOT NULL)
chronology_needs_dates|evidence_kind = 'chronology_only' AND (sd IS NULL OR od IS NULL)
chronology_is_never_transmission|evidence_kind = 'chronology_only' AND type <> 'contemporary'
distinct_occurrences|so = oo
level_threshold|score IS NOT NULL AND level <> CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AND level NOT IN ('verified', 'unresolved', 'conflict')
verified_is_editorial|level = 'verified' AND (origin <> 'editorial' OR reviewed_by IS NULL)
score_is_machine|score IS NOT NULL AND method = 'manual'
review_pair|(reviewed_by IS NULL) <> (reviewed_at IS NULL)
decision_needs_reviewer|review_status = 'accepted' AND reviewed_by IS NULL"""
_RELATION = """links AS (SELECT l_suppkey % 9 AS subject, l_partkey % 9 AS object, ['isnad_link', 'rijal_statement', 'chronology_only'][(l_linenumber % 3 + 1)::INTEGER] AS evidence_kind, CASE WHEN l_suppkey % 2 = 0 THEN 'contemporary' ELSE 'teacher' END AS type, CASE WHEN l_suppkey % 4 > 0 THEN l_orderkey END AS chain,
CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 5 END AS so, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 5 END AS oo, CASE WHEN l_partkey % 2 = 0 THEN 1 END AS entry, CASE WHEN l_partkey % 3 > 0 THEN 1 END AS sd, CASE WHEN l_suppkey % 3 > 0 THEN 1 END AS od, l_partkey % 50 AS valid_from, CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey % 50 END AS valid_to,
CASE WHEN l_partkey % 7 > 0 THEN (l_partkey % 101) / 100.0::DOUBLE END AS score, ['high', 'medium', 'low', 'verified', 'conflict'][(l_partkey % 5 + 1)::INTEGER] AS level, CASE WHEN l_orderkey % 2 = 0 THEN 'editorial' ELSE 'machine' END AS origin, CASE WHEN l_orderkey % 3 = 0 THEN 'manual' ELSE 'parser' END AS method,
CASE WHEN l_orderkey % 4 > 0 THEN 'u' END AS reviewed_by, CASE WHEN l_orderkey % 5 > 0 THEN '2026' END AS reviewed_at, CASE WHEN l_linenumber % 2 = 0 THEN 'accepted' ELSE 'in_review' END AS review_status FROM lineitem)"""


@query(f"WITH {_RELATION} " + " UNION ALL ".join(f"SELECT '{r.split('|')[0]}' AS rule, count(*) AS n FROM links WHERE {r.split('|')[1]}" for r in _RULES.split("\n")))
def relationship_constraints(spark, d):
    """How many links, made of lineitems, break each rule of a relationship."""
    s, p, o, n = (F.col(c) for c in ("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"))
    one = F.lit(1)
    links = t(spark, d, "lineitem").select(
        (s % 9).alias("subject"), (p % 9).alias("object"), _pick(["isnad_link", "rijal_statement", "chronology_only"], n % 3).alias("evidence_kind"), F.when(s % 2 == 0, "contemporary").otherwise("teacher").alias("type"), F.when(s % 4 > 0, o).alias("chain"),
        F.when(p % 5 > 0, p % 5).alias("subject_occurrence"), F.when(s % 5 > 0, s % 5).alias("object_occurrence"), F.when(p % 2 == 0, one).alias("entry"), F.lit(None).cast("string").alias("phrase"), F.when(p % 3 > 0, one).alias("subject_date"), F.when(s % 3 > 0, one).alias("object_date"),
        (p % 50).alias("valid_from"), F.when(s % 6 > 0, s % 50).alias("valid_to"), F.when(p % 7 > 0, (p % 101) / 100.0).alias("score"), _pick(["high", "medium", "low", "verified", "conflict"], p % 5).alias("level"), F.when(o % 2 == 0, "editorial").otherwise("machine").alias("origin"),
        F.when(o % 3 == 0, "manual").otherwise("parser").alias("method"), F.when(o % 4 > 0, "u").alias("reviewed_by"), F.when(o % 5 > 0, "2026").alias("reviewed_at"), F.when(n % 2 == 0, "accepted").otherwise("in_review").alias("review_status"),
    )
    return editorial.violations(links, L.relationship_rules())


@query("WITH r AS (SELECT o_orderkey AS id, o_orderkey % 97 > 0 AS was, o_orderdate AS since FROM orders), t AS (SELECT id FROM r WHERE was ORDER BY since DESC, id DESC LIMIT 1) SELECT id::VARCHAR AS release_id, (SELECT count(*) + 1 FROM r) AS n, 1::BIGINT AS active FROM t")
def release_rollback(spark, d):
    """The release to go back to, the last that was ever active, and the table after it went active again beside a new one. Releases are orders; one
    in 97 never was active."""
    from tesserae.operators.workflow import activate

    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    r = t(spark, d, "orders").select(key.alias("release_id"), F.lit(False).alias("is_active"), F.lit("2026-01").alias("built_at"), F.when(F.col("o_orderkey") % 97 > 0, F.concat_ws(" ", F.col("o_orderdate").cast("string"), key)).alias("activated_at"))
    r = L.register(r, "new", "2026-07")
    target = L.rollback_target(r).first()["release_id"]
    return activate(r, target, "2026-08").agg(F.max(F.when(F.col("is_active"), F.regexp_replace("release_id", "^0+", ""))).alias("release_id"), F.count("*").alias("n"), F.count_if("is_active").alias("active"))


@query(
    """WITH o AS (SELECT l_suppkey % 7 = 3 AS relative, l_partkey % 11 = 0 AS prophet, l_linenumber, (l_suppkey * 3 + l_linenumber) % 20 AS form FROM lineitem)
SELECT count(*) AS occurrences, count(*) FILTER (prophet) AS by_flag, count(*) FILTER (NOT prophet AND relative) AS relative, count(DISTINCT form) FILTER (NOT prophet AND NOT relative) AS forms, count(*) FILTER (NOT prophet AND NOT relative) AS covered,
round(count(*) FILTER (NOT prophet AND NOT relative)::DOUBLE / count(DISTINCT form) FILTER (NOT prophet AND NOT relative), 2) AS factor FROM o"""
)
def form_counters(spark, d):
    """Occurrences of each kind in all chains, distinct forms, and what a form stands for on average. Who is flagged as a prophet has a name
    of his own."""
    k = F.col("l_suppkey")
    prophet = F.col("l_partkey") % 11 == 0
    raw = F.when(prophet, F.lit("موسي عليه السلام")).when(k % 7 == 3, F.lit("أبيه")).otherwise(_pick(NAMES, (k * 3 + F.col("l_linenumber")) % len(NAMES)))
    o = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("chain"), F.col("l_linenumber").alias("position"), raw.alias("raw"), prophet.alias("prophet"))
    return identities.form_counters(o).select("occurrences", "by_flag", "relative", "forms", "covered", "factor")


@query(f"SELECT DISTINCT {_sql(NAMES)}[((l_suppkey * 3 + l_linenumber) % 20 + 1)::INTEGER] AS form, count(*) OVER (PARTITION BY (l_suppkey * 3 + l_linenumber) % 20) AS occurrences FROM lineitem WHERE l_suppkey % 7 <> 3")
def distinct_forms(spark, d):
    """The names of all chains, each with its occurrences; relative ones that name no one are left in their places."""
    k = F.col("l_suppkey")
    raw = F.when(k % 7 == 3, F.lit("أبيه")).otherwise(_pick(NAMES, (k * 3 + F.col("l_linenumber")) % len(NAMES)))
    o = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("chain"), F.col("l_linenumber").alias("position"), raw.alias("raw"), F.lit(False).alias("prophet"))
    return identities.distinct_forms(o).select("form", "occurrences")


@query(f"SELECT DISTINCT p_partkey AS k, i::INTEGER AS position, {_sql(TEACHERS)}[((p_partkey + i) % 4 + 1)::INTEGER] AS mention FROM part, range(0, 3) x(i) WHERE i <> 1 OR p_partkey % 3 > 0")
def curated_mentions(spark, d):
    """Chains of all parts, parted at their arrows; an empty link is no mention."""
    k = F.col("p_partkey")
    link = lambda i: _pick(TEACHERS, (k + i) % 4)
    chain = F.concat_ws(" ← ", link(0), F.when(k % 3 > 0, link(1)).otherwise(F.lit("")), link(2))
    m = A.curated_mentions(t(spark, d, "part").select(k.alias("externalId"), chain.alias("rawIsnad")))
    return m.select(F.col("externalId").alias("k"), "position", "mention")


@query("SELECT file, CASE file WHEN 'manifest.json' THEN '{\"release_id\":\"r1\",\"data_version\":\"v\",\"tables\":[' || (SELECT string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) FROM nation) || ']}' WHEN 'register.sql' THEN 'INSERT INTO release (release_id, data_version, is_active) VALUES (''r1'', ''v'', 0);' WHEN 'activate.sql' THEN 'UPDATE release SET is_active = (release_id = ''r1'');' ELSE 'RELEASE_ID=r1' END AS content FROM (VALUES ('manifest.json'), ('register.sql'), ('activate.sql'), ('latest.env')) v(file)")
def release_files(spark, d):
    """The files of a release whose tables are the nations."""
    return A.release_files("r1", t(spark, d, "nation").select(F.col("n_name").alias("name")), "v")
