"""Bindings of profiles, routes, reports and answers to the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.operators import profiles as P
from tesserae.operators import records, resolve
from tesserae.plans.catalogue import _EDGES, _edges, given, _ORDER, query, t
from tesserae.plans.literal import Literal

_POS = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1"


def _occurrences(spark, d):
    from tesserae.operators.chains import positions

    p = positions(t(spark, d, "lineitem"), "l_orderkey", _ORDER)
    return p.select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("chain"), F.col("position").cast("long").alias("position"), F.col("l_partkey").alias("label"))


@query(
    f"""WITH o AS (SELECT l_suppkey AS node, l_orderkey AS chain, {_POS} AS position, l_partkey AS label FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY chain, position) AS n FROM o),
c AS (SELECT node, count(*) AS occurrence_count, count(DISTINCT label)::INTEGER AS n_labels FROM o GROUP BY 1)
SELECT node, occurrence_count, n_labels, occurrence_count > 50 AS truncated, string_agg(chain || '.' || position, ',' ORDER BY n) AS shown FROM c JOIN r USING (node) WHERE n <= 50 GROUP BY ALL"""
)
def node_profile(spark, d):
    """Each node with its forms, its occurrences counted and the first fifty of them."""
    b = P.buckets(_occurrences(spark, d), "node", "label", ["chain", "position"])
    return b.select("node", "occurrence_count", "n_labels", "truncated", F.array_join(F.transform("first", lambda x: F.concat_ws(".", x["chain"].cast("string"), x["position"].cast("string"))), ",").alias("shown"))


@query("SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, 'isnad_link' AS kind, count(*) AS evidence_count, max(l_quantity) AS score, max(l_shipdate)::DATE::VARCHAR AS reviewed_at FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL")
def relationship_projection(spark, d):
    """Relationships of what is not rejected, by five keys, with their evidence."""
    li = t(spark, d, "lineitem").where("l_returnflag <> 'A'").withColumn("kind", F.lit("isnad_link"))
    return P.relationships(li, ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber", "kind"], "l_quantity", "l_shipdate").withColumn("reviewed_at", F.to_date("reviewed_at").cast("string"))


@query(
    f"""WITH {_EDGES}, f AS (SELECT e.src, e.dst, e.chain, e.position, o_orderpriority AS family FROM e JOIN orders ON o_orderkey = chain WHERE relation = 'transmitted_from'),
g AS (SELECT src, dst, count(*) AS n, count(DISTINCT chain) AS n_chains, string_agg(DISTINCT family, ', ' ORDER BY family) AS families, min(struct_pack(chain := chain, position := position)) AS m FROM f GROUP BY ALL)
SELECT src, dst, n, n_chains, families, m.chain AS first_chain, m.position AS first_position, 'evidence: isnad_link; links: ' || n || '; chains: ' || n_chains || '; families: ' || families AS facts FROM g"""
)
def cluster_routes(spark, d):
    """The route graph: edges with their places counted, families in order and the facts of each."""
    families = t(spark, d, "orders").select(F.col("o_orderkey").alias("chain"), F.col("o_orderpriority").alias("family"))
    e = P.route_edges(_edges(spark, d).where("relation = 'transmitted_from'").join(families, "chain"), "family")
    facts = F.array_join(P.edge_facts(F.col("n"), F.col("n_chains"), F.col("families"), F.col("evidence_kind")), "; ")
    return e.select("src", "dst", "n", "n_chains", F.array_join("families", ", ").alias("families"), F.col("first.chain").alias("first_chain"), F.col("first.position").alias("first_position"), facts.alias("facts"))


@query(f"WITH o AS (SELECT l_suppkey AS node, l_orderkey AS chain, {_POS} AS position, l_partkey AS label FROM lineitem) SELECT node, arg_min(label, struct_pack(chain := chain, position := position)) AS label, 'unresolved' AS identity_status, 'machine_unreviewed' AS review_status FROM o GROUP BY node")
def route_nodes(spark, d):
    return P.route_nodes(_occurrences(spark, d), "node", "label", ["chain", "position"])


@query(f"WITH {_EDGES} SELECT src, dst, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '__unassigned__') AS family, count(*) AS n FROM e LEFT JOIN orders ON o_orderkey = chain WHERE relation = 'transmitted_from' GROUP BY ALL")
def family_edges(spark, d):
    """Parallel edges by family."""
    f = t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chain"), F.col("o_orderstatus").alias("family"))
    return P.split_by_family(_edges(spark, d).where("relation = 'transmitted_from'").join(f, "chain", "left"), "family")


@query(
    """WITH f AS (SELECT lang || ':' || substr(source, 1, 3) AS cluster, substr(sha1(text), 1, 12) AS family, doc_id, text, lang IN ('en', 'fr') AS shown FROM documents),
g AS (SELECT cluster, family, min(doc_id) AS first_id, count(*) AS n, bool_and(shown) AS shown, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members, md5(min(text)) AS h FROM f GROUP BY ALL)
SELECT cluster, family, n, members, NOT shown AS withheld, CASE WHEN shown THEN h END AS representative, ['teal', 'clay', 'gold', 'ink', 'sage'][((row_number() OVER (PARTITION BY cluster ORDER BY first_id) - 1) % 5 + 1)::INTEGER] AS colour FROM g"""
)
def family_members(spark, d):
    """Families with members, representative and colour; texts behind the licence."""
    docs = t(spark, d, "documents").withColumn("cluster", F.concat("lang", F.lit(":"), F.substring("source", 1, 3)))
    f = P.families(docs, "cluster", F.col("text"), "doc_id", F.col("lang").isin("en", "fr"))
    return f.select("cluster", "family", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "withheld", F.md5("representative").alias("representative"), "colour")


@query(f"WITH {_EDGES} SELECT src, dst, count(*) AS n, string_agg(DISTINCT relation, ', ' ORDER BY relation) AS variants, string_agg(DISTINCT (chain % 4)::VARCHAR, ', ' ORDER BY (chain % 4)::VARCHAR) AS collections FROM e GROUP BY ALL")
def merged_edges(spark, d):
    return P.merged_edges(_edges(spark, d).withColumn("c", F.col("chain") % 4), "relation", "c")


@query(f"WITH {_EDGES}, n AS (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0) SELECT src, dst, coalesce(a.s_name, src::VARCHAR) AS src_label, coalesce(b.s_name, dst::VARCHAR) AS dst_label FROM (SELECT DISTINCT src, dst FROM e) LEFT JOIN n a ON a.s_suppkey = src LEFT JOIN n b ON b.s_suppkey = dst")
def labelled_edges(spark, d):
    return P.labelled_edges(_edges(spark, d).select("src", "dst").distinct(), t(spark, d, "supplier").where("s_suppkey % 2 = 0"), "s_suppkey", "s_name")


CHAINS = Literal(
    "chains",
    "chain string, position int, form string, term string, relative boolean",
    [
        ("a", 0, "malik", "anba", False), ("a", 1, "nafi", "an", False), ("a", 2, "umar", "an", False),
        ("b", 0, "yahya", "anba", False), ("b", 1, "nafi", "an", False), ("b", 2, "umar", "an", False),
        ("c", 0, "salim", "anba", False), ("c", 1, "abihi", "an", True), ("c", 2, "umar", "an", False),
        ("d", 0, "salim", "anba", False), ("d", 1, "abihi", "an", True), ("d", 2, "umar", "an", False),
        ("e", 0, "nafi", "sami", False), ("e", 1, "umar", "an", False),
    ],
)


@given(
    """SELECT * FROM (VALUES (1, 'umar', 5::BIGINT, 'nafi', 2::BIGINT), (1, 'umar', 5, 'abihi', 1), (1, 'umar', 5, 'abihi', 1), (1, 'umar', 5, 'nafi', 1), (2, 'nafi', 2, 'malik', 1), (2, 'nafi', 2, 'yahya', 1)) v(depth, form, n_chains, child, child_chains)"""
)
def merged_chains(spark, d):
    """Chains merged from their deepest end; relative forms and other terms are never merged."""
    c = CHAINS.df(spark)
    return P.shared_segments(P.merged_from_end(c, "chain", "position", "form", "term", "relative"))


@query(
    """WITH p AS (SELECT conv_id, string_agg(role, '>') OVER w AS path, count(*) OVER w AS depth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT depth::INTEGER AS depth, count(DISTINCT path) AS nodes, max(n) AS most FROM (SELECT depth, path, count(DISTINCT conv_id) AS n FROM p GROUP BY ALL) GROUP BY depth"""
)
def merged_conversations(spark, d):
    """Conversations merged from their last turn backwards, as nodes a depth."""
    c = t(spark, d, "conversations").withColumn("relative", F.lit(False)).withColumn("term", F.lit("x"))
    m = P.merged_from_end(c, "conv_id", "turn", "role", "term", "relative")
    return m.groupBy("depth").agg(F.count("*").alias("nodes"), F.max("n_chains").alias("most"))


FACTS = Literal(
    "facts",
    "k int, kinds array<string>, status string, statuses array<string>, years array<int>, candidate int, overlap int, gap int, sources array<string>",
    [
        (1, ["isnad_link", "chronology_only"], "high", ["high", "low", "verified"], [143, 145], 150, 20, None, ["taqrib", "mizan", "taqrib"]),
        (2, ["rijal_statement"], "low", ["conflict", "verified"], [143], 150, None, 15, ["mizan"]),
        (3, ["chronology_only"], "conflict", ["x"], [], 150, None, None, []),
        (4, [], None, [], [], None, 0, None, ["tahdhib"]),
    ],
)


@given(
    """SELECT * FROM (VALUES (1, 'isnad', 'low', '143 / 145', 'overlap of 20 years (mizan, taqrib)'), (2, 'statement', 'conflict', '143', 'gap of 15 years (mizan)'), (3, 'uncertain', 'unresolved', '150', 'insufficient'),
(4, 'uncertain', 'unresolved', NULL, 'overlap of 0 years (tahdhib)')) v(k, evidence, status, death, label)"""
)
def edge_classes(spark, d):
    """Evidence of edges, the most cautious status, displayed years of death, comparisons in words."""
    f = FACTS.df(spark)
    return f.select("k", P.edge_evidence(F.col("kinds"), F.col("status")).alias("evidence"), P.most_cautious(F.col("statuses")).alias("status"), P.displayed_death(F.col("years"), F.col("candidate")).alias("death"), P.chronology_label(F.col("overlap"), F.col("gap"), F.col("sources")).alias("label"))


# reports


@query(
    """SELECT source, count(DISTINCT n_chars) FILTER (lang <> 'de') AS numbers, count(*) AS n, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (contains(text, '@')) AS mails, count(*) FILTER (contains(text, chr(10))) AS several, sum(n_chars)::BIGINT AS chars,
sum(len(string_split(text, ' ')))::BIGINT AS words, round(100.0 * count(*) FILTER (n_chars < 500) / count(*), 1)::DOUBLE AS percent_short, round(avg(n_chars), 1)::DOUBLE AS mean, round(sum(n_chars)::DOUBLE / count(DISTINCT text), 2)::DOUBLE AS factor FROM documents GROUP BY source"""
)
def detection_report(spark, d):
    """Conditional counts, sums and shares of each source."""
    n = lambda c: F.count_if(c)
    short = F.col("n_chars") < 500
    return t(spark, d, "documents").groupBy("source").agg(
        F.countDistinct(F.when(F.col("lang") != "de", F.col("n_chars"))).alias("numbers"), F.count("*").alias("n"), n(short).alias("short"), n(F.col("text").contains("@")).alias("mails"), n(F.col("text").contains("\n")).alias("several"),
        F.sum("n_chars").alias("chars"), F.sum(F.size(F.split("text", " "))).alias("words"), F.round(100.0 * n(short) / F.count("*"), 1).alias("percent_short"), F.round(F.avg("n_chars"), 1).alias("mean"), F.round(F.sum("n_chars") / F.countDistinct("text"), 2).alias("factor"),
    )


@query("WITH p AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token, p_partkey FROM part), n AS (SELECT token, count(*) AS n FROM p WHERE token <> '' GROUP BY 1) SELECT count(*) AS tokens, sum(n)::BIGINT AS total, count(*) FILTER (n = 1) AS singletons, (SELECT string_agg(token || ':' || n, ',' ORDER BY n DESC, token) FROM (SELECT * FROM n ORDER BY n DESC, token LIMIT 5)) AS top FROM n")
def posting_report(spark, d):
    """Tokens, postings, singletons and the five longest lists."""
    n = resolve.posting_sizes(resolve.postings(t(spark, d, "part"), "p_partkey", F.col("p_name")))
    top = n.orderBy(F.desc("n"), "token").limit(5).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "token"))), lambda x: F.concat_ws(":", x["token"], (-x["m"]).cast("string"))), ",").alias("top"))
    return n.agg(F.count("*").alias("tokens"), F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("singletons")).crossJoin(F.broadcast(top))


@query(f"WITH {_EDGES} SELECT src AS node, count(DISTINCT dst) FILTER (relation = 'transmitted_from') AS teachers, count(DISTINCT dst) FILTER (relation = 'transmitted_to') AS students, count(DISTINCT chain) AS routes FROM e GROUP BY 1")
def node_degrees(spark, d):
    """Distinct teachers, students and routes of each node."""
    of = lambda r: F.countDistinct(F.when(F.col("relation") == r, F.col("dst")))
    return _edges(spark, d).groupBy(F.col("src").alias("node")).agg(of("transmitted_from").alias("teachers"), of("transmitted_to").alias("students"), F.countDistinct("chain").alias("routes"))


@query("WITH k AS (SELECT lang || '|' || source AS stratum FROM documents), p AS (SELECT unnest(string_split(stratum, '|')) AS part, generate_subscripts(string_split(stratum, '|'), 1) AS i FROM k) SELECT (i - 1)::INTEGER AS place, part, count(*) AS n FROM p GROUP BY ALL")
def stratum_margins(spark, d):
    """How often each part of a stratum occurs, by its place."""
    k = t(spark, d, "documents").select(F.posexplode(F.split(F.concat_ws("|", "lang", "source"), r"\|")).alias("place", "part"))
    return k.groupBy("place", "part").agg(F.count("*").alias("n"))


@query("SELECT k, max(m) AS latest, sum(n)::BIGINT AS n FROM (SELECT o_custkey AS k, max(o_orderdate)::DATE::VARCHAR AS m, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT user_id, max(ts)::DATE::VARCHAR, count(*) FROM events GROUP BY 1) GROUP BY k")
def latest_of_logs(spark, d):
    """The latest of two logs' latest entries."""
    a = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("m"), F.count("*").alias("n"))
    b = t(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("m"), F.count("*").alias("n"))
    both = a.unionByName(b).withColumn("m", F.to_date("m").cast("string"))
    return both.groupBy("k").agg(F.max("m").alias("latest"), F.sum("n").alias("n"))


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members, count(*) FILTER (p_size > 25) AS public FROM part GROUP BY 1")
def candidates_by_source(spark, d):
    """Candidates grouped by source, with distinct values and conditional counts."""
    members = F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types"), members.alias("members"), F.count_if(F.col("p_size") > 25).alias("public"))


@query("SELECT p_brand, p_type, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def cited_works(spark, d):
    """Each cited place once, the first."""
    w = Window.partitionBy("p_brand", "p_type", "p_size").orderBy("p_partkey")
    return t(spark, d, "part").withColumn("n", F.row_number().over(w)).where("n = 1").select("p_brand", "p_type", "p_size", "p_partkey")


@query(
    """WITH e AS (SELECT user_id, event_type, event_id, ts FROM events), r AS (SELECT user_id, event_id AS undone FROM events WHERE event_type = 'error' OR event_id % 7 = 0), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.undone = e.event_id))
SELECT user_id, event_id, event_type FROM l WHERE n = 1"""
)
def active_entries(spark, d):
    """The latest entry of each log that none has reverted."""
    e = t(spark, d, "events")
    undone = e.where("event_type = 'error' or event_id % 7 = 0").select("event_id")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.join(undone, "event_id", "left_anti").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, value FROM events WHERE user_id % 10 = 3 ORDER BY value DESC, event_id LIMIT 30")
def by_confidence(spark, d):
    return t(spark, d, "events").where("user_id % 10 = 3").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(30)


# answers

_C = "round(0.5 + (n_chars % 1000) / 2000, 3)"


def _public(spark, d):
    reg = spark.createDataFrame([("en", "cleared", ["text", "n_chars"]), ("fr", "public-domain", ["text"]), ("de", "review-required", ["text"])], "key string, rights string, fields array<string>")
    docs = t(spark, d, "documents").withColumn("confidence", F.round(0.5 + (F.col("n_chars") % 1000) / 2000, 3))
    return records.gate(docs, F.broadcast(reg), "lang", ["text", "n_chars"])


@query(
    f"""WITH p AS (SELECT doc_id, source, lang, {_C} AS c FROM documents WHERE lang = 'fr' AND contains(lower(text), 'que') ORDER BY doc_id LIMIT 20)
SELECT count(*) AS result_count, round(min(c), 3) AS score, CASE WHEN count(*) = 0 THEN 'unresolved' WHEN min(c) >= 0.9 THEN 'high' WHEN min(c) >= 0.7 THEN 'medium' ELSE 'low' END AS level, string_agg(DISTINCT source, ',' ORDER BY source) AS refs FROM p"""
)
def answer_records(spark, d):
    """A page of records in its envelope: count, weakest confidence, level, sources."""
    docs = _public(spark, d).where("lang = 'fr'")
    p = records.page(records.search_substring(docs, F.lower(F.col("text")), "que"), ["doc_id"], 0, 20)
    return P.envelope(p, [], "confidence", "source", "none").select("result_count", "score", "level", F.array_join("references", ",").alias("refs"))


@query("SELECT 0::BIGINT AS result_count, NULL::DOUBLE AS score, 'unresolved' AS level, 'Nothing found.' AS refs")
def answer_nothing(spark, d):
    """An answer without items is unresolved and has a notice for its sources."""
    return P.envelope(_public(spark, d).where("doc_id = -1"), [], "confidence", "source", "Nothing found.").select("result_count", "score", "level", F.array_join("references", ",").alias("refs"))


@query(f"SELECT doc_id, lang, CASE WHEN lang IN ('en', 'fr') THEN md5(text) END AS text, lang NOT IN ('en') AS text_withheld, {_C} AS confidence, CASE WHEN {_C} >= 0.9 THEN 'high' WHEN {_C} >= 0.7 THEN 'medium' ELSE 'low' END AS level FROM documents WHERE doc_id = 17")
def answer_record(spark, d):
    """One record by its id, behind the licence, with its level; none for an unknown id."""
    r = _public(spark, d).where("doc_id = 17")
    return r.select("doc_id", "lang", F.md5("text").alias("text"), "text_withheld", "confidence", S.level(F.col("confidence")).alias("level"))


@given("SELECT key, kind, rights FROM (VALUES ('en', 'source', 'cleared'), ('fr', 'source', 'public-domain'), ('external-texts', 'external', 'review-required')) v(key, kind, rights)")
def answer_sources(spark, d):
    """The registry's sources and external data sets, as one list."""
    a = spark.createDataFrame([("en", "cleared"), ("fr", "public-domain")], "key string, rights string").withColumn("kind", F.lit("source"))
    b = spark.createDataFrame([("external-texts", "review-required")], "key string, rights string").withColumn("kind", F.lit("external"))
    return a.unionByName(b).select("key", "kind", "rights")


@query("SELECT t AS name, n FROM (SELECT 'documents' AS t, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events)")
def health(spark, d):
    """Whether the tables can be read, and their sizes."""
    one = lambda n: t(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return one("documents").unionByName(one("pages")).unionByName(one("events"))
