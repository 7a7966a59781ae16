"""Bindings of the operators to the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.operators import chains, records, resolve

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
_NEXT = f"SELECT l_orderkey AS chain, row_number() OVER w - 1 AS position, l_suppkey AS a, lead(l_suppkey) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)})"
_EDGES = f"e AS (SELECT chain, position::BIGINT AS position, a AS src, b AS dst, 'transmitted_from' AS relation FROM ({_NEXT}) WHERE b IS NOT NULL UNION ALL SELECT chain, position::BIGINT, b, a, 'transmitted_to' FROM ({_NEXT}) WHERE b IS NOT NULL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Small archives typed in beside the rows that must come out: tests run them, the catalogue does not list them.
GIVEN: dict = {}
GIVEN_ORACLES: dict[str, str] = {}


def given(sql: str):
    def add(f):
        GIVEN[f.__name__], GIVEN_ORACLES[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark: SparkSession, d: str, node: str = "l_suppkey") -> DataFrame:
    return chains.adjacency(t(spark, d, "lineitem"), "l_orderkey", node, _ORDER).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_EDGES} SELECT * FROM e")
def edge_projection(spark, d):
    return _edges(spark, d)


@query(f"WITH {_EDGES} SELECT src, dst, relation, count(*) AS n, count(DISTINCT chain) AS n_chains FROM e GROUP BY ALL")
def edge_aggregate(spark, d):
    return chains.aggregate_edges(_edges(spark, d))


@query(f"WITH {_EDGES} SELECT src, count(*) AS degree FROM e GROUP BY src ORDER BY degree DESC, src LIMIT 10")
def hub_nodes(spark, d):
    return chains.hubs(_edges(spark, d), 10)


@query(f"WITH {_EDGES} SELECT chain, position, relation FROM e WHERE src = 1 AND dst = 2")
def meeting_evidence(spark, d):
    return _edges(spark, d).where("src = 1 and dst = 2").select("chain", "position", "relation")


@query(f"WITH {_EDGES} SELECT chain, position, src, dst, relation FROM e WHERE src = 7 ORDER BY chain, position, relation, dst LIMIT 100")
def node_relations_page(spark, d):
    return records.page(_edges(spark, d).where("src = 7"), ["chain", "position", "relation", "dst"], 0, 100).drop("has_next")


@query(
    f"""WITH RECURSIVE n AS ({_NEXT.replace("l_suppkey AS a", "l_partkey AS a").replace("lead(l_suppkey)", "lead(l_partkey)")}),
e AS (SELECT DISTINCT src, dst FROM (SELECT a AS src, b AS dst FROM n WHERE b IS NOT NULL UNION ALL SELECT b, a FROM n WHERE b IS NOT NULL)),
w(depth, src, dst, path) AS (SELECT 1, src, dst, concat('|', src, '|', dst, '|') FROM e WHERE src = 1 AND dst <> src UNION ALL
SELECT w.depth + 1, e.src, e.dst, concat(w.path, e.dst, '|') FROM w JOIN e ON e.src = w.dst WHERE w.depth < 3 AND instr(w.path, concat('|', e.dst, '|')) = 0)
SELECT *, (SELECT count(*) FROM w) >= 500 AS truncated FROM w ORDER BY depth, src, dst, path LIMIT 500"""
)
def bounded_paths(spark, d):
    return chains.bounded_paths(_edges(spark, d, "l_partkey"), 1, 3, 500)


@query(
    """WITH p AS (SELECT conv_id, string_agg(role, '>') OVER w AS path, count(*) OVER w AS depth FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)) SELECT depth, path, count(DISTINCT conv_id) AS n_chains FROM p GROUP BY ALL"""
)
def prefix_tree_segments(spark, d):
    return chains.prefix_segments(t(spark, d, "conversations"), "conv_id", "role", ["turn", "role", "text"])


@query("SELECT 'HCL-' || substr(sha256(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')), 1, 20) AS cluster, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def fingerprint_clusters(spark, d):
    return records.clusters(t(spark, d, "documents"), "text", "doc_id")


@query(
    """WITH f AS (SELECT 'HCL-' || substr(sha256(lower(substr(text, 1, 12))), 1, 20) AS cluster, substr(sha1(text), 1, 12) AS family, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT *, ((dense_rank() OVER (PARTITION BY cluster ORDER BY first_id) - 1) % 5)::INTEGER AS colour FROM f"""
)
def matn_families(spark, d):
    docs = t(spark, d, "documents").withColumn("cluster", F.concat(F.lit("HCL-"), F.substring(F.sha2(F.lower(F.substring("text", 1, 12)), 256), 1, 20)))
    return records.families(docs, "cluster", F.col("text"), "doc_id")


@query(r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(strip_accents(text), '\s+', ' ', 'g'), '^ | $', '', 'g'))) AS normalized FROM documents")
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", S.normalize(F.col("text")).alias("normalized"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'thand')")
def search_substring(spark, d):
    return records.search_substring(t(spark, d, "documents"), F.lower("text"), "thand").select("doc_id", "source")


@query("SELECT doc_id, lang, n_chars, (SELECT count(*) FROM documents WHERE lang = 'fr') > 40 AS has_next FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20 OFFSET 20")
def search_page(spark, d):
    return records.page(t(spark, d, "documents").where("lang = 'fr'").select("doc_id", "lang", "n_chars"), ["doc_id"], records.decode_cursor(records.encode_cursor(20)), 20)


@query("SELECT doc_id, lang, CASE WHEN lang IN ('en', 'fr') THEN text END AS text, CASE WHEN lang = 'en' THEN n_chars END AS n_chars, lang <> 'en' AS text_withheld FROM documents")
def public_projection(spark, d):
    reg = spark.createDataFrame([("en", "cleared", ["text", "n_chars"]), ("fr", "public-domain", ["text"]), ("de", "review-required", ["text"])], "key string, rights string, fields array<string>")
    return records.gate(t(spark, d, "documents").select("doc_id", "lang", "text", "n_chars"), F.broadcast(reg), "lang", ["text", "n_chars"])


@query(
    """WITH g AS (SELECT o_orderpriority, count(*) AS n_rows, round(min(0.5 + (o_totalprice % 1000) / 2000), 3) AS confidence FROM orders GROUP BY 1)
SELECT *, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS level FROM g"""
)
def envelope_confidence(spark, d):
    return records.envelope(t(spark, d, "orders").withColumn("c", 0.5 + (F.col("o_totalprice") % 1000) / 2000), "c", ["o_orderpriority"])


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS n_covered, round(100.0 * count(*) FILTER (n_chars > 1000) / count(*), 1)::DOUBLE AS percent FROM documents GROUP BY ALL")
def coverage_report(spark, d):
    return records.coverage(t(spark, d, "documents"), ["source", "lang"], F.col("n_chars") > 1000)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def class_histogram(spark, d):
    return t(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    """WITH q AS (SELECT (SELECT min(p_name) FROM part) AS q), r AS (SELECT p_partkey, p_name, CASE WHEN p_name = q THEN 0 WHEN starts_with(p_name, q) OR starts_with(q, p_name) THEN 1 WHEN contains(p_name, q) THEN 2 END AS rank FROM part, q)
SELECT p_partkey, p_name, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, length(p_name), p_partkey LIMIT 24"""
)
def candidate_ranking(spark, d):
    part = t(spark, d, "part")
    q = part.agg(F.min("p_name")).first()[0]
    return resolve.rank_names(part.select("p_partkey", "p_name"), F.col("p_name"), q).orderBy("rank", F.length("p_name"), "p_partkey").limit(24)


@query("WITH p AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token, p_partkey FROM part) SELECT token, count(*) AS n FROM p WHERE token <> '' GROUP BY token")
def inverted_index_stats(spark, d):
    return resolve.posting_sizes(resolve.postings(t(spark, d, "part"), "p_partkey", F.col("p_name")))


_TOKENS = "SELECT DISTINCT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS token FROM part"


@query(
    f"""WITH RECURSIVE i AS ({_TOKENS}), n AS (SELECT token, count(*) AS n, list(id) AS ids FROM i GROUP BY 1), f AS (SELECT DISTINCT lower(p_name) AS form, unnest(string_split(lower(p_name), ' ')) AS token FROM part),
r AS (SELECT form, token, n, ids, row_number() OVER (PARTITION BY form ORDER BY n, token) AS r FROM f JOIN n USING (token)),
w(form, r, seen, used) AS (SELECT form, r, ids, 1 FROM r WHERE r = 1 UNION ALL SELECT w.form, r.r, CASE WHEN len(w.seen) + r.n <= 40 THEN list_distinct(list_concat(w.seen, r.ids)) ELSE w.seen END, w.used + (len(w.seen) + r.n <= 40)::INTEGER FROM w JOIN r ON r.form = w.form AND r.r = w.r + 1)
SELECT form, arg_max(len(seen), r)::BIGINT AS n_candidates, arg_max(used, r)::BIGINT AS n_used FROM w GROUP BY form"""
)
def blocking_candidates(spark, d):
    """Candidates of each distinct part name by its rarest tokens, within a budget of 40 distinct entries."""
    index = resolve.postings(t(spark, d, "part"), "p_partkey", F.col("p_name"))
    forms = resolve.postings(t(spark, d, "part").select(F.lower("p_name").alias("p_name")).distinct(), "p_name", F.col("p_name")).withColumnRenamed("id", "form")
    asked = resolve.within_budget(forms.join(resolve.posting_sizes(index), "token"), index, 40).where("used")
    found = asked.join(index, "token").groupBy("form").agg(F.countDistinct("id").alias("n_candidates"))
    return found.join(asked.groupBy("form").agg(F.count("*").alias("n_used")), "form")


@query("WITH n AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT list_sort(list(n)) AS v FROM n) SELECT v[len(v) // 2 + 1] AS median, v[least(floor(len(v) * 0.9)::INTEGER + 1, len(v))] AS p90, v[len(v)] AS most FROM a")
def candidate_quantiles(spark, d):
    return S.nth_shares(t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), "n", {"median": 0.5, "p90": 0.9}, "most")


@query("SELECT c_nationkey, c_custkey, c_acctbal, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 8")
def top_candidates(spark, d):
    return resolve.top(t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 8).withColumn("place", F.col("place").cast("long"))


_LIVES = "b AS (SELECT l_suppkey AS k, min(year(l_shipdate))::INTEGER AS birth, max(year(l_shipdate))::INTEGER AS death, count(DISTINCT year(l_shipdate)) AS n_years FROM lineitem GROUP BY 1)"


@query(f"WITH {_LIVES} SELECT * FROM b")
def life_bounds(spark, d):
    y = F.year("l_shipdate")
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.min(y).alias("birth"), F.max(y).alias("death"), F.countDistinct(y).alias("n_years"))


@query(
    f"""WITH {_LIVES}, k AS (SELECT k, CASE WHEN k % 4 <> 0 THEN birth + k % 9 END AS birth, CASE WHEN k % 3 <> 0 THEN death - 6 + k % 5 END AS death FROM b), p AS (SELECT x.k AS a, y.k AS b, x.birth AS ab, x.death AS ad, y.birth AS bb, y.death AS bd FROM k x JOIN k y ON y.k BETWEEN x.k + 1 AND x.k + 4)
SELECT a, b, CASE WHEN (ab IS NULL AND ad IS NULL) OR (bb IS NULL AND bd IS NULL) THEN 'insufficient' WHEN ab > bd OR bb > ad THEN 'impossible' WHEN ab IS NULL OR bb IS NULL THEN 'insufficient' ELSE 'possible' END AS verdict FROM p"""
)
def chronology_bounds(spark, d):
    x = life_bounds(spark, d).selectExpr("k", "if(k % 4 <> 0, birth + cast(k % 9 as int), null) birth", "if(k % 3 <> 0, death - 6 + cast(k % 5 as int), null) death")
    y = x.selectExpr("k b", "birth birth2", "death death2")
    p = x.selectExpr("k a", "birth", "death", "explode(array(k + 1, k + 2, k + 3, k + 4)) b").join(y, "b")
    return p.select("a", "b", resolve.bounds_verdict(F.col("birth"), F.col("death"), F.col("birth2"), F.col("death2"))["verdict"].alias("verdict"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'click') WHERE r = 1")
def active_revision(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t(spark, d, "events").where("event_type <> 'click'").withColumn("r", F.row_number().over(w)).where("r = 1").select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def revision_flags(spark, d):
    keys = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("x", F.lit(True))
    return t(spark, d, "customer").select("c_custkey").join(keys, "c_custkey", "left").select("c_custkey", F.col("x").isNotNull().alias("has_orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))")
def pending_proposals(spark, d):
    undone = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    live = t(spark, d, "orders").join(undone, "o_orderkey", "left_anti").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(live, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS homonym FROM part")
def homonym_index(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_name", (F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1).cast("long").alias("homonym"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, r_name FROM events JOIN region ON r_regionkey = json_extract_string(props, '$.k')::BIGINT % 5")
def json_payload_join(spark, d):
    e = t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.join(t(spark, d, "region"), F.col("r_regionkey") == F.col("k") % 5).select("event_id", "k", "r_name")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def constraint_violations(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT s_suppkey, 'SA-P-' || array_to_string(list_transform(range(0, 8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha256(s_name), 2 * i::INTEGER + 1, 2))::INTEGER % 32) + 1, 1)), '') AS stable_key FROM supplier")
def stable_keys(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", S.stable_key("SA-P-", F.col("s_name")).alias("stable_key"))


_JUDGED = "j AS (SELECT lang, quality, toxic, n_chars > 1500 AS said FROM documents JOIN labels USING (doc_id))"


@query(
    f"""WITH {_JUDGED}, g AS (SELECT grouping(lang, toxic)::INTEGER AS gid, lang, toxic, count(*) FILTER (quality = 1 AND said) AS tp, count(*) FILTER (quality <> 1 AND said) AS fp, count(*) FILTER (quality = 1 AND NOT said) AS fn
FROM j GROUP BY GROUPING SETS ((), (lang), (toxic), (lang, toxic)))
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 6) AS recall FROM g"""
)
def stratified_metrics(spark, d):
    j = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id")
    return resolve.precision_recall(j, ["lang", "toxic"], F.col("quality") == 1, F.col("n_chars") > 1500)


@query(
    f"""WITH {_JUDGED}, r AS (SELECT quality AS a, said::INTEGER AS b FROM j), s AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INTEGER) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM r)
SELECT n::BIGINT AS n, round(po, 6) AS observed, round(pe, 6) AS chance, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM s"""
)
def agreement_kappa(spark, d):
    j = t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id")
    return resolve.kappa(j.select("quality", (F.col("n_chars") > 1500).cast("int").alias("said")), "quality", "said")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % 100 + 1 WHERE s_acctbal > 0")
def identity_links(spark, d):
    s = t(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 100 + 1).alias("s_suppkey")).join(s, "s_suppkey").select("p_partkey", "s_suppkey")
