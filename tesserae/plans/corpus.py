"""Bindings of the record store's operators to the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import corpus as C
from tesserae.plans.catalogue import given, _ORDER, query, t
from tesserae.plans.literal import Literal

_POS = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1"


def _occurrences(spark, d):
    from tesserae.operators.chains import positions

    return positions(t(spark, d, "lineitem"), "l_orderkey", _ORDER).withColumn("position", F.col("position").cast("long"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, o_custkey, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 45")
def record_sources(spark, d):
    """Records with their passage and its work."""
    r = t(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey", "l_linenumber")
    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return C.with_sources(r, p, t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "l_orderkey", "o_custkey")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def entry_works(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return C.with_sources(t(spark, d, "supplier"), n, t(spark, d, "region"), "s_nationkey", "r_regionkey").select("s_suppkey", "s_name", "n_name", "r_name")


@query(f"WITH o AS (SELECT l_orderkey, l_suppkey, {_POS} AS position FROM lineitem) SELECT o_custkey, l_orderkey, position, l_suppkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, position) AS n FROM o JOIN orders ON o_orderkey = l_orderkey")
def ordered_occurrences(spark, d):
    """Occurrences by record, chain and position."""
    from pyspark.sql import Window

    o = _occurrences(spark, d).select("l_orderkey", "l_suppkey", "position").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey", "position")).cast("long")).select("o_custkey", "l_orderkey", "position", "l_suppkey", "n")


@query(
    """SELECT event_id, n_name FROM (SELECT event_id, coalesce(c_nationkey, s_nationkey, p_size) AS passage FROM events LEFT JOIN customer ON c_custkey = event_id LEFT JOIN supplier ON s_suppkey = user_id LEFT JOIN part ON p_partkey = event_id // 2)
JOIN nation ON n_nationkey = passage"""
)
def evidence_passages(spark, d):
    """The passage of an evidence by the first of three routes."""
    e = t(spark, d, "events").select("event_id", F.col("event_id").alias("c_custkey"), F.col("user_id").alias("s_suppkey"), F.floor(F.col("event_id") / 2).alias("p_partkey"))
    e = C.first_route(e, [(t(spark, d, "customer"), "c_custkey", "c_nationkey"), (t(spark, d, "supplier"), "s_suppkey", "s_nationkey"), (t(spark, d, "part"), "p_partkey", "p_size")], "n_nationkey")
    return e.join(t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("event_id", "n_name")


@query("SELECT p_partkey, p_name FROM part n WHERE EXISTS (SELECT 1 FROM part o WHERE o.p_name = n.p_name AND o.p_partkey < n.p_partkey)")
def later_homonyms(spark, d):
    return C.with_earlier(t(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query(f"SELECT l_orderkey, {_POS} AS position, l_suppkey, s_name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 <> 0")
def ordered_lookup(spark, d):
    """The names of a chain's nodes, duplicates and unknown ones in their places."""
    known = t(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return C.lookup(_occurrences(spark, d).select("l_orderkey", "position", "l_suppkey"), "l_suppkey", known, ["s_name"])


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) BETWEEN 1995 AND 1996) AS in_range FROM customer")
def year_in_range(spark, d):
    years = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.year("o_orderdate")).alias("years"))
    c = t(spark, d, "customer").select("c_custkey").join(years, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce(F.exists("years", lambda y: y.between(1995, 1996)), F.lit(False)).alias("in_range"))


@query("WITH f AS (SELECT doc_id, substr(sha1(text), 1, 12) AS family FROM documents WHERE lang = 'en') SELECT coalesce(family, '__unassigned__') AS family, count(*) AS n FROM labels LEFT JOIN f USING (doc_id) GROUP BY 1")
def occurrence_families(spark, d):
    f = t(spark, d, "documents").where("lang = 'en'").select("doc_id", F.substring(F.sha1("text"), 1, 12).alias("family"))
    return C.families_of(t(spark, d, "labels").select("doc_id"), f, "doc_id", "family").groupBy("family").agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT DISTINCT p_partkey, unnest([p_name, p_brand]) AS form FROM part), f AS (SELECT DISTINCT p_name AS form FROM part UNION SELECT 'none') SELECT form, count(p_partkey) AS heads, count(p_partkey) >= 2 AS homonym FROM f LEFT JOIN h USING (form) GROUP BY form")
def form_heads(spark, d):
    """Exact heads of each form over two name fields, and whether it is a homonym."""
    part = t(spark, d, "part")
    forms = part.select(F.col("p_name").alias("form")).distinct().unionByName(spark.createDataFrame([("none",)], "form string"))
    return C.named_heads(forms, "form", part, ["p_name", "p_brand"]).withColumn("homonym", F.col("heads") >= 2)


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS evidence FROM customer")
def evidence_counts(spark, d):
    return C.count_of(t(spark, d, "customer").select("c_custkey"), "c_custkey", t(spark, d, "orders"), "o_custkey", "evidence")


@query("SELECT c_custkey, coalesce(v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def updated_balances(spark, d):
    new = t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return C.updated(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", new, "c_acctbal")


@query(f"WITH o AS (SELECT l_orderkey, l_suppkey, {_POS} AS position FROM lineitem) SELECT *, lag(l_suppkey) OVER w AS previous, lead(l_suppkey) OVER w AS next FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY position)")
def neighbour_forms(spark, d):
    return C.neighbours(_occurrences(spark, d).select("l_orderkey", "l_suppkey", "position"), "l_orderkey", "position", "l_suppkey")


@query(
    r"""WITH p AS (SELECT doc_id, length(text) AS n, string_split_regex(text, '[0-9]+') AS b, regexp_extract_all(text, '[0-9]+') AS m FROM documents), x AS (SELECT doc_id, n, unnest(range(1, len(m) + 1)) AS i, b, m FROM p),
s AS (SELECT doc_id, n, i, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM x)
SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n)::BIGINT AS segment_end FROM s"""
)
def number_segments(spark, d):
    """Segments of a text from each number to the next."""
    runs = t(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\G[^0-9]*+[0-9]++"), F.lit(0))).alias("i", "m"))
    from pyspark.sql import Window

    upto = F.sum(F.length("m")).over(Window.partitionBy("doc_id").orderBy("i"))
    marks = runs.select("doc_id", "n", (upto - F.length(F.regexp_extract("m", "[0-9]+$", 0))).cast("long").alias("start"))
    return C.segments(marks, "doc_id", "start", F.col("n")).select("doc_id", "start", "segment_end")


@query("SELECT l_orderkey, l_suppkey, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_returnflag DESC, l_partkey, l_linenumber, l_quantity) AS n FROM lineitem) WHERE n = 1")
def first_mentions(spark, d):
    """Each name once within its entry, the higher list first."""
    li = t(spark, d, "lineitem")
    return C.once_each(li, "l_orderkey", F.col("l_suppkey"), [F.desc("l_returnflag"), "l_partkey", "l_linenumber", "l_quantity"]).select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag")


@query(
    """WITH p AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations),
o AS (SELECT conv_id, unnest([0, 40, 200, 1000])::BIGINT AS place FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT o.conv_id, place, max(turn) AS turn FROM o JOIN p ON p.conv_id = o.conv_id AND s <= place GROUP BY ALL"""
)
def pages_of_offsets(spark, d):
    """The turn on which a place of the whole conversation falls."""
    c = t(spark, d, "conversations")
    asked = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 40, 200, 1000)])).alias("place"))
    return C.page_of(asked, c.select("conv_id", "turn", F.length("text").alias("n")), "conv_id", "place", "turn", "n")


@query("SELECT c_custkey, array_to_string(list_slice(o, 1, 3), ',') AS items, len(o) > 3 AS truncated FROM (SELECT o_custkey AS c_custkey, list(o_orderkey ORDER BY o_orderkey) AS o FROM orders GROUP BY 1)")
def occurrence_preview(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(C.preview(F.sort_array(F.collect_list("o_orderkey")), 3).alias("p"))
    return o.select("c_custkey", F.array_join(F.transform("p.items", lambda x: x.cast("string")), ",").alias("items"), "p.truncated")


@query("SELECT lang, doc_id, record_count, record_count > 25 AS truncated FROM (SELECT lang, doc_id, count(*) OVER (PARTITION BY lang) AS record_count, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 25")
def record_window(spark, d):
    return C.records_window(t(spark, d, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 25)


@query("WITH p AS (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 7 OFFSET 7), n AS (SELECT count(*) AS m, (SELECT count(*) FROM documents WHERE lang = 'fr') > 14 AS more FROM p) SELECT CASE WHEN more THEN 14 END AS by_limit, CASE WHEN more THEN 7 + m END AS by_rows FROM n")
def next_cursors(spark, d):
    from tesserae.operators.records import page

    p = page(t(spark, d, "documents").where("lang = 'fr'").select("doc_id"), ["doc_id"], 7, 7)
    return p.agg(F.count("*").alias("n"), F.max("has_next").alias("more")).select(C.next_cursor(7, 7, F.col("n"), F.col("more")).alias("c")).select("c.*")


@query("SELECT corpus_order, n, id, name FROM (SELECT 0 AS corpus_order, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier) JOIN (SELECT 0 AS corpus_order, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 1, (SELECT count(*) FROM supplier)) USING (corpus_order)")
def all_entries(spark, d):
    """Two collections as one scan in a fixed order, with the size of each."""
    both = C.in_order(t(spark, d, "customer").selectExpr("c_custkey id", "c_name name"), t(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name"))
    return both.join(both.groupBy("corpus_order").agg(F.count("*").alias("n")), "corpus_order")


RECORDS = Literal(
    "records",
    "id string, collection string, number int, n_chains int, markers int, forms array<string>, phrase string, rights string, fields array<string>, regions array<string>, more array<string>, pick string",
    [
        ("b-1", "bukhari", 1, 2, 3, ["مالك", "نافع"], "سَمِعَ من نافع", "cleared", ["teacher_student_phrases"], ["Medina", "Mecca"], ["Mecca", "Kufa"], "collection"),
        ("b-2", "bukhari", 2, 0, 4, ["شعبة", "قتادة", "أنس"], "لم يثبت", "review-required", ["teacher_student_phrases"], [], ["Basra", "Basra"], "number"),
        ("m-1", "muslim", 3, 0, None, [], "روى عن أبيه", "cleared", [], None, ["Kufa"], "nothing"),
        ("m-2", "muslim", 4, None, None, None, None, "public-domain", None, None, None, None),
    ],
)


@given(
    f"""WITH {RECORDS.cte} SELECT id, CASE WHEN n_chains > 0 THEN n_chains ELSE coalesce(markers, 1) END AS chain_count, CASE WHEN rights IN ('cleared', 'public-domain', 'editorially-cleared') AND list_contains(fields, 'teacher_student_phrases') THEN phrase END AS phrase,
coalesce(id IN ('b-1', 'm-1'), false) AS hearing, CASE id WHEN 'b-1' THEN 'Medina,Mecca,Kufa' WHEN 'b-2' THEN 'Basra' WHEN 'm-1' THEN 'Kufa' ELSE '' END AS regions, CASE pick WHEN 'collection' THEN collection WHEN 'number' THEN number::VARCHAR END AS picked,
collection || ':' || number AS reference FROM records"""
)
def record_projections(spark, d):
    """Chain counts with their fallbacks, statements behind the licence, hearing, joined regions, dynamic columns, references."""
    from tesserae.operators.records import CLEARED

    r = RECORDS.df(spark)
    ref = C.reference(F.col("collection"), F.col("number"))
    return r.select(
        "id", C.chain_count(F.col("n_chains"), F.col("markers")).alias("chain_count"), C.statement_phrase(F.col("phrase"), F.col("rights").isin(*CLEARED), F.col("fields")).alias("phrase"), C.tells_of_hearing(F.col("phrase")).alias("hearing"),
        F.array_join(C.distinct_joined(F.col("regions"), F.col("more")), ",").alias("regions"), C.column_named(r.select("collection", "number"), F.col("pick")).alias("picked"), F.concat_ws(":", ref["source_work"], ref["number"].cast("string")).alias("reference"),
    )


@given(f"WITH {RECORDS.cte} SELECT id, 0 AS chain_order, (i - 1)::INTEGER AS position, forms[i] AS raw FROM (SELECT id, forms, unnest(range(1, len(forms) + 1)) AS i FROM records WHERE coalesce(n_chains, 0) = 0)")
def fallback_chains(spark, d):
    """Records without chains get one of their surface forms."""
    r = RECORDS.df(spark).where("coalesce(n_chains, 0) = 0")
    none = F.lit(None).cast("array<struct<chain_order:int,occurrences:array<struct<position:int,raw:string>>>>")
    c = r.select("id", F.explode(C.chains_or_forms(none, F.col("forms"))).alias("c")).select("id", "c.chain_order", F.explode("c.occurrences").alias("o"))
    return c.select("id", "chain_order", "o.position", "o.raw")


@query("WITH e AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS c FROM lineitem WHERE l_suppkey < 4), k AS (SELECT source, target FROM e GROUP BY ALL HAVING bool_or(c = 'R')) SELECT 'edge' AS kind, count(*) AS n FROM k UNION ALL SELECT 'node', count(*) FROM (SELECT source FROM k UNION SELECT -target FROM k)")
def collection_graph(spark, d):
    """The edges of one collection and the nodes that they touch, counted."""
    li = t(spark, d, "lineitem").where("l_suppkey < 4")
    edges = li.groupBy(F.col("l_suppkey").alias("source"), (-F.col("l_partkey")).alias("target")).agg(F.collect_set("l_returnflag").alias("collections"))
    nodes = li.select(F.col("l_suppkey").alias("id")).unionByName(li.select((-F.col("l_partkey")).alias("id"))).distinct()
    e, n = C.graph_of_collection(edges, nodes, "collections", "R")
    return e.agg(F.lit("edge").alias("kind"), F.count("*").alias("n")).unionByName(n.agg(F.lit("node").alias("kind"), F.count("*").alias("n")))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::DOUBLE / 100 AS confidence, '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' AS packed FROM events WHERE user_id IN (1, 2, 3) AND event_type <> 'click' AND event_id <> 5")
def json_columns(spark, d):
    """Fields of stored JSON, rows packed as JSON, filters by lists of ids and states."""
    e = t(spark, d, "events").where(F.col("user_id").isin(1, 2, 3) & (F.col("event_type") != "click") & (F.col("event_id") != 5))
    row = F.struct("event_id", "user_id", "event_type").dropFields("event_type")
    p = F.from_json("props", "k long")
    return e.select("event_id", p["k"].alias("k"), (p["k"] / 100.0).alias("confidence"), F.to_json(row).alias("packed"))


@query("SELECT o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '، ') AS states, count(*) FILTER (o_orderstatus = 'F') > 0 AS some, bool_and(o_totalprice > 0) AS every FROM orders GROUP BY 1")
def array_functions(spark, d):
    """filter, exists, forall, joins of arrays over collected values."""
    g = t(spark, d, "orders").groupBy("o_orderpriority").agg(F.collect_list(F.struct("o_orderstatus", "o_totalprice")).alias("x"))
    return g.select("o_orderpriority", F.array_join(F.array_sort(F.array_distinct(F.transform("x", lambda y: y["o_orderstatus"]))), "، ").alias("states"), (F.size(F.filter("x", lambda y: y["o_orderstatus"] == "F")) > 0).alias("some"), F.forall("x", lambda y: y["o_totalprice"] > 0).alias("every"))
