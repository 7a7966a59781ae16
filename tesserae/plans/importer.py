"""Bindings of the importer's, the scores' and the editorial operators to the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.functions import text as X
from tesserae.operators import editorial, scoring
from tesserae.plans.catalogue import given, query, t


@query(
    r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(trim(text), '(\D*)(\d{1,4})', 1)) AS b, unnest(regexp_extract_all(trim(text), '(\D*)(\d{1,4})', 2)) AS d, generate_subscripts(regexp_extract_all(trim(text), '(\D*)(\d{1,4})', 2), 1) AS i FROM documents),
o AS (SELECT doc_id, i, d::INTEGER AS year, (sum(length(b) + length(d)) OVER (PARTITION BY doc_id ORDER BY i) - length(d))::INTEGER AS "offset" FROM m),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o WHERE year BETWEEN 1 AND 1100),
r AS (SELECT doc_id, year, "offset", i, CASE WHEN k = 1 THEN 'primary' ELSE 'additional' END AS relation FROM y)
SELECT doc_id, year, relation, min("offset") AS "offset" FROM r GROUP BY doc_id, year, relation"""
)
def year_phrases(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(X.year_phrases(F.col("text"))).alias("y")).select("doc_id", "y.year", "y.relation", "y.offset")


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '\r|&nbsp;|⦗[^⦘]*⦘|(?i:</?span[^>]*>)', '', 'g'), '<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS stripped,
CASE WHEN regexp_matches(html, '[<>⦗⦘]') THEN 'contains-markup' ELSE 'verbatim' END AS integrity FROM pages"""
)
def strip_markup(spark, d):
    return t(spark, d, "pages").select("page_id", X.strip_markup(F.col("html")).alias("stripped"), X.span_integrity(F.col("html")).alias("integrity"))


@query("SELECT event_id, user_id, last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events")
def heading_fill(spark, d):
    return editorial.fill_forward(t(spark, d, "events"), "user_id", ["ts", "event_id"], F.when(F.col("value") > 50, F.col("event_type")), "heading").select("event_id", "user_id", "heading")


@query(
    """WITH RECURSIVE r AS (SELECT c_custkey AS key, c_custkey - 3 AS target FROM customer WHERE c_custkey % 40 > 3),
w(key, target, hops) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT w.key, r.target, hops + 1 FROM w JOIN r ON r.key = w.target WHERE hops < 8),
b AS (SELECT key, arg_max(target, hops) AS target, max(hops) AS hops FROM w GROUP BY key)
SELECT b.key, b.target, b.hops, r.key IS NOT NULL AS truncated FROM b LEFT JOIN r ON r.key = b.target"""
)
def redirect_closure(spark, d):
    keys = t(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return editorial.resolve_redirects(keys, keys.where("key % 40 > 3").selectExpr("key", "key - 3 target"))


_BOUNDS = """b AS (SELECT DISTINCT l_suppkey AS k, year(l_shipdate)::INTEGER AS birth FROM lineitem),
d AS (SELECT DISTINCT l_suppkey AS k, year(l_shipdate)::INTEGER + (l_suppkey % 7)::INTEGER - 3 AS death FROM lineitem), i AS (SELECT k, birth, death FROM b JOIN d USING (k) WHERE birth <= death)"""


@query(f"WITH {_BOUNDS} SELECT * FROM i")
def life_intervals(spark, d):
    y = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y")).distinct()
    return editorial.life_intervals(y.selectExpr("k", "y birth"), y.selectExpr("k", "y + cast(k % 7 as int) - 3 death"), "k")


@query(
    f"""WITH {_BOUNDS}, p AS (SELECT x.k AS a, y.k AS b, least(x.death, y.death) - greatest(x.birth, y.birth) AS o FROM i x JOIN i y ON y.k = x.k + 1),
g AS (SELECT a, b, max(o) FILTER (o > 0) AS overlap_years, min(-o) FILTER (o < 0) AS g FROM p GROUP BY ALL)
SELECT a, b, CASE WHEN overlap_years IS NULL THEN 'impossible' ELSE 'possible' END AS verdict, overlap_years, CASE WHEN overlap_years IS NULL THEN g END AS gap_years FROM g"""
)
def chronology_intervals(spark, d):
    x = life_intervals(spark, d)
    pairs = x.withColumnRenamed("k", "a").join(x.selectExpr("k - 1 a", "k b", "birth birth2", "death death2"), "a")
    return editorial.compare_intervals(pairs, ["a", "b"])


_CELLS = "c AS (SELECT lang || '|' || source AS stratum, count(*) AS cell_size FROM documents GROUP BY 1)"
_QUOTAS = f"""{_CELLS}, f AS (SELECT *, least(1, cell_size) AS base, cell_size - least(1, cell_size) AS free FROM c),
g AS (SELECT *, greatest(0, least(100 - sum(base) OVER (), sum(free) OVER ()))::BIGINT AS rest, greatest(1, sum(free) OVER ())::BIGINT AS whole FROM f),
h AS (SELECT *, free * rest // whole AS n, free * rest % whole AS part FROM g),
q AS (SELECT stratum, cell_size, base + n + (row_number() OVER (ORDER BY part DESC, stratum) <= rest - sum(n) OVER ())::BIGINT AS quota FROM h)"""


@query(f"WITH {_QUOTAS} SELECT * FROM q")
def stratified_quota(spark, d):
    cells = t(spark, d, "documents").groupBy(F.concat_ws("|", "lang", "source").alias("stratum")).agg(F.count("*").alias("cell_size"))
    return editorial.quotas(cells, "stratum", "cell_size", 100)


@query(
    f"""WITH {_QUOTAS}, r AS (SELECT doc_id, lang || '|' || source AS stratum FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('seed|' || stratum || '|' || doc_id), doc_id) AS place FROM r)
SELECT doc_id, stratum, cell_size, cell_size / quota AS weight FROM p JOIN q USING (stratum) WHERE place <= quota"""
)
def stratified_frame(spark, d):
    return editorial.stratified_sample(t(spark, d, "documents"), F.concat_ws("|", "lang", "source"), "doc_id", 100, "seed")


_SCORES = """w AS (SELECT p_partkey AS k, p_name AS name, string_split(lower(p_name), ' ') AS words, string_split(lower(p_type), ' ') AS variant, p_size, p_brand FROM part),
p AS (SELECT x.k AS form, y.k AS candidate, x.name = y.name AS same, len(list_filter(x.words, lambda v: list_contains(y.words, v))) / len(x.words) AS share, len(list_filter(y.variant, lambda v: NOT list_contains(x.words, v))) = 0 AS variant,
x.p_size % 5 = y.p_size % 5 AS region, x.p_brand = y.p_brand AS book, x.p_size > y.p_size + 40 AS dead, abs(x.p_size - y.p_size) > 45 AS blocked FROM w x JOIN w y ON y.k BETWEEN x.k + 1 AND x.k + 3),
s AS (SELECT form, candidate, blocked, round(least(1, greatest(0, round(CASE WHEN same THEN 0.22 WHEN share >= 0.34 THEN round(0.22::DOUBLE * share, 4) ELSE 0 END + CASE WHEN variant AND NOT same THEN 0.18 ELSE 0 END + CASE WHEN region THEN 0.08 ELSE 0 END + CASE WHEN book THEN 0.06 ELSE 0 END + CASE WHEN dead THEN -0.25 ELSE 0 END, 4))), 3)::DOUBLE AS score FROM p)"""


@query(f"WITH {_SCORES} SELECT * FROM s")
def identity_scores(spark, d):
    words = lambda c: F.split(F.lower(c), " ")
    part = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), words("p_name").alias("words"), words("p_type").alias("variant"), "p_size", "p_brand")
    x = part.select(F.col("p_partkey").alias("form"), *[F.col(c).alias(f"x_{c}") for c in part.columns[1:]], F.explode(F.expr("array(p_partkey + 1, p_partkey + 2, p_partkey + 3)")).alias("candidate"))
    p = x.join(part.withColumnRenamed("p_partkey", "candidate"), "candidate")
    score = scoring.total(
        scoring.name_signal(F.col("x_name"), F.col("name"), F.col("x_words"), F.col("words")),
        scoring.variant_signal(F.col("x_name"), F.col("name"), F.col("x_words"), F.array("variant")),
        scoring.flag_signal("region", F.expr("x_p_size % 5 = p_size % 5")),
        scoring.flag_signal("book", F.expr("x_p_brand = p_brand")),
        scoring.flag_signal("death", F.expr("x_p_size > p_size + 40")),
    )
    return p.select("form", "candidate", (F.abs(F.col("x_p_size") - F.col("p_size")) > 45).alias("blocked"), score.alias("score"))


@query(
    f"""WITH {_SCORES}, b AS (SELECT form, max(score) FILTER (NOT blocked) AS score, bool_or(blocked) AS x FROM s GROUP BY form)
SELECT form, (SELECT min(candidate) FROM s WHERE s.form = b.form AND s.score = b.score AND NOT blocked) AS candidate, score, CASE WHEN x THEN 'conflict' WHEN score IS NULL THEN 'unresolved' WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS level, coalesce(score >= 0.9, false) AND NOT x AS auto_link FROM b"""
)
def identity_proposals(spark, d):
    return scoring.proposals(identity_scores(spark, d), "form", "candidate")


@query(
    f"""WITH {_SCORES}, u AS (SELECT form, candidate, blocked, least(1.0, score * 3)::DOUBLE AS score FROM s), r AS (SELECT *, max(score) FILTER (NOT blocked AND score >= 0.8) OVER (PARTITION BY form) AS best FROM u),
m AS (SELECT *, coalesce(score >= 0.8 AND NOT blocked AND round(best - score, 4) < 0.05, false) AS mine FROM r)
SELECT form, candidate, blocked, score, mine AND count(*) FILTER (mine) OVER (PARTITION BY form) > 1 AS competing FROM m"""
)
def competing_candidates(spark, d):
    return scoring.competing(identity_scores(spark, d).withColumn("score", F.least(F.lit(1.0), F.col("score") * 3)), "form", "candidate")


@query("SELECT form, candidate, blocked, score, place FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY score DESC, candidate) AS place FROM s WHERE score > 0 OR blocked) WHERE place <= 8".join([f"WITH {_SCORES} ", ""]))
def ranked_candidates(spark, d):
    return scoring.ranked(identity_scores(spark, d), "form", "candidate").withColumn("place", F.col("place").cast("long"))


@query(
    """WITH n AS (SELECT p_partkey AS k, list_distinct(string_split(p_name, ' ')) AS w, replace(p_name, ' ', '') AS s, p_name FROM part),
g AS (SELECT k, p_name, w, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS t FROM n),
p AS (SELECT x.k, x.p_name = y.p_name AS same, len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) AS j, len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) AS c FROM g x JOIN g y ON y.k = x.k + 1),
f AS (SELECT k, CASE WHEN same THEN 1.0 ELSE round(0.58::DOUBLE * j + 0.42::DOUBLE * c, 4) END AS similarity FROM p)
SELECT k, similarity::DOUBLE AS similarity, similarity >= 0.76 AS suggested FROM f"""
)
def name_similarity(spark, d):
    part = t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name")
    s = part.join(part.selectExpr("k - 1 k", "p_name other"), "k").select("k", S.text_similarity(F.col("p_name"), F.col("other")).alias("similarity"))
    return s.withColumn("suggested", F.col("similarity") >= 0.76)


@query(
    """SELECT rule, n FROM (SELECT 'positive_price' AS rule, count(*) FILTER (l_extendedprice <= 0) AS n FROM lineitem UNION ALL SELECT 'discount_range', count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) FROM lineitem
UNION ALL SELECT 'returned_is_final', count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') FROM lineitem)"""
)
def constraint_report(spark, d):
    rules = {"positive_price": "l_extendedprice > 0", "discount_range": "l_discount between 0 and 0.05", "returned_is_final": "l_returnflag <> 'R' or l_linestatus = 'F'"}
    return editorial.violations(t(spark, d, "lineitem"), {k: F.expr(v) for k, v in rules.items()})


@query("SELECT 'missing' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'extra', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def key_difference(spark, d):
    return editorial.difference(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(
    """WITH a AS (SELECT 'identity' AS kind, o_orderkey AS id, o_orderdate AS created, coalesce(c_name, '?') AS target FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')),
b AS (SELECT 'parse' AS kind, event_id AS id, ts AS created, coalesce(c_name, '?') AS target FROM events LEFT JOIN customer ON c_custkey = user_id WHERE value > 50) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY created DESC, id LIMIT 50"""
)
def review_queue(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    returned = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = t(spark, d, "orders").where("o_orderstatus = 'O'").join(returned, "o_orderkey", "left_anti").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    e = t(spark, d, "events").where("value > 50").join(c, F.col("c_custkey") == F.col("user_id"), "left")
    return editorial.queue(o.selectExpr("'identity' kind", "o_orderkey id", "o_orderdate created", "coalesce(c_name, '?') target"), e.selectExpr("'parse' kind", "event_id id", "ts created", "coalesce(c_name, '?') target"), "created", "id", 50)


@query("""SELECT conv_id, turn, trim(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) AS before, trim(regexp_replace(other, '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) AS after FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS other FROM conversations) WHERE other IS NOT NULL""")
def word_diff(spark, d):
    """Steps from each turn of a conversation to the next, put together again: they give both texts' words."""
    p = t(spark, d, "conversations").selectExpr("conv_id", "turn", "text", "lead(text) over (partition by conv_id order by turn, role, text) other").where("other is not null")
    joined = lambda k: F.array_join(F.filter(F.transform("s", lambda x: x[k]), lambda w: w != ""), " ")
    return p.withColumn("s", X.word_difference(F.col("text"), F.col("other"))).select("conv_id", "turn", joined("before").alias("before"), joined("after").alias("after"))


@given("SELECT * FROM (VALUES (1, 0, 'equal', 'إِنَّمَا الأعمال', 'انما الأعمال'), (2, 0, 'equal', 'إنما الأعمال', 'إنما الأعمال'), (2, 1, 'replacement', 'بالنيات', 'بالنية وزيادة'), (3, 0, 'equal', 'قال زيد', 'قال زيد'), (3, 1, 'addition', '', 'اليوم'), (4, 0, 'equal', 'قال زيد', 'قال زيد'), (4, 1, 'omission', 'اليوم', '')) v(k, step, kind, before, after)")
def word_steps(spark, d):
    """Kinds of steps between two wordings; words are compared in the search form and given as they stand."""
    rows = [(1, "إِنَّمَا الأعمال", "انما الأعمال"), (2, "إنما الأعمال بالنيات", "إنما الأعمال بالنية وزيادة"), (3, "قال زيد", "قال زيد، اليوم"), (4, "قال زيد اليوم", "قال زيد"), (5, None, "")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    return df.select("k", F.posexplode(X.word_difference(F.col("a"), F.col("b"))).alias("step", "s")).select("k", "step", "s.*")


@given("SELECT * FROM (VALUES (2, 'replacement', 'بالنيات', 'بالنية وزيادة'), (3, 'addition', '', 'اليوم'), (4, 'omission', 'اليوم', '')) v(k, kind, before, after)")
def variant_differences(spark, d):
    """What differs between the representatives of two families."""
    return word_steps(spark, d).where("kind <> 'equal'").select("k", "kind", "before", "after")
