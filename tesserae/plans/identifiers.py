"""Bindings of the identifiers and parameters to names given as rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import identifiers as I
from tesserae.functions import scalars as S
from tesserae.plans.catalogue import given, query, t
from tesserae.plans.literal import Literal, ctes

NAMES = Literal(
    "names",
    "record string, chain_order int, position int, form string, norm string, relative boolean",
    [
        ("b-1", 0, 0, "مَالِكُ بْنُ أَنَسٍ", "مالك بن انس", False),
        ("b-1", 0, 1, "عن  نافع", "عن نافع", False),
        ("b-1", 1, 2, "أبيه", "ابيه", True),
        ("b-2", 0, 2, "أَبِيهِ", "ابيه", True),
        ("b-2", 0, 3, "عمه عبد الله", "عمه عبد الله", True),
        ("b-3", 0, 0, "", "", False),
        ("b-3", 0, 1, None, "", False),
        ("b-4", 0, 0, "Ibn Sīrīn", "b sirin", False),
        ("b-5", 2, 1, "هشام بن عروة", "هشام بن عروه", False),
        ("b-6", 0, 0, "يحيى ٱلقطان", "يحيي القطان", False),
    ],
)
_SHORT = "substr(sha1(norm), 1, 12)"


@given(f"WITH {NAMES.cte} SELECT record, position, norm AS normalized, coalesce(relative, false) AS relative FROM names")
def normalized_names(spark, d):
    """Normalization of Arabic and Latin names: marks, letter variants, ibn and bin, white space."""
    return NAMES.df(spark).select("record", "position", S.normalize(F.col("form")).alias("normalized"), F.coalesce(I.is_relative(F.col("form")), F.lit(False)).alias("relative"))


@given(
    f"""WITH {NAMES.cte} SELECT record, position, CASE WHEN norm = '' OR relative THEN 'UNC-REL-' || substr(sha1(record || ':' || chain_order || ':' || position || ':' || norm), 1, 12) ELSE 'UNC-' || {_SHORT} END AS bucket,
CASE WHEN norm <> '' AND NOT relative THEN 'UNC-' || {_SHORT} END AS cluster FROM names"""
)
def bucket_ids(spark, d):
    n = NAMES.df(spark)
    return n.select("record", "position", I.bucket_id(F.col("record"), F.col("chain_order"), F.col("position"), F.col("form")).alias("bucket"), I.cluster_of_name(F.col("form")).alias("cluster"))


_KEY = "'SA-P-' || array_to_string(list_transform(range(0, 8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha256({0}), 2 * i::INTEGER + 1, 2))::INTEGER % 32) + 1, 1)), '')"


@query(f"WITH c AS (SELECT s_suppkey, 'UNC-' || substr(sha1(s_name), 1, 12) AS cluster, (s_suppkey % 3)::INTEGER AS n FROM supplier), k AS (SELECT *, CASE WHEN n > 0 THEN cluster || '#' || n ELSE cluster END AS seed FROM c) SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN {_KEY.format('seed')} END AS person, CASE WHEN s_suppkey % 5 <> 0 THEN 'cluster' ELSE 'unknown' END AS kind, 'canonical' AS person_kind FROM k")
def canonical_keys(spark, d):
    """Keys of buckets with their collision index; an odd bucket has none."""
    s = t(spark, d, "supplier")
    cluster = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "X-").otherwise("UNC-"), S.short_hash(F.col("s_name")))
    key = I.person_key_of_cluster(F.col("cluster"), F.col("n"))
    return s.select("s_suppkey", cluster.alias("cluster"), (F.col("s_suppkey") % 3).cast("int").alias("n")).select("s_suppkey", key.alias("person"), I.id_kind(F.col("cluster")).alias("kind"), I.id_kind(F.coalesce(key, I.person_key(F.col("cluster")))).alias("person_kind"))


_FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(s_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_IMUL = "(({0})::HUGEINT * ({1})::HUGEINT) % 4294967296"


@query(
    f"""WITH s AS (SELECT s_suppkey, ({_FNV})::BIGINT AS seed FROM supplier), a AS (SELECT *, (seed + {_IMUL.format("s_suppkey % 7 + 1", "1831565813")})::BIGINT % 4294967296 AS st FROM s),
b AS (SELECT *, ({_IMUL.format("xor(st, st >> 15)", "st | 1")})::BIGINT AS v FROM a), c AS (SELECT *, xor(v, ((v + {_IMUL.format("xor(v, v >> 7)", "v | 61")}) % 4294967296)::BIGINT) AS w FROM b)
SELECT s_suppkey, seed, xor(w, w >> 14) / 4294967296.0::DOUBLE AS number FROM c"""
)
def seeded_numbers(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", I.text_seed(F.col("s_name")).alias("seed"))
    return s.select("s_suppkey", "seed", I.nth_random(F.col("seed"), F.col("s_suppkey") % 7 + 1).alias("number"))


@query("SELECT p_brand, substr(sha256(string_agg(p_partkey::VARCHAR, chr(10) ORDER BY p_partkey)), 1, 32) AS digest FROM part GROUP BY p_brand")
def frame_digests(spark, d):
    ids = F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string"))
    return t(spark, d, "part").groupBy("p_brand").agg(I.frame_digest(ids).alias("digest"))


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


@query(f"SELECT s_suppkey, ['teal', 'clay', 'gold', 'ink', 'sage'][({_HASH} % 5 + 1)::INTEGER] AS colour, substr(s_name, 1, 8) AS label FROM supplier")
def fallback_colours(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", I.colour_of(F.col("s_name")).alias("colour"), I.shortened(F.col("s_name")).alias("label"))


STATES = Literal(
    "states",
    "k int, status string, level string, score double, q string, n string, sort string, a string, b string",
    [
        (1, "high", "high", 0.93, "malik", "20", "name", '{"b": 1, "a": [1, 2]}', '{"a":[1,2],"b":1}'),
        (2, "unresolved-relative", "high", 0.71, None, "0", "date", '{"a": 1}', '{"a": 2}'),
        (3, "prophet-mention", "medium", 0.7, "", "x", "x", "no json", "no json"),
        (4, None, "verified", None, "ab", "999", None, None, None),
        (5, "conflict", "low", None, "a" * 300, "-3", "name", "[]", "{}"),
    ],
)


@given(
    f"""WITH {STATES.cte} SELECT k, CASE WHEN status IN ('verified', 'high', 'medium', 'low', 'unresolved', 'conflict') THEN status ELSE 'unresolved' END AS status,
score IS NULL OR level = 'verified' OR level = CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS sound,
substr(coalesce(q, ''), 1, 240) AS q, CASE WHEN try_cast(n AS INTEGER) IS NULL THEN 20 ELSE greatest(1, least(100, try_cast(n AS INTEGER))) END AS n, CASE WHEN sort IN ('name', 'date') THEN sort END AS sort, coalesce(k = 1, false) AS same, CASE WHEN k = 3 THEN 'no json' ELSE replace(CASE k WHEN 1 THEN '{{"a":[1,2],"b":1}}' ELSE a END, ' ', '') END AS kept FROM states"""
)
def parameters_and_states(spark, d):
    """Parameters within their bounds, states in the common vocabulary, levels against their scores, JSON by its canonical form."""
    same = F.coalesce(I.canonical_json(F.col("a")) == I.canonical_json(F.col("b")), F.lit(False))
    return STATES.df(spark).select(
        "k", I.occurrence_status(F.col("status")).alias("status"), I.level_matches(F.col("level"), F.col("score")).alias("sound"), I.cut_query(F.col("q")).alias("q"),
        I.clamp_int(F.col("n"), 1, 100, 20).alias("n"), I.one_of(F.col("sort"), ["name", "date"]).alias("sort"), same.alias("same"), I.parse_or_keep(F.col("a")).alias("kept"),
    )


@query("""WITH y AS (SELECT o_custkey AS k, min(year(o_orderdate))::INTEGER AS lo, max(year(o_orderdate))::INTEGER AS hi FROM orders GROUP BY 1), b AS (SELECT k, (floor((lo - 10) / 10.0) * 10)::INTEGER AS first, (ceil((hi + 10) / 10.0) * 10)::INTEGER AS last FROM y)
SELECT k, first, last, ((last - first) // 25 + 1)::INTEGER AS n_ticks, (first + 25 * ((last - first) // 25))::INTEGER AS last_tick FROM b""")
def timeline_domains(spark, d):
    y = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.year("o_orderdate")).alias("years"))
    x = y.select("k", I.timeline_domain(F.col("years")).alias("x"))
    return x.select("k", "x.first", "x.last", F.size("x.ticks").alias("n_ticks"), F.array_max("x.ticks").alias("last_tick"))
