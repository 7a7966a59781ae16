"""Benchmark decontamination with DataFrame functions only.

Texts become words (runs of letters, digits and marks, lower case) and shingles of five words. An item of n shingles
is sought in windows of n shingles. Moving a window's start to its first shingle that is one of an item of that size never
lowers its weighted similarity to that item (sum of minima over sum of maxima of the shingles' counts), so windows start
at such shingles only.

Equal windows are taken once. Each gets a 64-bit SimHash: lanes of 32 bits in 32 sums count, over its shingles, how often
each bit is set. Fingerprints within `RADIUS` differ in at most RADIUS // 5 bits in one of five blocks; each item is listed
under every block value that near to its own, so a join on (size, block, value) finds all fingerprints within the radius,
and that is what pairs windows with items. At the threshold 0.8 the mean distance is 9.6 bits with a deviation of 2.9, so
the radius of 19 loses one in a thousand of the pairs exactly at the threshold, and none that are well over it. What is
within the radius is then verified exactly. An item of fewer than five words is one shingle of all its words, and its
windows are runs of that many words; equal ones have equal fingerprints, so a join on the shingle finds them.

Hot passages: counts combine before a shuffle, equal windows collapse to the place of one of them, whose shingles alone are
read, and the joins that a passage's many windows meet in are plain joins that adaptive execution splits. The shingles of
the benchmark are broadcast only if a count shows that they are few.

Nulls and edges: null ids, null and empty texts and items without words match nothing; repeated documents give a row each
for each item; a document shorter than an item is one window of its own size; empty tables give no row. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_ROWS, materialize, small, table

WORDS, THRESHOLD, RADIUS = 5, 0.8, 19
#: (first bit, bits) of the blocks of a fingerprint.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def shingles(text: Column, width: int = WORDS) -> Column:
    """64-bit hashes of the runs of `width` words, in their order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))
    runs = lambda ws: F.when(F.size(ws) < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))
    )
    # the outer transform binds the words, which the inner one would else find anew for each run
    return F.element_at(F.transform(F.array(words), runs), 1)


def _fingerprints(df: DataFrame, keys: list[str], shingle_col: str) -> DataFrame:
    """keys and fp: the SimHash of each row's shingles."""
    one = df.select(*keys, F.explode(shingle_col).alias("_h"))
    # the bits 2k and 2k+1 of a hash, each in a lane of 32 bits
    lane = lambda k: F.expr(f"(shiftrightunsigned(_h, {2 * k}) & 1L) | shiftleft(shiftrightunsigned(_h, {2 * k + 1}) & 1L, 32)")
    sums = one.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(lane(k)).alias(f"_s{k}") for k in range(32)])
    bits = [f"shiftleft(if(2 * (shiftrightunsigned(_s{k}, {32 * j}) & 4294967295L) > _n, 1L, 0L), {2 * k + j})" for k in range(32) for j in range(2)]
    # in four parts, so that the generated code stays small
    for q in range(4):
        sums = sums.withColumn(f"_q{q}", F.expr(" | ".join(bits[16 * q : 16 * q + 16])))
    return sums.select(*keys, F.expr("_q0 | _q1 | _q2 | _q3").alias("fp"))


def _similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of counts."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x))))
    return both / (F.size(a) + F.size(b) - both)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(id, row_hash, item, start, similarity): the best window of each document row and item; start in words.
    row_hash is the xxhash64 of the text, to tell rows that share an id."""
    words = F.regexp_extract_all(F.lower(F.col(item_text)), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))
    known = materialize(benchmark.select(F.col(item_col).alias("item"), shingles(F.col(item_text)).alias("ih"), words.alias("ws")).where("item is not null and size(ws) > 0").withColumn("n", F.size("ih")))
    items = known.where("n > 0").drop("ws")
    index = materialize(items.select("n", F.explode("ih").alias("h")).distinct())
    # plain rows, as the driver holds what is broadcast several times over
    few = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sizes, known_h = (F.broadcast(x) if few else x for x in (index, index.select("h").distinct()))

    # rows that have a shingle of an item
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("t")).where("id is not null")
    # outer: else Spark infers a filter that would build the shingles twice
    at = d.select("id", "row_hash", F.explode_outer(shingles(F.col("t"))).alias("h")).join(known_h, "h", "left_semi")
    rows = small(materialize(at.select("id", "row_hash").distinct()))
    found = d.join(rows, ["id", "row_hash"]).groupBy("id", "row_hash").agg(F.first("t").alias("t"), F.count("*").alias("times"))
    found = materialize(found.select("id", "row_hash", "times", shingles(F.col("t")).alias("hs")))

    # the windows that begin at the places of such shingles, by their hashes; of equal ones the shingles of the first
    hits = found.select("id", "row_hash", F.posexplode("hs").alias("p", "h")).join(sizes, "h").select("id", "row_hash", "p", "n")
    placed = hits.groupBy("id", "row_hash").agg(F.collect_set(F.struct("n", "p")).alias("ps")).join(found, ["id", "row_hash"])
    at = lambda x: F.greatest(F.lit(0), F.least(x["p"], F.size("hs") - x["n"]))
    starts = F.array_distinct(F.transform("ps", lambda x: F.struct(x["n"].alias("n"), at(x).alias("p"))))
    cut = lambda x: F.slice("hs", x["p"] + 1, x["n"])
    hashed = F.transform(starts, lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p"), F.xxhash64(cut(x)).alias("a"), F.xxhash64(F.lit(7), cut(x)).alias("b")))
    windows = placed.select("id", "row_hash", "times", F.inline(hashed))
    windows = materialize(windows)
    first = windows.groupBy("n", "a", "b").agg(F.min(F.struct("id", "row_hash", "p")).alias("x")).select("n", "a", "b", "x.*")
    distinct = materialize(first.join(found.select("id", "row_hash", "hs"), ["id", "row_hash"]).select("n", "a", "b", F.slice("hs", F.col("p") + 1, F.col("n")).alias("w")))

    # all fingerprints within the radius, then the exact similarity
    mask = lambda lo, bits: F.col("fp").bitwiseAND(F.lit(((1 << bits) - 1) << lo if lo + bits < 64 else -(1 << lo)))
    prints = _fingerprints(distinct, ["n", "a", "b"], "w")
    probes = prints.select("n", "a", "b", "fp", F.posexplode(F.array(*[F.shiftrightunsigned(mask(lo, bits), lo) for lo, bits in BLOCKS])).alias("block", "value"))
    own = _fingerprints(items, ["item", "n"], "ih")
    near = [F.expr(f"transform(filter(sequence(0L, {(1 << bits) - 1}L), m -> bit_count(m) <= {radius // len(BLOCKS)}), m -> m ^ shiftrightunsigned(fp, {lo}) & {(1 << bits) - 1}L)") for lo, bits in BLOCKS]
    listed = own.select("item", "n", F.col("fp").alias("ifp"), F.posexplode(F.array(*near)).alias("block", "values")).select("item", "n", "ifp", "block", F.explode("values").alias("value"))
    cand = probes.join(listed, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("n", "a", "b", "item").distinct()
    checked = cand.join(distinct, ["n", "a", "b"]).join(items.select("item", "ih"), "item").withColumn("similarity", _similarity(F.col("w"), F.col("ih")))
    matched = materialize(checked.where(F.col("similarity") >= threshold - 1e-12).select("n", "a", "b", "item", "similarity"))
    out = windows.select("id", "row_hash", "times", "n", "p", "a", "b").join(matched, ["n", "a", "b"])
    best = out.groupBy("id", "row_hash", "item").agg(F.max(F.struct("similarity", (-F.col("p")).alias("q"))).alias("m"), F.first("times").alias("times"))
    best = best.select("id", "row_hash", "item", "times", (-F.col("m.q")).cast("long").alias("start"), F.col("m.similarity").alias("similarity"))
    short = known.where("n = 0")
    for width in [r.w for r in short.select(F.size("ws").alias("w")).distinct().collect()]:  # 1 to 4
        one = short.where(F.size("ws") == width).select("item", F.xxhash64(*[F.get("ws", F.lit(k)) for k in range(width)]).alias("h"))
        at = d.select("id", "row_hash", F.posexplode(shingles(F.col("t"), width)).alias("p", "h")).join(small(one), "h")
        same = at.groupBy("id", "row_hash", "item").agg(F.min("p").cast("long").alias("start"))
        times = d.groupBy("id", "row_hash").agg(F.count("*").alias("times"))
        best = best.unionByName(same.join(times, ["id", "row_hash"]).withColumn("similarity", F.lit(1.0)))
    best = best.withColumn("_r", F.explode(F.expr("sequence(1L, times)")))
    return best.select("id", "row_hash", "item", "start", "similarity")


#: Stands for a missing id while rows are looked for; a row's text tells it apart all the same.
_NO_ID = -(1 << 63)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item, those without an id among them."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    found = find_leaks(docs.select(key.alias("_ts_key"), F.col(text_col).alias("_ts_text")), benchmark, "_ts_key", "_ts_text")
    bad = small(materialize(found.selectExpr("id _ts_id", "row_hash _ts_hash").distinct()))
    return docs.join(bad, (key == F.col("_ts_id")) & (F.xxhash64(F.col(text_col)) == F.col("_ts_hash")), "left_anti")


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", F.round("similarity", 6).alias("similarity"))


QUERIES = {"op2_simhash_decontamination": op2_simhash_decontamination}
ORACLES: dict[str, str] = {}
