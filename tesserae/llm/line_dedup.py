"""Line dedup by site-relative frequency.

A page is a row, its host names the site. For each host and line: the pages that have the line, divided by the
host's pages. Lines over `ratio`, and on at least `min_pages` pages (a line on one page is no repetition), are boilerplate
and go from every page of that host. Lines are compared without outer spaces; a page counts once however often it has the line.

The counts combine before they are shuffled, so a host with a third of all pages is no hot spot. A host has at most
(its mean of distinct lines) / ratio boilerplate lines. They are broadcast if a count shows that they are few, else
each host's set goes to `SALTS` places where its pages, dealt by their text, meet it.

Nulls and edges: null text stays null and counts as a page without lines; rows without host stay as they are; empty
lines are never boilerplate; a page that loses all lines keeps its row with what is left; repeated rows are pages each; an
empty table gives no row. Every column is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import materialize, table

RATIO, MIN_PAGES, SALTS = 0.05, 2, 64
#: Boilerplate lines (16 bytes each) that a broadcast may hold.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    """Two 64-bit hashes of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with text_col cleaned; columns _ts_lines and _ts_dropped count its lines and those dropped."""
    lines = F.split(F.col(text_col), "\n", -1)
    distinct = F.filter(F.array_distinct(F.transform(lines, F.trim)), lambda x: x != "")
    counted = docs.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias("_ts_host"), F.coalesce(F.transform(distinct, _key), F.array()).alias("_ts_keys"))
    pages = counted.groupBy("_ts_host").agg(F.count("*").alias("_ts_pages"))
    having = counted.select("_ts_host", F.explode_outer("_ts_keys").alias("k")).where("k is not null").groupBy("_ts_host", F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count("*").alias("n"))
    over = having.where(F.col("n") >= min_pages).join(pages, "_ts_host").where(F.col("n") > ratio * F.col("_ts_pages"))
    over = materialize(over.select("_ts_host", F.struct("a", "b").alias("k")))
    sets = over.groupBy("_ts_host").agg(F.collect_set("k").alias("_ts_over"))
    if over.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        met = docs.join(F.broadcast(sets), F.col(host_col) == F.col("_ts_host"), "left")
    else:
        sets = sets.withColumn("_ts_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col(text_col)), F.lit(SALTS)).cast("int")
        met = docs.withColumn("_ts_dealt", salt).join(sets, (F.col(host_col) == F.col("_ts_host")) & (F.col("_ts_dealt") == F.col("_ts_salt")), "left").drop("_ts_dealt")
    keep = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_ts_over"), _key(F.trim(x))))
    kept = F.when(F.col("_ts_over").isNull(), lines).otherwise(keep)
    out = met.withColumn("_ts_kept", kept)
    n, m = (F.coalesce(F.size(x), F.lit(0)).cast("long") for x in (lines, F.col("_ts_kept")))
    out = out.withColumn("_ts_lines", F.when(F.col(text_col).isNull(), 0).otherwise(n)).withColumn("_ts_dropped", F.when(F.col(text_col).isNull(), 0).otherwise(n - m))
    out = out.withColumn(text_col, F.when(F.col("_ts_dropped") == 0, F.col(text_col)).otherwise(F.array_join("_ts_kept", "\n")))
    return out.select(*docs.columns, "_ts_lines", "_ts_dropped")


def op4_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).selectExpr("doc_id", "source", "text", "_ts_lines n_lines", "_ts_dropped n_dropped")


QUERIES = {"op4_site_line_dedup": op4_site_line_dedup}
ORACLES = {
    "op4_site_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, source, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ')))) AS line FROM d WHERE source IS NOT NULL),
n AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT source, line, count(*) AS c FROM l WHERE line <> '' GROUP BY source, line),
o AS (SELECT f.source, list(line) AS bad FROM f JOIN n USING (source) WHERE c >= 2 AND c > 0.05::DOUBLE * pages GROUP BY f.source),
k AS (SELECT d.*, list_filter(ls, lambda x: bad IS NULL OR trim(x, ' ') = '' OR NOT list_contains(bad, trim(x, ' '))) AS good FROM d LEFT JOIN o USING (source))
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(good, chr(10)) END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(good) END::BIGINT AS n_dropped
FROM k"""
}
