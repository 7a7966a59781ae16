"""From raw documents to packed training sequences: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage takes what its predecessor kept, and all but the last return the columns of documents.
Rows without text pass the filters. Rows that share a doc_id, and those without one, are documents of their own: the
near-duplicate stage keeps all whose texts are no near copies. An empty table stays empty; columns beyond those of
documents are kept by all stages but packing. A stage's scratch tables go when its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontam, line_dedup, near_dedup, packing, toxicity
from tesserae.llm.common import free, held, materialize, small, table

NEAR_PERCENT = 80
#: Bytes of text that a packing task encodes together, words that it remembers, and documents that are sent to it at once: little,
#: as workers and executors have grown in the stages before.
ENCODED_AT_ONCE, KNOWN_WORDS, SENT_AT_ONCE = 1 << 20, 100_000, 500
#: Share of a host's pages over which a line goes; op4's SQL has 5 %, which leaves most repeated lines.
LINE_RATIO = 0.01
#: Pages of a host that have a line at least before it goes: fewer may be copies of one document.
LINE_PAGES = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the rejection threshold. Learns from labelled rows outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < toxicity.REJECT)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs, ratio=LINE_RATIO, min_pages=LINE_PAGES)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_ts_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id is null or count > 1").limit(1).count() == 0:
        found = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT)
        gone = small(materialize(found.where("not kept").select(F.col("doc_id").alias("_ts_id"))))
        return docs.join(gone, F.col("doc_id") == F.col("_ts_id"), "left_anti")
    # ids that do not tell rows apart: rows are numbered, and the numbers fixed by a scratch table
    rows = materialize(docs.withColumn("_ts_row", F.monotonically_increasing_id()))
    found = near_dedup.near_duplicates(rows.select("_ts_row", "text"), "_ts_row", percent=NEAR_PERCENT).select("_ts_row", "component_id")
    placed = materialize(found.join(rows.select("_ts_row", "doc_id"), "_ts_row"))
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_ts_row")).alias("first"))
    return rows.join(first.select(F.col("first._ts_row").alias("_ts_row")), "_ts_row", "left_semi").drop("_ts_row")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, by sequence and place."""
    return packing.digest(packing.pack_documents(docs, at_once=ENCODED_AT_ONCE, known=KNOWN_WORDS, rows=SENT_AT_ONCE))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_site_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]
#: Compression lengths, MinHash components and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() and each
#: stage against plain Python on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = held()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            mine = set(held()) - set(before)
            docs = materialize(docs)
            free(list(mine | set(before[-1:] if k else [])))
    return docs
