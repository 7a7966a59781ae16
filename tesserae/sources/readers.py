"""Sources and sinks: raw works, record and entry scans, idempotent imports, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "pages array<struct<text:string,vol:string,page:int>>"


def raw_work(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a raw work in their order: page_order, text, vol, page."""
    return spark.read.schema(PAGES).json(path, multiLine=True).select(F.posexplode("pages").alias("page_order", "p")).select("page_order", "p.*")


def scan_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows if there is none at path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def occurrences(records: DataFrame) -> DataFrame:
    """One row for each narrator mention of records (id, collection, chains)."""
    c = records.select(F.col("id").alias("record_id"), "collection", F.explode("chains").alias("c"))
    return c.select("record_id", "collection", F.col("c.chainId").alias("chain_id"), F.explode("c.narratorOccurrences").alias("o")).select("record_id", "collection", "chain_id", "o.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those that share their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
