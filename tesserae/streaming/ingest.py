"""Incremental ingest: what is new since the last run, each batch once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str) -> StreamingQuery:
    """Appends the new Parquet files under source to sink, one row a key and batch. A batch that is sent again
    overwrites its own folder."""

    def write(batch, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
