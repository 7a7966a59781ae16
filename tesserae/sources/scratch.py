"""Scratch tables in the shared folder that the cluster names; they go when the driver ends, or before with free()."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short columns that a broadcast may hold; beyond it the plan shuffles.
BROADCAST_ROWS = 200_000

_held: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session gets one of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tesserae-"))
    return named or sc.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A path of its own for scratch files."""
    if not _held:
        atexit.register(clean)
    path = f"{shared_dir(spark)}/tesserae-{uuid.uuid4().hex}"
    _held.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written and read back: lineage ends there, and a lost executor costs a re-read only."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held() -> list[str]:
    return [path for _, path in _held]


def free(paths: list[str]) -> None:
    for spark, path in [x for x in _held if x[1] in set(paths)]:
        _held.remove((spark, path))
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    try:
        free(held())
    except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is the cluster's scratch
        _held.clear()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows at most `limit` rows, else unmarked (a shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
