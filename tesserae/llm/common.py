"""Helpers that the corpus operators share: scratch tables, size-checked broadcasts, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most 16 bytes that a broadcast may hold; beyond it the plan shuffles.
BROADCAST_ROWS = 500_000
#: Scratch tables after which the driver gives back memory.
TRIMMED_EACH = 4

_scratch: list[tuple[SparkSession, str]] = []
_written = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.startswith("local"):
            named = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        else:
            raise ValueError("spark.checkpoint.dir is not set")
        spark.sparkContext.setCheckpointDir(named)
    return named


def keep_until_end(spark: SparkSession, path: str) -> str:
    """path, which goes when the driver ends if no one frees it before."""
    if not _scratch:
        atexit.register(clean)
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost
    executor costs a re-read only. The tables go when the driver ends, or with free(). After some tables the
    driver gives back what it holds unused, which else adds up over hundreds of jobs."""
    global _written
    spark = df.sparkSession
    path = keep_until_end(spark, f"{scratch_dir(spark)}/tesserae-{uuid.uuid4().hex}")
    if partitions:
        df = df.coalesce(partitions)
    # small row groups: a writer holds one in memory
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    _written += 1
    if _written % TRIMMED_EACH == 0:
        driver_gives_back(spark)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs run within send at most `rows` rows at once to Python; None leaves the session's number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if rows:
            spark.conf.set(name, before)


def held() -> list[str]:
    """The scratch tables of this driver."""
    return [path for _, path in _scratch]


def free(paths: list[str]) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for spark, path in [x for x in _scratch if x[1] in set(paths)]:
        _scratch.remove((spark, path))
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    """Deletes all scratch tables of this driver."""
    try:
        free(held())
    except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is the cluster's scratch
        _scratch.clear()


def give_back() -> None:
    """At the end of a task: what its Python worker holds unused goes back to the system, as the worker lives on with the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def driver_gives_back(spark: SparkSession) -> bool:
    """What the driver's Python and the C library under its JVM hold unused goes back to the system: compiled code of many jobs
    leaves some hundred MB there. Whether the JVM could; one of another maker or system may not know how."""
    give_back()
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    try:
        args = sc._gateway.new_array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface, as the class of the server is not open to reflection
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows at most `limit` rows, else unmarked (a shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, component): the smallest node reachable, for every node in an edge.

    Minimum labels over neighbours plus two pointer jumps, a scratch table a round, until nothing changes.
    Both sides of each join are scans, so adaptive execution can split a hub's rows; minima combine
    before they are shuffled. No link or label reaches the driver, only whether one changed.
    """
    e = edges.where("u is not null and v is not null and u <> v").selectExpr("least(u, v) u", "greatest(u, v) v").distinct()
    e = materialize(e.selectExpr("stack(2, u, v, v, u) as (src, dst)"))
    labels = materialize(e.groupBy("src").agg(F.min("dst").alias("m")).selectExpr("src node", "least(src, m) component", "true changed"))
    while True:
        old = labels
        near = e.join(old.selectExpr("node dst", "component c"), "dst").groupBy("src").agg(F.min("c").alias("m"))
        new = old.select("node", "component").join(near.withColumnRenamed("src", "node"), "node", "left").selectExpr("node", "component was", "least(component, m) c")
        up = old.selectExpr("node c", "component above")
        new = new.join(up, "c", "left").selectExpr("node", "was", "coalesce(least(c, above), c) c")
        new = new.join(up, "c", "left").selectExpr("node", "coalesce(least(c, above), c) component", "coalesce(least(c, above), c) <> was changed")
        labels = materialize(new)
        if labels.where("changed").limit(1).count() == 0:
            return labels.select("node", "component")
