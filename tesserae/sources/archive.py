"""Works, records and entries as files: scans in a fixed order, sinks, reports, provenance, and what guards a re-import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tesserae.functions.entries import decode_bytes, metadata_fields
from tesserae.operators.corpus import haystack, in_order

#: The shape of a raw work: its pages, each with its volume, printed page and text.
WORK = "pages array<struct<vol:string,page:int,text:string>>"


def missing(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def work_pages(spark: SparkSession, path: str, work: str) -> DataFrame:
    """(work, page, vol, printed, text) of a raw work's JSON. A missing file is an error that names it."""
    if missing(spark, path):
        raise FileNotFoundError(f"no raw work at {path}")
    b = spark.read.schema(WORK).option("multiLine", True).json(path)
    return b.select(F.lit(work).alias("work"), F.posexplode("pages").alias("page", "p")).select("work", "page", "p.vol", F.col("p.page").alias("printed"), "p.text")


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A derived table; a missing one is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_all(spark: SparkSession, paths: dict[str, str], schema: str, key: str) -> DataFrame:
    """Several tables as one, each row with its table's name under `key`, in the order in which they are named."""
    return in_order(*[scan(spark, p, schema).withColumn(key, F.lit(k)) for k, p in paths.items()])


def registry_entries(spark: SparkSession, path: str, names: dict[int, str], fields: dict[int, str]) -> DataFrame:
    """(i, name, metadata, biography) of a registry's rows, whose names, fields and biographies are bytes by tables of their own:
    l the name, d the metadata lines, b the biography. Read as Parquet; a database is read by Spark's jdbc source into it."""
    r = spark.read.parquet(path)
    return r.select("i", decode_bytes(F.col("l"), names).alias("name"), metadata_fields(decode_bytes(F.col("d"), fields)).alias("metadata"), decode_bytes(F.col("b"), names).alias("biography"))


def is_decoded(text: Column) -> Column:
    """Whether every byte of a decoded text was known, and the confidence that goes with it."""
    whole = ~text.rlike(r"\[[0-9a-f]{2}\]")
    return F.struct(whole.alias("whole"), F.when(whole, 0.995).otherwise(0.95).alias("confidence"))


def write_derived(df: DataFrame, path: str, by: str | None = None) -> None:
    """One table a work, replaced as a whole; with `by`, a folder for each of its values."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)


def write_relations(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of the relational form, rebuilt beside the old ones: each is replaced as a whole."""
    for name, df in tables.items():
        write_derived(df, f"{path}/{name}")


def source_works(registry: DataFrame) -> DataFrame:
    """The registry's sources as works."""
    return registry.select(F.concat(F.lit("source:"), "key").alias("id"), "key", "kind", "rights", F.to_json("fields").alias("fields"))


def import_batches(counts: DataFrame, raw: DataFrame) -> DataFrame:
    """A row of provenance for each source: the hash of what was read, its counts, and the report as JSON. counts: source,
    accepted, rejected; raw: source, sha256."""
    report = F.to_json(F.struct("accepted", "rejected"))
    return counts.join(raw, "source").select(F.concat_ws(":", F.lit("batch"), "source", F.substring("sha256", 1, 12)).alias("id"), "source", "sha256", (F.col("accepted") + F.col("rejected")).alias("rows"), report.alias("report"))


def to_reload(known: DataFrame, found: DataFrame) -> DataFrame:
    """(id, state) of the batches found: reused where the same batch is known with as many rows, else reload; the rows of a known
    batch of another size have to go first."""
    met = found.join(known.select("id", F.col("rows").alias("_was")), "id", "left")
    return met.select("id", F.when(F.col("_was").isNull(), "load").when(F.col("_was") == F.col("rows"), "reuse").otherwise("reload").alias("state"))


def search_docs(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, haystack): what a search looks through, once for each row."""
    return df.select(key, haystack(*[F.col(p) for p in parts]).alias("haystack"))


def data_version(tables: DataFrame) -> DataFrame:
    """One row: the version of a set of tables (name, sha256), a hash over both in order."""
    rows = F.sort_array(F.collect_list(F.concat_ws(":", "name", "sha256")))
    return tables.agg(F.substring(F.sha2(F.array_join(rows, "\n"), 256), 1, 16).alias("data_version"), F.count("*").alias("tables"))


def completeness(records: DataFrame, source: str, number: str, kind: str, structural: str) -> DataFrame:
    """A report's row for each source: distinct numbers but for structural headings, rows, and those accounted for in percent."""
    return records.groupBy(source).agg(
        F.countDistinct(F.when(F.col(kind) != structural, F.col(number))).alias("numbers"), F.count("*").alias("rows"), F.count_if(F.col(kind) == "unparsed").alias("unparsed"),
        F.round(100.0 * F.count_if(F.col(kind) != "unparsed") / F.count("*"), 1).alias("accounted"),
    )


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Reports as JSON lines, one file each; they are aggregates of a few rows."""
    for name, df in reports.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def normalization_fixture(forms: DataFrame, raw: str, normalized: str, n: int = 260) -> DataFrame:
    """At most n distinct pairs of 3 to 120 letters, the first in the order of their hashes."""
    pairs = forms.where(F.length(raw).between(3, 120)).select(raw, normalized).distinct()
    return pairs.orderBy(F.xxhash64(raw, normalized), raw).limit(n)


def curated_errors(rows: DataFrame, required: list[str]) -> DataFrame:
    """(externalId, code) of hand-curated chains that break a rule: a missing field, a repeated id, a link without a name, a chain
    that its parts do not give back."""
    links = F.transform(F.split("rawIsnad", "←"), lambda x: F.trim(x))
    again = F.array_join(F.split("rawIsnad", "←"), "←")
    bad = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"missing-{c}") for c in required], F.when(F.exists(links, lambda x: x == ""), "empty-link"), F.when(again != F.col("rawIsnad"), "round-trip")))
    one = rows.select("externalId", F.explode(bad).alias("code"))
    twice = rows.groupBy("externalId").count().where("count > 1").select("externalId", F.lit("duplicate-id").alias("code"))
    return one.unionByName(twice)


def curated_mentions(rows: DataFrame) -> DataFrame:
    """(externalId, position, mention) of hand-curated chains, parted at their arrows."""
    return rows.select("externalId", F.posexplode(F.transform(F.split("rawIsnad", "←"), lambda x: F.trim(x))).alias("position", "mention")).where("mention <> ''")


def release_files(release_id: str, tables: DataFrame, version: str) -> DataFrame:
    """(file, content): the manifest of a release, and the statements that register and activate it."""
    manifest = F.to_json(F.struct(F.lit(release_id).alias("release_id"), F.lit(version).alias("data_version"), F.sort_array(F.collect_list("name")).alias("tables")))
    text = lambda name, c: F.struct(F.lit(name).alias("file"), c.alias("content"))
    files = F.array(
        text("manifest.json", F.col("m")), text("register.sql", F.lit(f"INSERT INTO release (release_id, data_version, is_active) VALUES ('{release_id}', '{version}', 0);")),
        text("activate.sql", F.lit(f"UPDATE release SET is_active = (release_id = '{release_id}');")), text("latest.env", F.lit(f"RELEASE_ID={release_id}")),
    )
    return tables.agg(manifest.alias("m")).select(F.explode(files).alias("f")).select("f.*")


def as_responses(df: DataFrame, key: str) -> DataFrame:
    """(key, body): each row as the JSON that an answer carries."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("body"))


def frame_matches(spark: SparkSession, frame: DataFrame, path: str) -> bool:
    """Whether a stored frame is the one at hand, row by row."""
    if missing(spark, path):
        return False
    old = spark.read.schema(frame.schema).parquet(path)
    return old.exceptAll(frame).limit(1).count() == 0 and frame.exceptAll(old).limit(1).count() == 0
