"""Token counts kept by deltas.

A rollup is a folder in shared storage. A batch turns changes (insert, delete, revise) into signed sums for each
source, language and tokenizer version, written under a name of their own; a marker under the batch's id, created only
if there is none, commits them. So a batch counts once however often it is sent, by however many senders at a time, and
one that was cut off leaves nothing that counts. Totals are the sum of all committed deltas. compact() folds the deltas
that it read into one, whose marker names them: readers leave out what is named there, and a batch that was committed
in between still counts. changes() finds the changes between two kept states of the counted documents.

Nulls and edges: null source, language or text form groups of their own (null text counts 0 tokens); repeated rows
count each time; a null operation or count adds nothing; an empty batch commits and adds nothing. Columns of the
documents named n_words or n_tokens are replaced by the counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import keep_until_end, materialize, scratch_dir, table
from tesserae.llm.near_dedup import chunks
from tesserae.llm.tokens import Encoder, default_path

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """docs without the text, with n_words (white space) and n_tokens (the tokenizer)."""
    path, rest = tokenizer or default_path(), [c for c in docs.columns if c not in (text_col, "n_words", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of_worker(path)
        for part, texts in chunks(batches, 0, 8 << 20):
            n = [len(x) // enc.dtype.itemsize for x in enc.encode(part.column(0))]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([len(t.split()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64())], [*rest, "n_words", "n_tokens"])

    source = docs.select(text_col, *rest)
    return source.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]] + ["n_words long", "n_tokens long"]))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The batch that turns the counts of before into those of after: rows of key, source, lang, tokenizer, n_tokens. A
    document that keeps its groups but not its count is revised, one that changes its groups deleted and inserted."""
    old, new = (d.where(F.col(key).isNotNull()).select(key, F.struct(*KEYS).alias(k), F.col("n_tokens").alias(n)) for d, k, n in ((before, "g", "b"), (after, "h", "a")))
    both = old.join(new, key, "full").where(~(F.col("g").eqNullSafe(F.col("h")) & F.col("a").eqNullSafe(F.col("b"))))
    row = lambda op, g, n, was: F.struct(F.lit(op).alias("op"), *[F.col(f"{g}.{k}").alias(k) for k in KEYS], n.cast("long").alias("n_tokens"), was.cast("long").alias("old_tokens"))
    none = F.lit(None)
    gone, come = row("delete", "g", F.col("b"), none), row("insert", "h", F.col("a"), none)
    out = F.when(F.col("g").isNull(), F.array(come)).when(F.col("h").isNull(), F.array(gone)).when(F.col("g").eqNullSafe(F.col("h")), F.array(row("revise", "h", F.col("a"), F.col("b")))).otherwise(F.array(gone, come))
    return both.select(F.inline(out))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _read(self, path) -> list[str]:
        """The lines of a marker; none if its sender was cut off before it wrote them."""
        stream = self.fs.open(path)
        try:
            return list(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n"))[:-1]
        finally:
            stream.close()

    def _commit(self, name: str, lines: list[str]) -> bool:
        """Whether the marker is this call's."""
        marker = self._path(f"{self.path}/commits/{name}")
        if self.fs.exists(marker):
            if self._read(marker):
                return False
            self.fs.delete(marker, False)
        try:
            stream = self.fs.create(marker, False)
        except Exception:
            if self.fs.exists(marker):
                return False
            raise
        stream.write(bytearray("".join(f"{x}\n" for x in lines), "utf-8"))
        stream.close()
        return True

    def _write(self, deltas: DataFrame) -> str:
        name = uuid.uuid4().hex
        deltas.coalesce(1).write.parquet(f"{self.path}/data/{name}")
        return name

    def committed(self) -> dict[str, str]:
        """batch -> folder of the deltas that count."""
        top = self._path(f"{self.path}/commits")
        if not self.fs.exists(top):
            return {}
        found = {s.getPath().getName(): x for s in self.fs.listStatus(top) if (x := self._read(s.getPath()))}
        folded = {b for x in found.values() for b in x[1:]}
        return {b: x[0] for b, x in found.items() if b not in folded}

    def seen(self, batch: str) -> bool:
        marker = self._path(f"{self.path}/commits/{batch}")
        return self.fs.exists(marker) and bool(self._read(marker))

    def apply(self, batch: str, batch_changes: DataFrame) -> bool:
        """batch_changes: op (insert, delete, revise), source, lang, tokenizer, n_tokens and, for revise, old_tokens.
        False if this batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch) or batch.startswith("compact-"):
            raise ValueError(f"no name of a batch: {batch!r}")
        if self.seen(batch):
            return False
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
        n = F.coalesce("n_tokens", F.lit(0))
        delta = F.when(F.col("op") == "revise", n - F.coalesce("old_tokens", F.lit(0))).otherwise(sign * n)
        name = self._write(batch_changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("d_docs"), F.sum(delta).cast("long").alias("d_tokens")))
        if self._commit(batch, [name]):
            return True
        self.fs.delete(self._path(f"{self.path}/data/{name}"), True)
        return False

    def _totals(self, folders: list[str]) -> DataFrame:
        df = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/data/{x}" for x in folders]) if folders else self.spark.createDataFrame([], SCHEMA)
        out = df.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._totals(list(self.committed().values()))

    def compact(self) -> bool:
        """Folds all deltas that count now into one. False if another call did so meanwhile."""
        parts = self.committed()
        n = 1 + max((int(b.rsplit("-", 1)[1]) for b in parts if b.startswith("compact-")), default=0)
        name = self._write(self._totals(list(parts.values())).selectExpr(*KEYS, "n_docs d_docs", "n_tokens d_tokens"))
        if self._commit(f"compact-{n:08d}", [name, *parts]):
            return True
        self.fs.delete(self._path(f"{self.path}/data/{name}"), True)
        return False


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is inserted with its count of words, all are moved to the tokenizer's version with that count as a
    first estimate, and all are revised to the tokenizer's counts by a batch that is sent twice. The totals are those of
    the tokenizer."""
    docs = table(spark, sf_dir, "documents").select("text", "source", "lang")
    counted = materialize(count_tokens(docs))
    rollup = TokenRollup(spark, keep_until_end(spark, f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}"))

    def batch(op: str, tokenizer: str, n: str, old: str | None = None) -> DataFrame:
        return counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

    rollup.apply("words", batch("insert", "words", "n_words"))
    rollup.apply("moved", batch("delete", "words", "n_words").unionByName(batch("insert", "word_bpe_49k", "n_words")))
    for _ in range(2):
        rollup.apply("counted", batch("revise", "word_bpe_49k", "n_tokens", "n_words"))
    rollup.compact()
    return rollup.totals()


QUERIES = {"op10_token_rollup": op10_token_rollup}
ORACLES: dict[str, str] = {}
