"""Fill-in-middle transformation by big-integer bit-parallelism.

A text is cut into lines, and its prefix, middle and suffix begin at lines drawn from a hash of its id. Everything is
done on the UTF-8 bytes of a text as bits of one integer, whatever its length: bytes.translate gives the mask of a class
of bytes, a shift of the mask of line feeds marks where lines begin, bit_count() tells how many there are, and the place
of the k-th of them is found by halving the integer again and again. Code points are the bits of the mask of bytes that
begin one. Work and memory are in proportion to a text's length; nothing is shuffled.

Nulls and edges: a null text counts as empty; empty texts and those that hold one of the sentinels stay plain; a null id
is hashed as no digits; repeated rows of one id are cut alike; all columns of the documents are kept, and those named as
an output are replaced; an empty table gives no row. restore() gives the exact text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import table
from tesserae.llm.near_dedup import chunks

#: Beginnings of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
OUTPUTS = {"_ts_n": "long", "_ts_form": "string", "_ts_prefix_chars": "long", "_ts_middle_chars": "long", "_ts_output": "string"}


def members(some: Iterable[int]) -> bytes:
    """A table for bytes.translate: 1 for the bytes of a class, 0 for the others."""
    some = set(some)
    return bytes(b"01"[b in some] for b in range(256))


LINE_FEEDS, BEGINNINGS = members(b"\n"), members(b for b in range(256) if b & 0xC0 != 0x80)


def mask(raw: bytes, kind: bytes) -> int:
    """Bit i tells whether byte i is in the class."""
    return int(raw[::-1].translate(kind), 2) if raw else 0


def line_starts(raw: bytes) -> int:
    """Bit i tells whether a line begins at byte i: the first byte, and each after a line feed."""
    return (mask(raw, LINE_FEEDS) << 1 | 1) & ((1 << len(raw)) - 1)


def select(bits: int, rank: int, size: int) -> int:
    """The place of the set bit that has `rank` set bits below it; `size` bits, with more than `rank` set."""
    at = 0
    while size > 1:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        if rank < (n := low.bit_count()):
            bits, size = low, half
        else:
            bits, size, rank, at = bits >> half, size - half, rank - n, at + half
    return at


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(key: str, raw: bytes, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and output of one text."""
    starts = line_starts(raw)
    n = starts.bit_count()
    a, b, c, d = draws(key, seed)
    marks = [s.encode() for s in SENTINELS]
    if not raw or c % 100 >= fim_percent or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    first, last = (len(raw) if k == n else select(starts, k, len(raw)) for k in sorted((a % (n + 1), b % (n + 1))))
    chars = mask(raw, BEGINNINGS)
    upto = [(chars & ((1 << k) - 1)).bit_count() for k in (first, last)]
    prefix, suffix, middle = (m + x for m, x in zip(marks, (raw[:first], raw[last:], raw[first:last]), strict=True))
    form, parts = ("spm", (suffix, prefix, middle)) if d % 100 < spm_percent else ("psm", (prefix, suffix, middle))
    return n, form, upto[0], upto[1] - upto[0], b"".join(parts)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs with the number of lines (_ts_n), the form (plain, psm or spm), the code points of prefix and middle (null if
    plain) and the output."""
    rest = [c for c in docs.columns if c not in OUTPUTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in chunks(batches, 1, strings=False):
            rows = [transform(k or "", raw or b"", seed, fim_percent, spm_percent) for k, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)]
            out = [pa.array(x, pa.int64() if OUTPUTS[name] == "long" else pa.string()) for name, x in zip(OUTPUTS, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], *out], [*rest, *OUTPUTS])

    source = docs.select(F.col(id_col).cast("string").alias("_ts_key"), F.col(text_col).alias("_ts_raw"), *rest)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:]] + [f"{k} {v}" for k, v in OUTPUTS.items()]
    return source.mapInArrow(run, ", ".join(fields))


def restore(output: Column, form: Column) -> Column:
    """The text that fill_in_middle made an output of."""
    p = F.split(output, "|".join(map(re.escape, SENTINELS)), -1)
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("_ts_n").alias("n"), F.col("_ts_form").alias("form"), F.col("_ts_prefix_chars").alias("prefix_chars"), F.col("_ts_middle_chars").alias("middle_chars"),
        digest(F.col("_ts_output")).alias("output_sha256"), digest(restore(F.col("_ts_output"), F.col("_ts_form"))).alias("restored_sha256"),
    )


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, (len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END)::BIGINT AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, 8 * i::INTEGER + 1, 8))::BIGINT) AS g FROM d),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
e AS (SELECT *, CASE WHEN a = n THEN length(text) ELSE coalesce(list_sum(list_transform(l[1:a], lambda x: length(x) + 1)), 0) END::BIGINT AS p,
  CASE WHEN b = n THEN length(text) ELSE coalesce(list_sum(list_transform(l[1:b], lambda x: length(x) + 1)), 0) END::BIGINT AS q FROM c),
f AS (SELECT *, substr(text, 1, p) AS x, substr(text, p + 1, q - p) AS y, substr(text, q + 1) AS z FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f"""
}
