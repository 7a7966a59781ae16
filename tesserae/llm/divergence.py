"""Source divergence audit: which sources of a language use its terms otherwise than others, and by which terms.

Terms are runs of ASCII letters, lower-cased, and of anything beyond ASCII. Counting runs in two passes:

1. Every task keeps a count-min sketch of document frequencies of (language, term), saturating at the threshold, and
   sends the cells that it touched; sums of cells merge the sketches. A cell never tells less than a term's frequency, so
   a term with a cell under the threshold cannot reach it. What is left of the merged sketch is one bit a cell:
   `depth * width` bits, 2 MB with the defaults whatever the corpus, which tasks get as a broadcast.
2. Tasks count the terms whose cells are all at the threshold; only those are shuffled, and their document frequencies
   are exact sums. The sketch only saves shuffling: with any width the result is the same. Larger vocabularies than
   about `width` terms want a larger one.

Sums combine in the tasks, so a source with a third of all rows is no hot spot. Pairs of sources meet by terms that both
have; terms that one of them has are counted by their probability, and terms of neither are one product:
no pair meets over the whole vocabulary. All arithmetic is on whole numbers; sums stay under 4 * (10^9 + V)^2,
which a long holds for up to 5 * 10^8 kept terms of a language (Spark's ANSI mode raises beyond it).

Nulls and edges: null text, language or source counts as empty; groups without terms are compared by smoothing alone; a
language without kept terms has pairs of value 0; repeated rows are documents each; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import give_back, materialize, small, table
from tesserae.llm.near_dedup import chunks

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
DEPTH, WIDTH = 2, 1 << 23
#: Bytes of text that a task counts at a time.
AT_ONCE = 6 << 20
#: Bits of one bitmap of Spark's bitmap functions.
_BITMAP = 32_768
#: What separates terms becomes a space, A-Z are lower-cased, other letters and bytes beyond ASCII stay.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def folded(texts: pa.Array, table_: bytes) -> pa.Array:
    """texts with each byte replaced by the table; lengths stay, null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().translate(table_) if data else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(raw))


class Counted:
    """The terms of some documents: each distinct (document, term) with its occurrences."""

    def __init__(self, part: pa.RecordBatch):
        split = pc.ascii_split_whitespace(folded(part.column("text"), _FOLD))
        words = split.flatten().dictionary_encode()
        self.terms, codes = words.dictionary, words.indices.to_numpy()
        doc = np.repeat(np.arange(len(split)), np.diff(np.asarray(split.offsets)))
        key = doc * max(len(self.terms), 1) + codes
        if (none := pc.index(self.terms, "").as_py()) >= 0:
            key = key[codes != none]
        key, self.n = np.unique(key, return_counts=True)
        self.doc, self.code = np.divmod(key, max(len(self.terms), 1))

    def by(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups of documents, terms' codes, documents that have the term, and its occurrences there."""
        key, place, docs = np.unique(groups[self.doc] * max(len(self.terms), 1) + self.code, return_inverse=True, return_counts=True)
        n = np.bincount(place, weights=self.n, minlength=len(key)).astype(np.int64)
        group, code = np.divmod(key, max(len(self.terms), 1))
        return group, code, docs, n


def cells(langs: np.ndarray, terms: np.ndarray, depth: int, width: int) -> np.ndarray:
    """depth rows: the cells of each (hash of language, hash of term)."""
    x = terms ^ (langs * _ODD[-1])
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return np.stack([((x ^ (x >> np.uint64(32))) * _ODD[d + 1] >> np.uint64(40)) % np.uint64(width) + np.uint64(d * width) for d in range(depth)]).astype(np.int64)


def _hashes(x: pa.Array) -> np.ndarray:
    return pd.util.hash_array(x.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(x) else np.zeros(0, np.uint64)


def _coded(part: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[pa.Array]]:
    """A number for each row's values of these columns, and the distinct values by number."""
    frame = pd.DataFrame({c: part.column(c).to_pandas() for c in names})
    number = frame.groupby(list(names), sort=False).ngroup().to_numpy(np.int64)
    first = frame.drop_duplicates(list(names))
    return number, [pa.array(first[c], pa.string()) for c in names]


def possible_terms(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, width: int = WIDTH) -> np.ndarray:
    """One bit a cell of the merged sketch of docs (lang, source, text): whether it reaches min_docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(depth * width, np.uint8)
        for part, _ in chunks(batches, part_text, AT_ONCE, strings=False):
            counted, (number, (langs,)) = Counted(part), _coded(part, "lang")
            group, code, n, _ = counted.by(number)
            for at in cells(_hashes(langs)[group], _hashes(counted.terms)[code], depth, width):
                place, more = np.unique(at, return_inverse=True)
                n_at = np.bincount(more, weights=n, minlength=len(place))
                sketch[place] = np.minimum(sketch[place] + n_at, min(min_docs, 255))
        at = np.flatnonzero(sketch)
        for k in range(0, len(at), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 18)].astype(np.int32)), pa.array(sketch[at[k : k + (1 << 18)]].astype(np.int32))], ["cell", "n"])
        give_back()

    part_text = docs.columns.index("text")
    merged = docs.mapInArrow(run, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= min(min_docs, 255))
    maps = merged.groupBy(F.bitmap_bucket_number("cell").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    bits = np.zeros(-(-depth * width // _BITMAP) + 2, f"S{_BITMAP // 8}").view(np.uint8).reshape(-1, _BITMAP // 8)
    for r in maps.collect():  # at most depth * width bits
        bits[r.k] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits.reshape(-1)


def _reach(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether the bit of a cell is set; Spark's bitmap 1 begins at 1, and its bit 0 is number 1, 0 falls in bitmap 0."""
    k = np.where(cell > 0, 1 + (cell - 1) // _BITMAP, 0)
    p = np.where(cell > 0, (cell - 1) % _BITMAP, 0)
    return bits[k * (_BITMAP // 8) + p // 8] >> (p % 8).astype(np.uint8) & 1


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """lang, source, term, c, lang_c (occurrences in the group and in the language) and first (of the term's groups),
    for the terms in at least min_docs documents of the language."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    known = docs.sparkSession.sparkContext.broadcast(possible_terms(docs, min_docs, depth, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in chunks(batches, part_text, AT_ONCE, strings=False):
            counted, (number, (langs, sources)) = Counted(part), _coded(part, "lang", "source")
            group, code, n_docs, n = counted.by(number)
            at = cells(_hashes(langs)[group], _hashes(counted.terms)[code], depth, width)
            keep = np.logical_and.reduce([_reach(known.value, row) for row in at]) if len(group) else np.zeros(0, bool)
            group, code = pa.array(group[keep]), pa.array(code[keep])
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), counted.terms.take(code), pa.array(n_docs[keep]), pa.array(n[keep])], ["lang", "source", "term", "d", "c"])

    part_text = docs.columns.index("text")
    found = docs.mapInArrow(run, "lang string, source string, term string, d long, c long").groupBy("lang", "source", "term").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    w = Window.partitionBy("lang", "term")
    found = found.select("lang", "source", "term", "c", F.sum("d").over(w).alias("d"), F.sum("c").over(w).alias("lang_c"), (F.min("source").over(w) == F.col("source")).alias("first"))
    return found.where(F.col("d") >= min_docs).drop("d")


def _share(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (c + 1) / (n + v)), exactly."""
    big = lambda x: x.cast("decimal(19,0)")
    return F.when(v > 0, 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * big(c + 1), big(n + v)))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank: each source against each other source of its language (part pair), and the
    terms that it has more of than its language, up to rank `top` (part term)."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = materialize(kept_counts(docs, min_docs, depth, width))
    langs = kept.groupBy("lang").agg(F.sum("c").alias("lang_n"), F.sum(F.col("first").cast("long")).alias("v"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("terms"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "terms", "lang_n", "v"])
    groups = materialize(groups.withColumn("p0", _share(F.lit(0), F.col("n"), F.col("v"))))
    known = small(groups, 100_000)
    rows = kept.join(known, ["lang", "source"]).select("lang", "source", "term", "lang_c", "lang_n", "v", "p0", _share(F.col("c"), F.col("n"), F.col("v")).alias("p"))

    more = rows.withColumn("q", _share(F.col("lang_c"), F.col("lang_n"), F.col("v"))).where("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    sparse = rows.select("lang", "term", "source", "p", "p0")
    other = sparse.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = sparse.join(other, ["lang", "term"]).where("source <> item").groupBy("lang", "source", "item").agg(F.sum(_gap(p, q) - _gap(p, q0) - _gap(p0, q)).alias("met"), F.count("*").alias("n_met"))
    # what each group has, by probability, against the smoothing of every other group
    levels = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    bare = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("item_terms"))
    mine = levels.join(small(bare.drop("item_terms"), 100_000), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _gap(p, q0)).alias("mine"))
    theirs = levels.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "k").join(small(groups.select("lang", "source", "p0"), 100_000), "lang")
    theirs = theirs.where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _gap(p0, q)).alias("theirs"))
    pairs = groups.join(bare, "lang").where("source <> item")
    for part in (both, mine, theirs):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    neither = F.when(F.col("v") > 0, (F.col("v") - F.col("terms") - F.col("item_terms") + z("n_met")) * _gap(p0, q0)).otherwise(0)
    pairs = pairs.select("lang", "source", "item", (z("met") + z("mine") + z("theirs") + neither).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(pairs, "pair").unionByName(out(terms, "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLES = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
k AS (SELECT lang, term, count(*) AS lc FROM d GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM d GROUP BY lang, source, term),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
l AS (SELECT lang, sum(lc)::HUGEINT AS ln, count(*)::HUGEINT AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY lang, source),
x AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) AS p, 1 + (1000000000::HUGEINT * (lc + 1)) // (ln + v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM x WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM t))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""
}
