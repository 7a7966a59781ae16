"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts: one on windows of ordinary text, one on the passages of toxic
texts that ordinary texts lack (the words whose beginnings have a document frequency well over the ordinary one: a z
value over a limit), as they stand there. A window is compressed twice, with the ordinary dictionary alone and with the
toxic one laid before it. Ordinary windows come out alike; the bytes that a window saves by the toxic dictionary are its
distance. A logistic curve, fitted on labelled texts that the dictionaries have not seen and weighted to the labels' true
shares, turns a document's distances (largest, mean of the largest three, mean, windows over two limits, windows) into a
probability; the z limit is the one with the least loss there.

The toxic dictionary is laid before the ordinary one because two wholly separate ones tell little: an ordinary window's
lengths under them differ by six bytes either way, more than a toxic word saves (README has the figures).

Learning takes no more than `SAMPLE` labelled documents a class, the first by a hash of their id, each read whole, on
executors: what comes to the driver are at most `TOLD` beginnings of words, `ORDINARY_WINDOWS` and `TOXIC_PASSAGES` short
samples, and a row of features for each sampled document. Scoring reads every text to its end, in batches, and its model
is a few KB.

Nulls and edges: null and empty texts have distances of zero and get the curve's value there; documents labelled
both ways are not learned from; of rows that share an id the least text is learned from; without labels of both classes
every score is 0; an empty table gives no row. Repeated rows are scored each. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import driver_gives_back, give_back, materialize, table

#: Labelled documents a class; beginnings of words, ordinary windows and toxic passages that the driver may see.
SAMPLE, TOLD, ORDINARY_WINDOWS, TOXIC_PASSAGES = 3000, 5000, 60_000, 20_000
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 96, 16_384, 2048
#: Bytes of a toxic passage: longer ones are taken in parts.
PASSAGE = 1024
SHORT, LONG = 4, 9
LIMITS = (5.0, 8.0, 12.0)
REJECT = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def windows(text: str | None) -> list[bytes]:
    """Runs of whole words of at least WINDOW bytes, but for the last; every word is in one."""
    out, cur, n = [], [], 0
    for w in words(text):
        b = w.encode("utf-8", "surrogatepass")
        cur.append(b)
        n += len(b) + 1
        if n >= WINDOW:
            out.append(b" " + b" ".join(cur) + b" ")
            cur, n = [], 0
    if cur:
        out.append(b" " + b" ".join(cur) + b" ")
    return out


def pieces(text: str | None) -> set[str]:
    """Beginnings of words, and whole words with the space after them."""
    out = set()
    for w in set(words(text)):
        if len(w) >= SHORT:
            out.update(w[:k] for k in range(SHORT, min(LONG, len(w)) + 1))
            out.add(w + " ")
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's content; the samples themselves where they are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters.from_level(
        3, dict_size=len(content), source_size=WINDOW, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS, min_match=4, strategy=zstd.STRATEGY_LAZY2
    )
    known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=known, compression_params=params)


class Distance:
    """The distances of a text under two dictionaries, as a row of features."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = compressor(ordinary), compressor(toxic + ordinary)

    def features(self, text: str | None) -> list[float]:
        plain, both = self.plain.compress, self.both.compress
        g = sorted((len(plain(w)) - len(both(w)) for w in windows(text)), reverse=True)
        if not g:
            return [0.0] * 6
        n = len(g)
        return [g[0], sum(g[:3]) / min(3, n), sum(g) / n, np.log1p(sum(x >= 2 for x in g)), np.log1p(sum(x >= 4 for x in g)), np.log1p(n)]


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: tuple = ()
    scale: tuple = ()
    weights: tuple = ()
    known: Distance | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": None}  # compressors stay where they are made

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(texts))
        if self.known is None:
            self.known = Distance(self.ordinary, self.toxic)
        d = self.known
        x = (np.array([d.features(t) for t in texts]).reshape(-1, 6) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve(a.T @ (a * (share * p * (1 - p))[:, None]) + 0.3 * np.eye(len(w)), a.T @ (share * (p - y)) + 0.3 * w)
    return w


def passages(text: str | None, told: set[str]) -> list[bytes]:
    """The words of a text that begin as told, as they stand, in parts of at least PASSAGE bytes but for the last."""
    out, cur, n = [], [], 0
    for w in words(text):
        if w + " " in told or any(w[:k] in told for k in range(SHORT, min(LONG, len(w)) + 1)):
            cur.append(b" " + w.encode("utf-8", "surrogatepass"))
            n += len(cur[-1])
            if n >= PASSAGE:
                out.append(b"".join(cur) + b" ")
                cur, n = [], 0
    if cur:
        out.append(b"".join(cur) + b" ")
    return [x for x in out if len(x) >= 8]


def _told(learn: DataFrame) -> dict[str, float]:
    """z values of the beginnings of words that toxic documents have more often, the largest TOLD of them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for y, t in zip(pdf["_ts_y"], pdf["_ts_t"], strict=True):
                if found := list(pieces(t)):
                    yield pd.DataFrame({"w": found, "a": int(y), "b": 1 - int(y)})

    size = {r["_ts_y"]: r["count"] for r in learn.groupBy("_ts_y").count().collect()}
    n, m = size.get(1, 0), size.get(0, 0)
    if not n or not m:
        return {}
    c = learn.select("_ts_y", "_ts_t").mapInPandas(run, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p = (F.col("a") + F.col("b")) / (n + m)
    z = (F.col("a") / n - F.col("b") / m) / F.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
    top = c.where((F.col("a") >= min(3, n)) & (F.col("a") / n > 2 * F.col("b") / m)).select("w", z.alias("z")).where(F.col("z") > min(LIMITS))
    return {r.w: r.z for r in top.orderBy(F.desc("z"), "w").limit(TOLD).collect()}


def _curve(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, tuple]:
    """The loss of the fitted curve, and its mean, scale and weights."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w = _logistic((x - mean) / scale, y, share)
    p = np.clip(1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - mean) / scale] @ w, -30, 30))), 1e-6, 1 - 1e-6)
    return float(-(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()), (tuple(mean), tuple(scale), tuple(w))


def fit(sample: DataFrame, rows: dict[int, int]) -> Model:
    """sample: _ts_y, _ts_id, _ts_t of the learned documents; rows: how many labelled ones there are of each class."""
    dealt = sample.withColumn("_ts_half", F.pmod(F.xxhash64("_ts_id", F.lit(7)), F.lit(2)))
    learn, rest = dealt.where("_ts_half = 0"), dealt.where("_ts_half = 1").select("_ts_y", "_ts_t")
    told = _told(learn)
    if not told:
        return Model()
    levels = [{w for w, v in told.items() if v > limit} for limit in LIMITS]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for y, t in zip(pdf["_ts_y"], pdf["_ts_t"], strict=True):
                for k, level in enumerate(levels) if y else [(-1, None)]:
                    if found := passages(t, level) if y else windows(t):
                        yield pd.DataFrame({"k": k, "x": found})

    samples = materialize(learn.select("_ts_y", "_ts_t").mapInPandas(cut, "k int, x binary"))
    some = lambda k, n: [bytes(r.x) for r in samples.where(F.col("k") == k).orderBy(F.xxhash64("x"), "x").limit(n).collect()]
    plain = some(-1, ORDINARY_WINDOWS)
    bad = {k: x for k in range(len(LIMITS)) if (x := some(k, TOXIC_PASSAGES))}
    if not plain or not bad:
        return Model()
    ordinary = trained(plain, ORDINARY_BYTES)
    toxic = {k: trained(x, TOXIC_BYTES) for k, x in bad.items()}

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [Distance(ordinary, x) for x in toxic.values()]
        for pdf in parts:
            yield pd.DataFrame({"y": pdf["_ts_y"], "x": [[v for d in known for v in d.features(t)] for t in pdf["_ts_t"]]})

    got = rest.mapInPandas(measure, "y int, x array<double>").toPandas()
    y = got["y"].to_numpy(float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model()
    share = np.where(y == 1, rows[1] / y.sum(), rows[0] / (1 - y).sum())
    share *= len(share) / share.sum()
    x = np.stack(got["x"].to_list()).reshape(len(y), len(toxic), 6)
    tried = [(_curve(x[:, i], y, share), k) for i, k in enumerate(toxic)]
    (_, parts), k = min(tried, key=lambda v: (v[0][0], v[1]))
    return Model(ordinary, toxic[k], *parts)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learns from labelled documents outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_ts_id")).agg(F.min("toxic").alias("_ts_y"), F.max("toxic").alias("_ts_z"))
    known = known.where("_ts_y = _ts_z").select("_ts_id", "_ts_y")
    rows = {r["_ts_y"]: r["count"] for r in known.groupBy("_ts_y").count().collect()}
    if not rows.get(0) or not rows.get(1):
        return Model()
    order = F.xxhash64("_ts_id")
    some = known.where("_ts_y = 1").orderBy(order, "_ts_id").limit(sample).unionByName(known.where("_ts_y = 0").orderBy(order, "_ts_id").limit(sample))
    # at most 2 * sample ids
    met = docs.select(F.col(id_col).alias("_ts_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_ts_t")).join(F.broadcast(some), "_ts_id")
    model = fit(materialize(met.groupBy("_ts_id", "_ts_y").agg(F.min("_ts_t").alias("_ts_t"))), rows)
    driver_gives_back(docs.sparkSession)
    return model


def score(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.scores(list(texts)))
        give_back()

    return run(text)


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    model = train(docs, labels)
    out = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


QUERIES = {"op1_compression_toxicity": op1_compression_toxicity}
ORACLES: dict[str, str] = {}
