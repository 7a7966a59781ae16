"""Lexical retrieval packing.

Documents become token ids once (a scratch table). Document frequencies of all tokens over the whole corpus weigh a
BM25 score; there is one number for each id of the vocabulary, so that table is bounded. Documents are dealt into
shards of about `SHARD_TOKENS` by a lexical key (their largest repeated id), so that likely neighbours meet; ties are
dealt by doc_id, so a hot key spans shards. Each shard has an inverted index. The seed of a window retrieves its best
unused neighbours, which fill the window one after the other; the one that does not fit is cut there and its rest is
the next seed. Every window is full but a shard's last, whose tokens are split by powers of two. Nothing is padded.

Nulls and edges: null or empty text is the end id alone; repeated rows are packed as often as they come; a row
without doc_id is packed too; a text of any length is cut over windows. An empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_rows, driver_gives_back, give_back, materialize, table
from tesserae.llm.near_dedup import chunks
from tesserae.llm.tokens import KNOWN_WORDS, Encoder, default_path

WINDOW, END, SHARD_TOKENS, K1, B = 4096, 2, 1 << 20, 1.2, 0.75

#: Bytes of text that a task encodes together.
AT_ONCE = 4 << 20


def _tokenize(path: str, end: int, vocabulary: int, at_once: int, known: int):
    """A row for each document, and one for each partition with its document frequencies."""
    names, counts = ["id", "key", "n", "ids", "df"], pa.map_(pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, df = Encoder.of_worker(path, known=known), np.zeros(vocabulary, np.int64)
        for part, _ in chunks(batches, size=at_once, strings=False):
            ids = enc.encode(part.column(1), end)
            key = []
            for x in ids:
                s = np.sort(np.frombuffer(x, enc.dtype))
                same = s[1:] == s[:-1]
                often = np.flatnonzero(same)
                key.append(int(s[often[-1]]) if len(often) else int(s[-1]))
                df[s[1:][~same]] += 1
                df[s[0]] += 1
            n = len(ids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key, pa.int32()), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(n, counts)], names)
        at = np.flatnonzero(df)
        df = pa.array([list(zip(at.tolist(), df[at].tolist(), strict=True))], counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), df], names)

    return run


class Shard:
    """An inverted BM25 index over one shard, and the greedy filling of windows from it."""

    def __init__(self, docs: list[tuple[int | None, np.ndarray]], idf: np.ndarray, mean: float, window: int):
        self.docs, self.window = docs, window
        terms, owners, weights = [], [], []
        for i, (_, ids) in enumerate(docs):
            t, tf = np.unique(ids, return_counts=True)
            w = idf[t]
            t, tf, w = t[w > 0], tf[w > 0], w[w > 0]
            terms.append(t)
            owners.append(np.full(len(t), i, np.int32))
            weights.append(w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        self.terms = terms
        t = np.concatenate(terms)
        order = np.argsort(t, kind="stable")
        self.owner, self.weight = np.concatenate(owners)[order], np.concatenate(weights)[order]
        self.first = np.searchsorted(t[order], np.arange(len(idf) + 1))
        self.unused = np.ones(len(docs), bool)
        self.next = 0

    def neighbours(self, seed: int, want: int) -> Iterator[int]:
        """Unused documents by falling score against the seed; then the others in their order."""
        t = self.terms[seed]
        lo, n = self.first[t], self.first[t + 1] - self.first[t]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + n, n)
        score = np.bincount(self.owner[at], self.weight[at], len(self.docs)) * self.unused
        k = min(want, len(score) - 1)
        while True:
            best = np.argpartition(-score, k)[: k + 1] if k < len(score) - 1 else np.arange(len(score))
            best = best[np.lexsort((best, -score[best]))]
            for i in best:
                if score[i] > 0 and self.unused[i]:
                    yield int(i)
            if k >= len(score) - 1 or score[best[-1]] <= 0:
                break
            k = min(4 * k + 4, len(score) - 1)
        while self.next < len(self.docs):
            if self.unused[self.next]:
                yield self.next
            self.next += 1

    def pack(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset)"""
        seq, used, pieces = 0, 0, []
        seed, at = -1, 0
        while True:
            if seed < 0:
                seed = next((i for i in range(self.next, len(self.docs)) if self.unused[i]), -1)
                if seed < 0:
                    break
                self.unused[seed], at = False, 0
            near = None
            while seed >= 0:
                n = min(len(self.docs[seed][1]) - at, self.window - used)
                pieces.append((seed, at, n, used))
                used, at = used + n, at + n
                if used == self.window:
                    yield from ((d, s, m, seq, o) for d, s, m, o in pieces)
                    seq, used, pieces, near = seq + 1, 0, [], None
                    if at < len(self.docs[seed][1]):
                        continue  # the rest begins the next window
                    seed = -1
                    break
                if near is None:
                    near = self.neighbours(seed, 16)
                seed, at = next(near, -1), 0
                if seed >= 0:
                    self.unused[seed] = False
        # the last window: sequences of powers of two
        room, o = 1 << (used.bit_length() - 1) if used else 0, 0
        for d, s, m, _ in pieces:
            while m:
                k = min(m, room - o)
                yield d, s, k, seq, o
                s, m, o, used = s + k, m - k, o + k, used - k
                if o == room:
                    seq, o, room = seq + 1, 0, 1 << (used.bit_length() - 1) if used else 0


def _pack(width: int, idf: np.ndarray, mean: float, window: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        Encoder.leave_worker()
        give_back()

        def done(docs: list) -> pa.RecordBatch:
            nonlocal base
            rows = list(Shard(docs, idf, mean, window).pack())
            d, s, n, q, o = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            ids = pa.array([docs[i][1][x : x + m].astype("<u4").tobytes() for i, x, m in zip(d, s, n, strict=True)], pa.binary())
            out = pa.RecordBatch.from_arrays(
                [pa.array([docs[i][0] for i in d], pa.int64()), pa.array(s), pa.array(n), ids, pa.array([len(docs[i][1]) for i in d], pa.int64()), pa.array(q + base), pa.array(o)],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            base += int(q.max()) + 1
            return out

        docs, tokens = [], 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs.append((i, np.frombuffer(x.as_buffer(), f"<u{width}").copy()))
                tokens += len(docs[-1][1])
                if tokens >= shard_tokens:
                    yield done(docs)
                    docs, tokens = [], 0
        if docs:
            yield done(docs)
        give_back()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, at_once: int = AT_ONCE, known: int = KNOWN_WORDS, rows: int | None = None) -> DataFrame:
    """Pieces: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. at_once: bytes of text that
    a task encodes together, known: words that it remembers, rows: documents that are sent to it at once; fewer take less memory and more time."""
    path = tokenizer or default_path()
    encoder = Encoder(path)
    width, vocabulary = encoder.dtype.itemsize, max(encoder.tokenizer.get_vocab_size(True), end + 1)
    del encoder
    driver_gives_back(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, rows):
        made = materialize(docs.mapInArrow(_tokenize(path, end, vocabulary, at_once, known), "id long, key int, n long, ids binary, df map<int, long>"))
    tok = made.where("ids is not null").drop("df")
    total = tok.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    df = np.zeros(vocabulary)
    # at most one row for each id of the vocabulary
    for r in made.where("df is not null").select(F.explode("df").alias("token", "df")).groupBy("token").agg(F.sum("df").alias("df")).collect():
        df[r.token] = r.df
    idf = np.maximum(0, np.log((total.docs - df + 0.5) / (df + 0.5))) * (df > 0)
    shards = max(1, -(-total.tokens // shard_tokens))
    dealt = tok.repartitionByRange(int(shards), "key", "id", F.xxhash64("ids")).sortWithinPartitions("key", "id", F.xxhash64("ids"))
    out = dealt.select("id", "ids").mapInArrow(_pack(width, idf, total.tokens / max(1, total.docs), window, shard_tokens), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents")))


QUERIES = {"op8_retrieval_packing": op8_retrieval_packing}
ORACLES: dict[str, str] = {}
