"""Language-model scoring: a recurrent model of the corpus's own words gives each whole document's probability.

Four steps, each a job over all documents:

1. Training documents are counted: word, occurrences. Sums combine in tasks; the table grows with the corpus.
2. Documents become numbers. The `head` commonest words, chosen by the histogram of counts, go to the tasks with their
   counts (at most 262,144, of 64 bytes each); the first `words` of them are symbols of the model, every other word is one of `TAILS` classes
   by its last two bytes, in which words are told apart by their counts. Words beyond the head are joined with their counts
   by a shuffle; none of them but overlong ones has more than a 262,144th of the tokens, so no key is hot.
3. The model (tesserae.llm.gru) learns in rounds, each on its share of the training documents, all of which are in one.
   A task learns on its documents from the last round's model; the tasks' models are averaged by tokens in two
   levels of groups, and only the average, whose size is fixed, passes through the driver.
4. Tasks score all documents, the state carried from the first token to the last.

score = sum of log10 P(symbol | before), and for words that are no symbol of their own log10((c + 1) / (n + v + 1)) with c,
n, v the word's count, its class's tokens and its class's distinct words; a word that training lacks has c = 0.

Nulls and edges: a null text counts as empty, and an empty one has its end only; a null id is in no held-out fold; repeated
rows are documents each; without training documents all counts are 0 and the model stays as it starts; an empty table gives
no row; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import give_back, materialize, table
from tesserae.llm.divergence import folded
from tesserae.llm.gru import RATE, SIZE, Gru
from tesserae.llm.near_dedup import chunks

HEAD, WORDS, TAILS = 1 << 18, 2048, 64
#: Bytes of a word of the head: HEAD times this bounds what tasks are sent.
SHORT = 64
FOLDS, HELD_OUT = 7, 2
#: Shares of the training documents by round, in sixteenths, and how the rate falls from round to round.
ROUNDS, FALL = (1, 1, 2, 4, 8), 0.7
#: Tokens that are learnt in one go: what is left of a longer document is learnt from an empty state, so that no lane is long
#: alone. Scoring reads every document in one go.
RUN = 1024
#: Bytes of text that a task turns into numbers, and tokens that it learns on or scores, at a time.
AT_ONCE, TOKENS = 16 << 20, 4_000_000
_BLOCK, _SALTS = 16_384, 64
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: The end of a text as a word: no word has white space.
END = "\n"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts and where each text's begin."""
    split = pc.ascii_split_whitespace(folded(texts, _LOWER))
    flat, offsets = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(full)).dictionary_encode(), np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """w, c: the occurrences of each word, and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in chunks(batches, 0, AT_ONCE, strings=False):
            words, _ = _words(part.column(0))
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.dictionary, pa.array([END])]), pa.array(np.append(n, part.num_rows))], ["w", "c"])

    return docs.select(text_col).mapInArrow(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _tail(word: Column) -> Column:
    raw = word.cast("binary")
    return F.pmod(F.crc32(F.when(F.length(raw) < 2, raw).otherwise(F.substring(raw, -2, 2))), F.lit(TAILS)).cast("int")


def _tails(words: pa.Array) -> np.ndarray:
    """The classes of words by their last two bytes."""
    raw, at = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    two = np.array([zlib.crc32(bytes([a, b])) % TAILS for a in range(256) for b in range(256)], np.int64)
    one = np.array([zlib.crc32(bytes([b])) % TAILS for b in range(256)], np.int64)
    last = raw[at[1:] - 1].astype(np.int64)
    return np.where(np.diff(at) > 1, two[raw[np.maximum(at[1:] - 2, 0)].astype(np.int64) * 256 + last], one[last]) if len(words) else np.zeros(0, np.int64)


class Vocabulary:
    """The head's words and counts, and the sizes of the tails' classes. `n`, `v`: tokens and distinct words."""

    def __init__(self, counts: DataFrame, head: int = HEAD, words: int = WORDS):
        octave = F.floor(8 * F.log2("c"))
        short = F.octet_length("w") <= SHORT
        levels = counts.groupBy(octave.alias("k"), _tail(F.col("w")).alias("t"), short.alias("short")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()  # some hundred levels
        by_level: dict[int, int] = {}
        for r in levels:
            by_level[r.k] = by_level.get(r.k, 0) + (r.v if r.short else 0)
        least, have = None, 0
        for k in sorted(by_level, reverse=True):
            if (have := have + by_level[k]) > head:
                break
            least = k
        found = [] if least is None else sorted((-r.c, r.w) for r in counts.where((octave >= least) & short).collect())
        self.n, self.v = sum(r.n for r in levels), sum(r.v for r in levels)
        self.words, self.counts = pa.array([w for _, w in found], pa.string()), np.array([-c for c, _ in found], np.int64)
        self.symbols = min(words, len(found) // SIZE * SIZE)
        own = _tails(self.words)[: self.symbols]
        size = lambda x, less: np.bincount([r.t for r in levels], weights=[getattr(r, x) for r in levels], minlength=TAILS) - np.bincount(own, weights=less, minlength=TAILS)
        self.tail_n, self.tail_v = size("n", self.counts[: self.symbols]), size("v", np.ones(self.symbols))
        place = pc.index_in(pa.array([END]), value_set=self.words)[0].as_py()
        self.end = place if place is not None and place < self.symbols else self.symbols + zlib.crc32(END.encode()) % TAILS

    def of_symbols(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.symbols], self.tail_n])


def encode(docs: DataFrame, known: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row number, the id, the fold, n_tokens; of the head's words n_known and the sums of log10(c + 1), for all (logs)
    and for the tails (tail_logs, with the sizes of their classes); symbols; and the words beyond the head with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = f"_ts_row long, {id_col} {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, logs double, tail_logs double, symbols binary, rare array<struct<w string, n long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, row = sent.value, TaskContext.get().partitionId() << 36
        logs, sizes = np.log10(k.counts + 1.0), np.log10(k.tail_n + k.tail_v + 1)
        for part, _ in chunks(batches, 2, AT_ONCE, strings=False):
            words, starts = _words(part.column(2))
            # each text's end is a word of its own
            distinct, n_docs = pa.concat_arrays([words.dictionary, pa.array([END])]), part.num_rows
            codes = np.insert(words.indices.to_numpy(), starts[1:], len(distinct) - 1).astype(np.int64)
            starts = starts + np.arange(n_docs + 1)
            doc = np.repeat(np.arange(n_docs), np.diff(starts))
            place = pc.fill_null(pc.index_in(distinct, value_set=k.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            tails = _tails(distinct)
            own = (place >= 0) & (place < k.symbols)
            symbol = np.where(own, place, k.symbols + tails).astype("<u2")[codes]
            log = np.where(place >= 0, logs[np.maximum(place, 0)] if len(logs) else 0.0, 0.0)
            total = lambda x: np.bincount(doc, weights=x[codes], minlength=n_docs)  # noqa: E731, B023
            beyond = place[codes] < 0
            key, n = np.unique(doc[beyond] * len(distinct) + codes[beyond], return_counts=True)
            at, code = np.divmod(key, len(distinct))
            rare = pa.StructArray.from_arrays([distinct.take(pa.array(code)), pa.array(n)], ["w", "n"])
            raw = symbol.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n_docs)), *part.columns[:2], pa.array(np.diff(starts)), pa.array(total((place >= 0).astype(float)).astype(np.int64)), pa.array(total(log)),
                 pa.array(total(np.where(own, 0.0, log - sizes[tails]))), pa.array([raw[2 * a : 2 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n_docs + 1)).astype(np.int32)), rare)],
                ["_ts_row", id_col, "held_out", "n_tokens", "n_known", "logs", "tail_logs", "symbols", "rare"])
            row += n_docs

    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(run, schema)


def _documents(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Some batches at a time, and their documents' symbols."""
    parts, docs, n = [], [], 0
    for part, _ in chunks(batches, column, 2 * TOKENS, strings=False):
        parts.append(part)
        docs += [np.frombuffer(x, "<u2") for x in part.column(column).to_pylist()]
        n += sum(map(len, docs[-part.num_rows :]))
        if n >= TOKENS:
            yield parts, docs
            parts, docs, n = [], [], 0
    if parts:
        yield parts, docs


def _averaged(models: DataFrame, *group: Column) -> DataFrame:
    """The averages by tokens of each block of the models of a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("replica")
        w = np.stack([np.frombuffer(x, np.float32) for x in pdf["w"]]).astype(np.float64)
        return pd.DataFrame({"replica": [pdf["replica"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [pdf["n"].sum()], "w": [np.average(w, axis=0, weights=pdf["n"]).astype(np.float32).tobytes()]})

    return models.groupBy("block", *group).applyInPandas(run, models.schema)


def train(encoded: DataFrame, known: Vocabulary, rate: float = RATE, rounds: tuple[int, ...] = ROUNDS) -> Gru:
    """Learns on the rows of encode() outside the held-out fold."""
    model, sc = Gru.start(known.of_symbols(), known.symbols), encoded.sparkSession.sparkContext
    share, upto = F.pmod(F.xxhash64("_ts_row"), F.lit(sum(rounds))), 0
    for k, size in enumerate(rounds):
        sent, pace, end = sc.broadcast(model), rate * FALL**k, known.end

        def run(batches: Iterator[pa.RecordBatch], sent=sent, pace=pace, end=end) -> Iterator[pa.RecordBatch]:
            mine, n = None, 0
            for _, docs in _documents(batches, 0):
                mine = mine or sent.value.of(sent.value.vector())
                mine.learn([x[a : a + RUN] for x in docs for a in range(0, len(x), RUN)], end, pace)
                n += sum(map(len, docs))
            if mine:
                w = mine.vector()
                blocks = [w[a : a + _BLOCK].tobytes() for a in range(0, len(w), _BLOCK)]
                yield pa.RecordBatch.from_pydict({"replica": [TaskContext.get().partitionId()] * len(blocks), "block": list(range(len(blocks))), "n": [n] * len(blocks), "w": blocks}, pa.schema([("replica", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("w", pa.binary())]))
            give_back()

        models = encoded.where(~F.col("held_out") & (share >= upto) & (share < upto + size)).select("symbols").mapInArrow(run, "replica long, block int, n long, w binary")
        merged = _averaged(_averaged(models, F.pmod("replica", F.lit(_SALTS))))
        if found := sorted(merged.select("block", "w").collect()):
            model = model.of(np.concatenate([np.frombuffer(bytes(r.w), np.float32) for r in found]))
        sent.unpersist()
        upto += size
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    counts = materialize(count_words(docs.where(~held_out(id_col)), text_col))
    known = Vocabulary(counts)
    encoded = materialize(encode(docs, known, id_col, text_col))
    model = spark.sparkContext.broadcast(train(encoded, known, rate))
    end = known.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, some in _documents(batches, 1):
            rows = pa.chunked_array([p.column(0) for p in parts]).combine_chunks()
            yield pa.RecordBatch.from_arrays([rows, pa.array(model.value.scores(some, end) / np.log(10))], ["_ts_row", "symbol_logs"])
        give_back()

    scored = encoded.select("_ts_row", "symbols").mapInArrow(run, "_ts_row long, symbol_logs double")
    rare = encoded.select("_ts_row", F.inline("rare")).join(counts, "w", "left").select("_ts_row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    tail = F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0)))
    rare = rare.groupBy("_ts_row").agg(tail.alias("rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    out = encoded.drop("symbols", "rare").join(scored, "_ts_row").join(rare, "_ts_row", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        id_col, "held_out", "n_tokens", (F.col("n_known") + z("rare_known")).alias("n_known"), F.lit(known.n).cast("long").alias("train_tokens"),
        (F.col("logs") + z("rare_logs") - F.col("n_tokens") * F.log10(F.lit(float(known.n + known.v + 1)))).alias("base_score"),
        (F.col("symbol_logs") + F.col("tail_logs") + z("rare_logs")).alias("score"),
    )


def op13_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op13_gru_scores": op13_gru_scores}
#: A recurrent model is beyond SQL; tests/llm/test_lm.py holds counts and base scores against plain Python, the gradients
#: against differences, the scores against a plain reading of the model, and held-out documents against the base.
ORACLES: dict[str, str] = {}
