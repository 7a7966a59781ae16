"""A positional inverted index: phrases found without reading texts.

Postings are rows (token, key, positions) in folders by the token's hash. Each task writes those of its own documents, sorted, so texts and
postings are not shuffled and no token, however frequent, is gathered in one task. Documents are added in generations of new keys only; each generation is
a batch of one published version, so a search sees a generation whole or not at all. A phrase is the postings of its tokens,
joined from the rarest on by key, with position lists shifted by the token's place and intersected. Only folders of the
phrase's tokens are read, and rows of other tokens there are skipped by the file's statistics, as files are sorted by token.

Nulls and edges: a null haystack has no tokens; rows without key are not indexed; of rows that share a key one is; an empty
phrase, or one of separators only, matches every document.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import let
from tesserae.sources.snapshots import Snapshots

BUCKETS = 32
#: What parts tokens: all but letters and digits, or white space.
LETTERS, SPACES = r"[^\p{L}\p{N}]+", r"\s+"
#: Expansions of a part of a word that are looked up by name; more are joined.
EXPANSIONS = 1000


def _places_of(words: Column) -> Column:
    """(token, positions) of each word of a text, once."""

    def of(s: Column) -> Column:
        begins = F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i - 1)["token"] != F.get(s, i)["token"]))
        one = lambda bs, b, k: F.struct(F.get(s, b)["token"].alias("token"), F.transform(F.slice(s, b + 1, F.coalesce(F.get(bs, k + 1), F.size(s)) - b), lambda x: x["at"]).alias("positions"))
        return let(begins, lambda bs: F.transform(bs, lambda b, k: one(bs, b, k)))

    return let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("at")))), of)


class SearchIndex:
    def __init__(self, store: Snapshots, separators: str = LETTERS, buckets: int = BUCKETS):
        self.store, self.separators, self.buckets = store, separators, buckets

    def tokens_of(self, text: Column) -> Column:
        return F.filter(F.split(F.coalesce(text, F.lit("")), self.separators), lambda w: w != "")

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.crc32(token), F.lit(self.buckets)).cast("int")

    def _buckets(self, words: list[str]) -> list[int]:
        return sorted({zlib.crc32(w.encode()) % self.buckets for w in words})

    def _has(self, table: str) -> bool:
        return table in self.store.manifest()["tables"]

    def add(self, docs: DataFrame, key: str, haystack: Column, frequent: int | None = None) -> int:
        """Indexes the documents whose key is not indexed yet. How many there were. `frequent` has no effect: as each task writes the postings
        of its own documents, no token is gathered that would have to be split."""
        new = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), haystack.alias("text"))
        if self._has("keys"):
            new = new.join(self.store.read("keys").select("key"), "key", "left_anti")
        # only documents that share a key are shuffled
        twice = new.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        if not twice.isEmpty():
            new = new.join(twice, "key", "left_anti").unionByName(new.join(twice, "key", "left_semi").dropDuplicates(["key"]))
        new = new.select("key", self.tokens_of(F.col("text")).alias("words"))
        postings = new.select("key", F.explode(_places_of(F.col("words"))).alias("p")).select(self._bucket(F.col("p.token")).alias("bucket"), "p.token", "key", "p.positions").sortWithinPartitions("bucket", "token", "key")
        counts = new.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("bucket", self._bucket(F.col("token")))
        keys = new.select("key", F.size("words").alias("n"))
        generation = uuid.uuid4().hex
        self.store.publish({"postings": {generation: postings}, "tokens": {generation: counts}, "keys": {generation: keys}}, by={"postings": ["bucket"], "tokens": ["bucket"]})
        return self.store.manifest()["tables"]["keys"]["batches"][generation]["rows"]

    def counts(self, words: list[str]) -> dict[str, int]:
        """Occurrences of these tokens; those that do not occur are missing."""
        found = self.store.read("tokens").where(F.col("bucket").isin(self._buckets(words)) & F.col("token").isin(words))
        return {r.token: r.n for r in found.groupBy("token").agg(F.sum("n").alias("n")).collect()}

    def postings(self, words: list[str]) -> DataFrame:
        """Of these tokens only: token, key, positions."""
        return self.store.read("postings").where(F.col("bucket").isin(self._buckets(words)) & F.col("token").isin(words)).select("token", "key", "positions")

    def phrase(self, words: list[str], inside: bool = False) -> DataFrame:
        """(key, starts) of the documents that have these tokens one after the other, and where; `inside`: with a token after them."""
        if not words:
            return self.store.read("keys").select("key", F.array().cast("array<int>").alias("starts"))
        counts = self.counts(list(dict.fromkeys(words)))
        order = sorted(range(len(words)), key=lambda i: (counts.get(words[i], 0), i))
        one = lambda i: self.postings([words[i]]).select("key", F.transform("positions", lambda p: p - i).alias(f"_{i}"))
        found = one(order[0]).withColumnRenamed(f"_{order[0]}", "starts").where(F.exists("starts", lambda p: p >= 0))
        for i in order[1:]:
            found = found.join(one(i), "key").select("key", F.array_intersect("starts", f"_{i}").alias("starts")).where(F.size("starts") > 0)
        if inside:
            found = found.join(self.store.read("keys"), "key").where(F.exists("starts", lambda p: p + len(words) < F.col("n"))).select("key", "starts")
        return found.select("key", F.sort_array("starts").alias("starts"))

    def having(self, part: str, where: str = "contains") -> DataFrame:
        """(key) of the documents with a token that contains, starts or ends with a part of a word. Tokens are few beside texts; the
        documents come from their postings."""
        test = {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[where]
        words = self.store.read("tokens").where(test(F.col("token"), F.lit(part))).select("token", "bucket").distinct()
        some = [r.token for r in words.limit(EXPANSIONS + 1).collect()]
        if len(some) <= EXPANSIONS:
            return self.postings(some).select("key").distinct() if some else self.store.read("keys").select("key").limit(0)
        return self.store.read("postings").join(words, ["bucket", "token"], "left_semi").select("key").distinct()

    def matches(self, docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
        """The rows of docs whose key was found."""
        return docs.join(found.select(F.col("key").alias("_ts_key")), F.col(key) == F.col("_ts_key"), "left_semi")
