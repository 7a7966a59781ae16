"""Scalar functions: normalization, identifiers, levels, similarity, dates."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that normalization folds together.
FOLDED = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي"}
# What counts as white space.
WHITE = r"\t\n\x0B\f\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# The alphabet of stable keys, and the least scores of the levels high and medium.
KEY_ALPHABET, HIGH, MEDIUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.90, 0.70


STRING, INT, DOUBLE, BOOLEAN = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct_of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _decompose(t: str | None) -> str | None:
    return t if t is None or t.isascii() else unicodedata.normalize("NFKD", t)


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, which Spark has not; null stays null."""
    return s.map(_decompose)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decomposed_each(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [_decompose(x) for x in xs])


def _folded(decomposed: Column) -> Column:
    t = F.translate(F.regexp_replace(decomposed, r"\p{M}+", ""), "".join(FOLDED) + "ـ", "".join(FOLDED.values()))
    t = F.regexp_replace(t, r"(?i)(?<![\p{L}\p{N}_])(?:ibn|bin)(?![\p{L}\p{N}_])", "b")
    return F.lower(F.trim(F.regexp_replace(t, f"[{WHITE}]+", " ")))


def normalize(text: Column) -> Column:
    """Search form of a text: marks and the elongation sign go, letter variants fold, Latin ibn and bin become b, white
    space collapses, case goes. Null gives an empty text. Only the decomposition leaves the JVM."""
    return _folded(_decomposed(F.coalesce(text, F.lit(""))))


def normalize_each(texts: Column) -> Column:
    """The search forms of an array of texts; null stays null."""
    return F.transform(_decomposed_each(texts), lambda t: _folded(F.coalesce(t, F.lit(""))))


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, n)


def fingerprint(text: Column) -> Column:
    """Of letters and digits only."""
    return F.substring(F.sha2(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), 256), 1, 20)


def stable_key(prefix: str, seed: Column) -> Column:
    """prefix and eight letters: the first eight bytes of the seed's SHA-256, each modulo 32."""
    h = F.sha2(seed, 256)
    letter = lambda i: F.substring(F.lit(KEY_ALPHABET), F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") % 32 + 1, F.lit(1))
    return F.concat(F.lit(prefix), *[letter(i) for i in range(8)])


def level(score: Column) -> Column:
    return F.when(score.isNull(), "unresolved").when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def clamp3(x: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 3)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of a text without white space; a shorter text is its own. Letters are parted once, as a place within a text is
    found by counting from its beginning."""
    t = F.regexp_replace(text, r"\s+", "")
    own = lambda x: F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.length(x) < n, F.array(x)).otherwise(_runs(F.split(x, ""), n, lambda cs, i: F.array_join(F.slice(cs, i + 1, n), "")))
    return F.element_at(F.transform(F.array(t), own), 1)


def _runs(letters: Column, n: int, run) -> Column:
    """The distinct values of run(letters, i) at each place i that n letters follow, itself included."""
    return F.element_at(F.transform(F.array(letters), lambda cs: F.array_distinct(F.transform(F.slice(cs, 1, F.size(cs) - n + 1), lambda _, i: run(cs, i)))), 1)


def trigram_codes(text: Column) -> Column:
    """char_ngrams of three letters as numbers, 21 bits a letter; different ones have different numbers."""
    t = F.regexp_replace(text, r"\s+", "")
    joined = lambda *cs: functools.reduce(lambda x, c: F.shiftleft(x, 21).bitwiseOR(c), cs)
    three = lambda cs, i: joined(cs[i], cs[i + 1], cs[i + 2])
    own = lambda cs: F.when(F.size(cs) == 1, F.array(cs[0])).when(F.size(cs) == 2, F.array(joined(cs[0], cs[1]))).otherwise(_runs(cs, 3, three))
    codes = F.transform(F.split(t, ""), lambda c: F.ascii(c).cast("long") + 1)
    return F.when(F.length(t) == 0, F.array().cast("array<bigint>")).otherwise(F.element_at(F.transform(F.array(codes), own), 1))


def text_similarity(a: Column, b: Column, meaning: Column | None = None) -> Column:
    """1 for equal texts, else .58 of the word similarity and .42 of the trigram similarity, to four places. With a similarity of
    meaning that is not null: .35 and .25, and .4 of it."""
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: w != ""))
    w, g = jaccard(words(a), words(b)), jaccard(char_ngrams(a), char_ngrams(b))
    plain = 0.58 * w + 0.42 * g
    both = plain if meaning is None else F.coalesce(0.35 * w + 0.25 * g + 0.4 * meaning, plain)
    return F.when(a == b, 1.0).otherwise(F.round(both, 4))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers of one length; null where one has no length or is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nth_shares(df: DataFrame, value: str, shares: dict[str, float], most: str, bins: int = 64) -> DataFrame:
    """One row: the values at floor(n * share) of the sorted values, and the largest; null without rows. Numbers only.

    Values are counted first. Approximate quantiles part them into bins; a bin's count (one row each) says in which a share's
    place lies, and only that bin is sorted."""
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    edges = sorted(set(seen.approxQuantile("v", [k / bins for k in range(1, bins)], 0.001)))
    seen = seen.withColumn("bin", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("v"))) if edges else F.lit(0))
    upto, places = 0, {}
    sizes = sorted((r.bin, r.n) for r in seen.groupBy("bin").agg(F.sum("c").alias("n")).collect())
    total = sum(n for _, n in sizes)
    for k, n in sizes:
        for name, share in shares.items():
            if upto <= min(int(total * share), total - 1) < upto + n:
                places[name] = (k, min(int(total * share), total - 1) - upto)
        upto += n
    run = seen.where(F.col("bin").isin([k for k, _ in places.values()])).withColumn("upto", F.sum("c").over(Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    least = [F.min(F.when((F.col("bin") == k) & (F.col("upto") > at), F.col("v"))).alias(name) for name, (k, at) in places.items()]
    none = [F.lit(None).cast("long").alias(name) for name in shares if name not in places]
    one = F.lit(1).alias("_one")
    return run.agg(one, *least, *none).join(seen.agg(one, F.max("v").alias(most)), "_one").select(*shares, most)
