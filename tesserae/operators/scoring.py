"""Scores of identity candidates: graded signals, hard rules, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import clamp3, level

# Weights of the signals, the least similarity of names, and the weight of one neighbour.
WEIGHTS = {"name": 0.22, "variant": 0.18, "neighbours": 0.22, "chronology": 0.14, "region": 0.08, "book": 0.06, "death": -0.25}
LEAST_SIMILARITY, PER_NEIGHBOUR = 0.34, 0.11
# From which score candidates compete, and below which gap.
STRONG, GAP = 0.80, 0.05


def overlap_ratio(surface: Column, tokens: Column) -> Column:
    """The share of the surface's words that the other has; 0 without words."""
    n = F.size(F.filter(surface, lambda w: F.array_contains(tokens, w)))
    return F.when(F.size(surface) == 0, 0.0).otherwise(n / F.size(surface))


def name_signal(surface: Column, name: Column, surface_words: Column, name_words: Column) -> Column:
    s = F.when(surface == name, 1.0).otherwise(overlap_ratio(surface_words, name_words))
    return F.when(s >= LEAST_SIMILARITY, F.round(WEIGHTS["name"] * s, 4)).otherwise(0.0)


def variant_signal(surface: Column, name: Column, surface_words: Column, variants: Column) -> Column:
    """For a variant (an array of words) all of whose words the surface has, unless the name itself is equal."""
    hit = F.exists(variants, lambda v: (F.size(v) > 0) & F.forall(v, lambda w: F.array_contains(surface_words, w)))
    return F.when(hit & (surface != name), WEIGHTS["variant"]).otherwise(0.0)


def _meets(forms: Column, bags: Column) -> Column:
    """Whether one of the forms (arrays of words) has all its words in one of the bags."""
    return F.coalesce(F.exists(forms, lambda f: (F.size(f) > 0) & F.exists(bags, lambda b: F.size(F.array_except(f, b)) == 0)), F.lit(False))


def neighbour_signal(citing: Column, cited: Column, teachers: Column, students: Column) -> Column:
    """The narrator before (citing) is met among the candidate's students, the one after (cited) among his teachers. All are
    arrays of arrays of words: forms, and the bags of mentions."""
    met = _meets(citing, students).cast("int") + _meets(cited, teachers).cast("int")
    return F.least(F.lit(WEIGHTS["neighbours"]), PER_NEIGHBOUR * met)


def death_conflict(year: Column, last: Column, asserted: Column, known: Column) -> Column:
    """Whether a transmission comes after the last year, or none of the place's asserted years (arrays of (lo, hi)) is among
    the candidate's. Null years do not conflict."""
    after = F.coalesce(year > last, F.lit(False))
    apart = (F.size(asserted) > 0) & (F.size(known) > 0) & ~F.exists(asserted, lambda x: F.exists(known, lambda y: y.between(x["lo"], x["hi"])))
    return after | F.coalesce(apart, F.lit(False))


def source_conflicts(pairs: DataFrame, claims: DataFrame, form: str, candidate: str) -> DataFrame:
    """pairs with source_conflict: a source says that the candidate is another, and the passage is named; claims without a
    passage count for nothing. claims: form, candidate, passage."""
    said = claims.where("passage is not null and passage <> ''").select(form, candidate, F.lit(True).alias("source_conflict")).distinct()
    return pairs.join(said, [form, candidate], "left").withColumn("source_conflict", F.coalesce("source_conflict", F.lit(False)))


def flag_signal(kind: str, holds: Column) -> Column:
    """chronology, region, book or death: its weight if it holds, once; null does not hold."""
    return F.when(holds, WEIGHTS[kind]).otherwise(0.0)


def total(*signals: Column) -> Column:
    out = signals[0]
    for s in signals[1:]:
        out = out + s
    return clamp3(F.round(out, 4))


def ranked(scores: DataFrame, form: str, candidate: str, k: int = 8) -> DataFrame:
    """scores (form, candidate, score, blocked) with place: the k best of a form that have a score or a block."""
    w = Window.partitionBy(form).orderBy(F.desc("score"), candidate)
    return scores.where("score > 0 or blocked").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def competing(scores: DataFrame, form: str, candidate: str) -> DataFrame:
    """scores with competing: strong unblocked candidates of a form whose gap to its best is small, if the two best are."""
    strong = (F.col("score") >= STRONG) & ~F.col("blocked")
    s = F.when(strong, F.struct(F.col("score"), F.col(candidate)))
    w = Window.partitionBy(form)
    close = F.count_if(strong & (F.round(F.col("_ts_best") - F.col("score"), 4) < GAP)).over(w)
    out = scores.withColumn("_ts_best", F.max(s).over(w)["score"])
    mine = strong & (F.round(F.col("_ts_best") - F.col("score"), 4) < GAP)
    return out.withColumn("competing", F.coalesce(mine & (close > 1), F.lit(False))).drop("_ts_best")


def proposals(scores: DataFrame, form: str, candidate: str) -> DataFrame:
    """Of each form its best unblocked candidate (ties by candidate), the level, and whether it may be linked without a
    reviewer. A form of which any candidate is blocked is in conflict."""
    w = Window.partitionBy(form).orderBy(F.col("blocked"), F.desc("score"), candidate)
    best = scores.withColumn("_n", F.row_number().over(w)).groupBy(form).agg(F.max(F.when((F.col("_n") == 1) & ~F.col("blocked"), F.struct(F.col(candidate).alias("c"), F.col("score").alias("s")))).alias("b"), F.bool_or("blocked").alias("any_blocked"))
    lv = F.when(F.col("any_blocked"), "conflict").otherwise(level(F.col("b.s")))
    return best.select(form, F.col("b.c").alias(candidate), F.col("b.s").alias("score"), lv.alias("level"), (lv == "high").alias("auto_link"))
