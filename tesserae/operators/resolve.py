"""Candidates for identities: an inverted index, blocking by a budget, ranking, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def postings(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(token, id), each once."""
    return df.select(F.explode(F.array_distinct(F.split(F.lower(text), " "))).alias("token"), F.col(id_col).alias("id")).where("token <> ''")


def posting_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("n"))


def within_budget(tokens: DataFrame, index: DataFrame, budget: int) -> DataFrame:
    """(form, token, n, used) of tokens (form, token, n): rarest first, the rarest always; one that would take the distinct
    entries so far and its own list over the budget is passed over and the next is tried. index: token, id.

    A list longer than the budget can only be used as a form's rarest, and then alone, so only shorter ones are put into
    arrays; no array of a form holds more than the budget."""
    ranked = tokens.withColumn("_r", F.row_number().over(Window.partitionBy("form").orderBy("n", "token")))
    lists = index.join(posting_sizes(index).where(F.col("n") < budget), "token").groupBy("token").agg(F.collect_set("id").alias("_ids"))
    met = ranked.where(F.col("n") < budget).join(lists, "token")
    sort = F.array_sort(F.collect_list(F.struct("_r", "token", "n", "_ids")))
    empty = F.slice(F.get(F.col("_t"), F.lit(0))["_ids"], 1, 0)
    start = F.struct(empty.alias("seen"), F.array().cast("array<string>").alias("x"))
    step = lambda acc, t: F.when((F.size(acc["x"]) == 0) | (F.size(acc["seen"]) + t["n"] <= budget), F.struct(F.array_union(acc["seen"], t["_ids"]).alias("seen"), F.concat(acc["x"], F.array(t["token"])).alias("x"))).otherwise(acc)
    used = met.groupBy("form").agg(sort.alias("_t")).select("form", F.explode(F.aggregate("_t", start, step)["x"]).alias("token"), F.lit(True).alias("_u"))
    # where the rarest is short it is in used; where it is long it is the only one
    return ranked.join(used, ["form", "token"], "left").select("form", "token", "n", (F.coalesce("_u", F.lit(False)) | (F.col("_r") == 1)).alias("used"))


# How a name matches, from the best.
MATCHES = ["exact_name", "name_prefix", "name_contains", "biography_mention"]


def rank_names(df: DataFrame, name: Column, query: str, text: Column | None = None, require_name: bool = False) -> DataFrame:
    """df with rank: 0 equal, 1 one begins with the other, 2 the name contains the query, 3 (with `text`) the text does; others
    go. An empty name begins every query, unless a name is required."""
    q = F.lit(query)
    prefix = (F.startswith(name, q) | F.startswith(q, name)) & ((name != "") if require_name else F.lit(True))
    rank = F.when(name == q, 0).when(prefix, 1).when(F.contains(name, q), 2)
    return df.withColumn("rank", rank if text is None else rank.when(F.contains(text, q), 3)).where("rank is not null")


def top(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)


def bounds_verdict(a_birth: Column, a_death: Column, b_birth: Column, b_death: Column, known: Column | None = None) -> Column:
    """(verdict, reason) of two persons by their earliest birth and latest death, branch by branch in this order: either is
    unknown; either has no year at all; one is born after the other's death (touching years are none such); either has no
    birth, which no death stands in for; else possible. That they met is never said."""
    said = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))
    dated = (a_birth.isNotNull() | a_death.isNotNull()) & (b_birth.isNotNull() | b_death.isNotNull())
    return (
        F.when(~F.coalesce(F.lit(True) if known is None else known, F.lit(False)), said("insufficient", "unknown"))
        .when(~dated, said("insufficient", "undated")).when(a_birth > b_death, said("impossible", "a-after-b")).when(b_birth > a_death, said("impossible", "b-after-a"))
        .when(a_birth.isNull() | b_birth.isNull(), said("insufficient", "no-birth")).otherwise(said("possible", "no-contradiction"))
    )


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters, one row; null if chance agreement is 1."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    ra, rb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, "a").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    # two rows of one row each
    one = total.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")
    po, pe = F.col("agree") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return one.select(F.col("t").alias("n"), F.round(po, 6).alias("observed"), F.round(pe, 6).alias("chance"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def precision_recall(df: DataFrame, groups: list[str], truth: Column, said: Column) -> DataFrame:
    """Over all rows, each group column alone and all together; null where nothing could be right."""
    d = df.withColumns({"tp": (truth & said).cast("int"), "fp": (~truth & said).cast("int"), "fn": (truth & ~said).cast("int")})
    out = d.groupingSets([[], *[[F.col(g)] for g in groups], [F.col(g) for g in groups]], *groups).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping_id().cast("int").alias("gid"))
    return out.select("gid", *groups, "tp", "fp", "fn", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))
