"""Many forms against all names at once: equal, one begins with the other, the name contains the form, a text mentions it.

Each way is an equi-join with a check behind it. Beginnings meet at a length that is a power of two: the shorter text takes
the largest such length that it has, the longer one offers all of its own, so that what meets agrees in half of the shorter text
at least. Containment meets at the rarest gram of three letters that the form has (of the form's own length where it is
shorter). A tier is asked only for forms that the tiers before left short of k, and each tier keeps k a form.

Nulls and edges: null forms and names take no part; an empty form begins every name, an empty name every form unless a name is
required; rows of one id are told apart by their names; forms that repeat are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.scratch import stored

#: Lengths at which beginnings meet, and letters of a gram.
LENGTHS, GRAM = [0, *[1 << k for k in range(13)]], 3


def _lengths(text: Column) -> Column:
    return F.filter(F.array(*[F.lit(n) for n in LENGTHS]), lambda n: n <= F.length(text))


def _beginnings(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
    """Pairs of rows whose t begins with s."""
    n = F.try_element_at(_lengths(F.col(s)), F.lit(-1))
    few = short.withColumn("_n", n).withColumn("_b", F.substring(F.col(s), F.lit(1), n))
    many = long.withColumn("_m", F.explode(_lengths(F.col(t)))).withColumn("_c", F.substring(F.col(t), F.lit(1), F.col("_m")))
    met = few.join(many, (F.col("_n") == F.col("_m")) & (F.col("_b") == F.col("_c")) & F.startswith(F.col(t), F.col(s)))
    return met.drop("_n", "_b", "_m", "_c")


def _grams(text: Column, n: Column) -> Column:
    return F.when((F.length(text) >= n) & (n > 0), F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def containing(forms: DataFrame, rows: DataFrame, text: str, key: str = "id") -> DataFrame:
    """(form, key) of the rows whose text contains a form that is not empty. rows: key, text."""
    asked = forms.where(F.length("form") > 0).withColumn("n", F.least(F.length("form"), F.lit(GRAM)))
    sizes = sorted(r.n for r in asked.select("n").distinct().collect())  # at most GRAM
    if not sizes:
        return rows.select(F.lit("").alias("form"), key).limit(0)
    grams = stored(rows.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.concat(*[_grams(F.col(text), F.lit(n)) for n in sizes]))).alias("gram")).distinct())
    wanted = asked.select("form", F.explode(_grams(F.col("form"), F.col("n"))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("c"))
    # a gram that no row has counts 0, and rules the form out
    rarest = wanted.join(counts, "gram", "left").groupBy("form").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("g")).where("g.c > 0")
    met = rarest.select("form", F.col("g.gram").alias("gram")).join(grams, "gram").select("form", key)
    return met.join(rows.select(key, text), key).where(F.contains(F.col(text), F.col("form"))).select("form", key).distinct()


def match_forms(forms: DataFrame, names: DataFrame, k: int, text: str | None = None, require_name: bool = False) -> tuple[DataFrame, list[dict]]:
    """(form, id, name, rank, place): of each form the k best rows by rank, length of the name and id; and what each tier did (forms
    asked, candidates found). forms: (form); names: (id, name[, text]). The ranks are those of resolve.rank_names()."""
    asked = stored(forms.select("form").where("form is not null").distinct())
    rows = names.where("id is not null and name is not null")
    named = rows.select("id", "name").distinct()
    order = Window.partitionBy("form").orderBy(F.length("name"), "id", "name")

    def equal(short: DataFrame) -> DataFrame:
        return short.join(named, F.col("form") == F.col("name"))

    def begins(short: DataFrame) -> DataFrame:
        some = named.where("name <> ''") if require_name else named
        return _beginnings(short, "form", some, "name").select("form", "id", "name").unionByName(_beginnings(some, "name", short, "form").select("form", "id", "name")).where("form <> name").distinct()

    def contains(short: DataFrame) -> DataFrame:
        found = containing(short, named.select("name").distinct(), "name", "name")
        return found.join(named, "name").where(~F.startswith("name", F.col("form"))).where(~F.startswith("form", F.col("name")) if not require_name else F.lit(True)).select("form", "id", "name")

    def mentions(short: DataFrame) -> DataFrame:
        return containing(short, rows.select("id", text), text).join(named, "id").select("form", "id", "name")

    tiers = [equal, begins, contains, *([mentions] if text else [])]
    found, told, open_ = None, [], asked
    for rank, tier in enumerate(tiers):
        new = tier(open_)
        if found is not None:
            new = new.join(found.select("form", "id", "name"), ["form", "id", "name"], "left_anti")
        new = stored(new.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("form", "id", "name", F.lit(rank).alias("rank")))
        told.append({"rank": rank, "forms": open_.count(), "candidates": new.count()})
        found = new if found is None else found.unionByName(new)
        full = found.groupBy("form").count().where(F.col("count") >= k).select("form")
        open_ = stored(asked.join(full, "form", "left_anti"))
    best = Window.partitionBy("form").orderBy("rank", F.length("name"), "id", "name")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), told
