"""Evaluation: frames drawn from strata, their checks, agreement of annotators, predictions against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.identifiers import frame_digest, nth_random, shuffled, text_seed
from tesserae.operators.editorial import quotas
from tesserae.operators.scans import first_shuffled, ordinals
from tesserae.sources.scratch import stored

#: What an annotator may decide.
DECISIONS = ["identified", "ambiguous", "not_in_registry", "unreadable"]


def simple_frame(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """(key, place, weight) of n rows drawn by seeded numbers of their own: a row's number depends on its key alone, so the
    draw is one top-n and any order of the input gives the same rows."""
    total = df.count()
    drawn = df.select(key, nth_random(text_seed(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), F.lit(1)).alias("_u")).orderBy("_u", key).limit(n)
    return drawn.select(key, F.lit(total / max(1, min(n, total))).alias("weight"))


def seeded_frame(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """(key, place, weight): the first n rows of a population sorted by key after the seeded shuffle by swaps, whatever its size."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    placed = stored(ordinals(keys, [key], "item"))
    total = placed.count()
    drawn = first_shuffled(total, text_seed(F.lit(seed)), n, df.sparkSession)
    return placed.join(drawn, "item").select(key, "place", F.lit(total / max(1, min(n, total))).alias("weight"))


def shuffled_frame(cells: DataFrame, cell: str, ids: str, seed: str, n: Column) -> DataFrame:
    """cells (cell, ids: sorted array of a bounded frame) -> (cell, id, place): the first n ids of each after a seeded shuffle."""
    order = shuffled(F.col(ids), F.concat(F.lit(seed + "|"), F.col(cell)))
    return cells.select(cell, n.alias("_n"), F.posexplode(order).alias("place", "id")).where("place < _n").select(cell, "id", "place")


def head_stratum(source: Column, length: Column, kunya: Column, nisba: Column) -> Column:
    """Source, length, kunya and nisba of a name's head, as one stratum."""
    flag = lambda c, yes: F.when(c, yes).otherwise("-")
    return F.concat_ws("|", source, length, flag(kunya, "K"), flag(nisba, "N"))


def occurrence_stratum(length: Column, kunya: Column, nisba: Column, relative: Column, homonym: Column) -> Column:
    """The five parts of a form's stratum."""
    flag = lambda c, yes: F.when(c, yes).otherwise("-")
    return F.concat_ws("|", length, flag(kunya, "K"), flag(nisba, "N"), flag(relative, "R"), flag(homonym, "H"))


def check_frame(frame: DataFrame, population: DataFrame, digest: str | None = None) -> DataFrame:
    """(check, n) of a frame (id, stratum, cell_size, weight) against its population (id, stratum): how many rows or cells
    break each. duplicate ids; ids that are not in the population; cells of another size; weights that do not sum to their
    cell; cells without a row; a digest that is not the one of the ids in order."""
    sizes = population.groupBy("stratum").agg(F.count("*").alias("_size"))
    cells = frame.groupBy("stratum").agg(F.max("cell_size").alias("cell_size"), F.min("cell_size").alias("_least"), F.sum("weight").alias("_w"))
    met = sizes.join(cells, "stratum", "full")
    one = lambda name, df, n=F.count("*"): df.agg(n.alias("n")).select(F.lit(name).alias("check"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    out = one("duplicate_id", frame.groupBy("id").count().where("count > 1"))
    out = out.unionByName(one("unknown_id", frame.join(population.select("id"), "id", "left_anti")))
    out = out.unionByName(one("cell_size", met.where("cell_size is not null and (_size is null or _least <> _size or cell_size <> _size)")))
    out = out.unionByName(one("weight_sum", met.where("cell_size is not null and abs(_w - cell_size) > 1e-6")))
    out = out.unionByName(one("empty_cell", met.where("cell_size is null")))
    if digest is not None:
        ids = frame.agg(frame_digest(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string"))).alias("d"))
        out = out.unionByName(one("digest", ids.where(F.col("d") != digest)))
    return out


def annotation_errors(annotations: DataFrame) -> DataFrame:
    """(id, annotator, code): annotations that break a rule. An identification names a person and his revision, others none."""
    named = F.col("narrator").isNotNull()
    code = F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown-decision").when((F.col("decision") == "identified") & ~named, "person-missing").when((F.col("decision") == "identified") & F.col("revision").isNull(), "revision-missing").when((F.col("decision") != "identified") & named, "person-unwanted")
    return annotations.select("id", "annotator", code.alias("code")).where("code is not null")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: items of both, equal decisions, and of those identified by both the share that names the same person."""
    met = a.select("id", F.col("decision").alias("da"), F.col("narrator").alias("na")).join(b.select("id", F.col("decision").alias("db"), F.col("narrator").alias("nb")), "id")
    both = (F.col("da") == "identified") & (F.col("db") == "identified")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("da") == F.col("db")).alias("same_decision"), F.count_if(both).alias("both_identified"), F.count_if(both & (F.col("na") == F.col("nb"))).alias("same_person")).withColumn("exact", F.round(F.try_divide("same_person", "both_identified"), 6))


def adjudicated(a: DataFrame, b: DataFrame, third: DataFrame) -> DataFrame:
    """(id, decision, narrator, by): what both said alike, else what the third said, who is neither of them; open without."""
    x = a.select("id", F.col("decision").alias("da"), F.col("narrator").alias("na"), F.col("annotator").alias("aa"))
    y = b.select("id", F.col("decision").alias("db"), F.col("narrator").alias("nb"), F.col("annotator").alias("ab"))
    z = third.select("id", F.col("decision").alias("dc"), F.col("narrator").alias("nc"), F.col("annotator").alias("ac"))
    met = x.join(y, "id").join(z, "id", "left")
    same = (F.col("da") == F.col("db")) & F.col("na").eqNullSafe(F.col("nb"))
    may = F.col("ac").isNotNull() & ~F.col("ac").isin(F.col("aa"), F.col("ab"))
    return met.select("id", F.when(same, F.col("da")).when(may, F.col("dc")).alias("decision"), F.when(same, F.col("na")).when(may, F.col("nc")).alias("narrator"), F.when(same, "both").when(may, "third").otherwise("open").alias("by"))


def prediction_metrics(df: DataFrame, groups: list[str], weight: str | None = None) -> DataFrame:
    """df (truth, said: persons or null; conflict) -> counts and shares over all rows, each group alone and all together.
    Right is a person that is the true one; abstained is no person; shares are null where nothing could be right. With a
    weight, rows count by it."""
    w = F.col(weight) if weight else F.lit(1.0)
    add = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    truth, said = F.col("truth"), F.col("said")
    tp, fp, fn = said.isNotNull() & truth.eqNullSafe(said), said.isNotNull() & ~truth.eqNullSafe(said), truth.isNotNull() & ~truth.eqNullSafe(said)
    out = df.groupingSets([[], *[[F.col(g)] for g in groups], [F.col(g) for g in groups]], *groups).agg(
        add(tp).alias("tp"), add(fp).alias("fp"), add(fn).alias("fn"), add(said.isNotNull()).alias("covered"), add(said.isNull()).alias("abstained"), add(F.coalesce("conflict", F.lit(False))).alias("conflicts"), F.sum(w).alias("n"), F.grouping_id().cast("int").alias("gid"),
    )
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    n = F.col("n")
    return out.select("gid", *groups, "tp", "fp", "fn", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), share(F.col("covered"), n).alias("coverage"), share(F.col("abstained"), n).alias("abstention"), share(F.col("conflicts"), n).alias("conflict_rate"))


def drawn_cells(rows: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, cell_size, quota) of rows."""
    return quotas(rows.groupBy(stratum).agg(F.count("*").alias("cell_size")), stratum, "cell_size", total)
