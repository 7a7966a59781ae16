"""Running sums and values carried forward over groups of any size, by two levels.

Rows are dealt to blocks by ranges of (group, order) and stored, so a large group is many blocks. Each block is summed up in
one row, these rows are scanned a group (there are as many as blocks), and what a block inherits is joined back, so that the
window over rows sees a block at a time. Rows that are equal in group and order are in one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.scratch import small, stored

#: Rows that a block has at most on average.
BLOCK = 200_000


def _blocks(df: DataFrame, groups: list[str], order: list[str], block: int) -> DataFrame:
    n = max(1, -(-df.count() // block), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(n, *groups, *order).withColumn("_block", F.spark_partition_id()))


def two_level(df: DataFrame, group: str | list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """df with, of each group in this order, running sums up to and with each row, and the last values so far that are not null."""
    sums, lasts, groups = sums or {}, lasts or {}, [group] if isinstance(group, str) else group
    values = {**{f"_s{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}, **{f"_l{i}": c for i, c in enumerate(lasts.values())}}
    d = _blocks(df.withColumns(values), groups, order, block)
    by = F.struct(*order)
    totals = d.groupBy(*groups, "_block").agg(*[F.sum(c).alias(c) if c[1] == "s" else F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in values])
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inherited = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_block").alias("_b"),
        *[(F.coalesce(F.sum(c).over(before), F.lit(0)) if c[1] == "s" else F.last(c, ignorenulls=True).over(before)).alias(f"_c{c}") for c in values],
    )
    same = F.col("_block") == F.col("_b")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*groups, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(small(inherited), same)
    made = {n: F.col(f"_c_s{i}") + F.sum(f"_s{i}").over(within) for i, n in enumerate(sums)} | {n: F.coalesce(F.last(f"_l{i}", ignorenulls=True).over(within), F.col(f"_c_l{i}")) for i, n in enumerate(lasts)}
    kept = [c for c in df.columns if c not in made]
    return out.select(*kept, *[c.alias(n) for n, c in made.items()])


def ordinals(df: DataFrame, order: list[str], name: str, block: int = BLOCK) -> DataFrame:
    """df with the place of each row, from 0, in this order, which has to be total up to equal rows."""
    d = _blocks(df, [], order, block)
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    upto = d.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return d.join(small(upto), "_block").select(*df.columns, (F.col("_before") + place - 1).cast("long").alias(name))


def first_shuffled(n_all: int, seed: Column, n: int, spark) -> DataFrame:
    """(place, item): which of n_all items, numbered from 0, a seeded shuffle by swaps from the end puts at the first n places.

    The shuffle swaps place k with place floor(u * (k + 1)) for k from the end down to 1. What ends at k stood before at the place that
    k was swapped with; what stood there came from the latest earlier swap that hit the place, which is the next larger k with that
    place, or is its own. So no array is held: each swap's place is computed from its number alone, one window a place
    finds the next swap that hits it, and the n wanted places are followed from swap to swap, about ln(n_all / k) steps for
    place k, all n in one join a step."""
    from tesserae.functions.identifiers import nth_random

    wanted = spark.range(min(n, n_all)).withColumnRenamed("id", "place")
    if n_all < 2:
        return wanted.select("place", F.col("place").alias("item"))
    k = spark.range(1, n_all).withColumnRenamed("id", "k")
    swaps = k.select("k", F.floor(nth_random(seed, F.lit(n_all) - F.col("k")) * (F.col("k") + 1)).cast("long").alias("j"))
    swaps = stored(swaps.withColumn("later", F.lead("k").over(Window.partitionBy("j").orderBy("k"))))
    # the next swap that hits a place after the place's own
    hits = stored(swaps.where("j < k").groupBy(F.col("j").alias("x")).agg(F.min("k").alias("hit")))
    mine = wanted.join(swaps, F.col("place") == F.col("k"), "left")
    # what a swapped place held: its own item if no swap hit it before, else what the latest such swap brought from its place
    own, later = F.col("k").isNull() | (F.col("j") == F.col("k")), F.col("later").isNotNull()
    front = stored(mine.select("place", "j", F.when(own, F.col("place")).when(later, F.col("later")).alias("at")))
    done = front.where("at is null").select("place", F.col("j").alias("item"))
    open_ = front.where("at is not null").select("place", "at")
    while open_.limit(1).count():
        step = stored(open_.join(hits, F.col("at") == F.col("x"), "left").select("place", "at", "hit"))
        done = done.unionByName(step.where("hit is null").select("place", F.col("at").alias("item")))
        open_ = step.where("hit is not null").select("place", F.col("hit").alias("at"))
    return done
