"""Chains of nodes and the graph that their neighbours make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.scratch import stored


def positions(df: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """df with position, from 0, in each chain; `order` has to be total up to equal rows."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(chain).orderBy(*order)) - 1)


def adjacency(df: DataFrame, chain: str, node: str, order: list[str]) -> DataFrame:
    """(chain, position, src, dst, relation): each pair of consecutive nodes in both directions. The earlier one
    transmits from the later."""
    w = Window.partitionBy(chain).orderBy(*order)
    p = df.select(F.col(chain).alias("chain"), (F.row_number().over(w) - 1).alias("position"), F.col(node).alias("a"), F.lead(node).over(w).alias("b")).where("b is not null")
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("transmitted_from").alias("relation")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit("transmitted_to").alias("relation"))))
    return p.select("chain", "position", both.alias("e")).select("chain", "position", "e.*")


def aggregate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst", "relation").agg(F.count("*").alias("n"), F.countDistinct("chain").alias("n_chains"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "src").limit(k)


#: Relations that lead from a node in each direction.
DIRECTIONS = {"teachers": ["transmitted_from"], "students": ["transmitted_to"], "both": ["transmitted_from", "transmitted_to"]}


def bounded_paths(edges: DataFrame, start: int | str, depth: int, cap: int, direction: str = "both") -> DataFrame:
    """(depth, src, dst, path, truncated) of the simple paths from start, by depth, source, target and path, cut at cap.

    Level by level: deeper paths come later in that order, so a level is cut where the cap is reached and no further one is
    needed. Each level joins the edges, stored once, with the one before, of at most `cap` rows, which alone pass through the
    driver. graph.paths_from() does the same for many starts at once without the driver."""
    d = edges.where(F.col("relation").isin(DIRECTIONS[direction])) if "relation" in edges.columns else edges
    d = stored(d.select("src", "dst").distinct())
    spark, kind = edges.sparkSession, d.schema["src"].dataType.simpleString()
    schema = f"depth int, src {kind}, dst {kind}, path string"
    rows: list = []
    level = [(0, None, start, f"|{start}|")]
    for k in range(1, depth + 1):
        if not level or len(rows) >= cap:
            break
        before = spark.createDataFrame([(x[2], x[3]) for x in level], f"src {kind}, before string")
        step = d.join(F.broadcast(before), "src").select(F.lit(k).alias("depth"), "src", "dst", F.concat("before", F.col("dst").cast("string"), F.lit("|")).alias("path"), "before")
        step = step.where(~F.contains("before", F.concat(F.lit("|"), F.col("dst").cast("string"), F.lit("|")))).drop("before")
        level = [tuple(r) for r in step.orderBy("src", "dst", "path").limit(cap - len(rows)).collect()]
        rows += level
    return spark.createDataFrame(rows, schema).withColumn("truncated", F.lit(len(rows) >= cap))


def path_nodes(paths: DataFrame) -> DataFrame:
    """(node) of all ends on the paths, in order."""
    return paths.select(F.explode(F.array("src", "dst")).alias("node")).distinct().orderBy("node")


def prefix_segments(df: DataFrame, chain: str, label: str, order: list[str]) -> DataFrame:
    """Shared beginnings: (depth, path, n_chains) of every run of labels that chains begin with."""
    w = Window.partitionBy(chain).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = df.select(chain, F.array_join(F.collect_list(label).over(w), ">").alias("path"), F.count("*").over(w).alias("depth"))
    return runs.groupBy("depth", "path").agg(F.countDistinct(chain).alias("n_chains"))
