"""The record store: scans, joins that carry sources, lookups, projections of records and statements, places in a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import normalize
from tesserae.operators.scans import two_level


def in_order(*parts: DataFrame, order: str = "corpus_order") -> DataFrame:
    """Parts one after the other; `order` is the part's number, by which a scan of all is sorted first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn(order, F.lit(k)) for k, p in enumerate(parts)])


def with_sources(records: DataFrame, passages: DataFrame, works: DataFrame, passage: str, work: str) -> DataFrame:
    """Records with the passage they stand in and the work of that passage; those without either are left out."""
    return records.join(passages, passage).join(works, work)


def lookup(ids: DataFrame, key: str, known: DataFrame, columns: list[str]) -> DataFrame:
    """ids with `columns` of known by key: every id stays, in its order and as often as it stands there."""
    return ids.join(known.select(F.col(key).alias("_k"), *columns), F.col(key) == F.col("_k"), "left").drop("_k")


def first_route(df: DataFrame, routes: list[tuple[DataFrame, str, str]], name: str) -> DataFrame:
    """df with `name`: what the first of several routes gives. A route is (table, its key as a column of df too, its value)."""
    for k, (table, key, value) in enumerate(routes):
        df = df.join(table.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")), F.col(key) == F.col(f"_k{k}"), "left")
    n = range(len(routes))
    return df.withColumn(name, F.coalesce(*[F.col(f"_v{k}") for k in n])).drop(*[f"_{c}{k}" for k in n for c in "kv"])


def with_earlier(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows for which another of the same key stands before."""
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"))
    return df.join(first, F.col(key) == F.col("_k")).where(F.col("_first") < F.col(order)).drop("_k", "_first")


def named_heads(forms: DataFrame, form: str, entries: DataFrame, names: list[str]) -> DataFrame:
    """forms with heads: how many entries have the form as one of their names; an entry counts once."""
    heads = entries.select(F.explode(F.array_distinct(F.array(*names))).alias("_n")).where("_n is not null").groupBy("_n").agg(F.count("*").alias("heads"))
    return forms.join(heads, F.col(form) == F.col("_n"), "left").drop("_n").withColumn("heads", F.coalesce("heads", F.lit(0).cast("long")))


def count_of(df: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """df with the number of rows that other has for its key."""
    n = other.groupBy(F.col(other_key).alias("_k")).agg(F.count("*").alias(name))
    return df.join(n, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def updated(df: DataFrame, key: str, new: DataFrame, column: str) -> DataFrame:
    """df with `column` from new where that has a value for the key. A key stands once in new."""
    rest = [c for c in df.columns if c != column]
    met = df.join(new.select(F.col(key).alias("_k"), F.col(column).alias("_v")), F.col(key) == F.col("_k"), "left")
    return met.select(*rest, F.coalesce("_v", column).alias(column)).select(*df.columns)


def families_of(occurrences: DataFrame, families: DataFrame, record: str, family: str, unassigned: str = "__unassigned__") -> DataFrame:
    """occurrences with the family of their record."""
    met = occurrences.join(families.select(F.col(record).alias("_r"), F.col(family).alias(family)), F.col(record) == F.col("_r"), "left").drop("_r")
    return met.withColumn(family, F.coalesce(family, F.lit(unassigned)))


def chains_or_forms(chains: Column, forms: Column) -> Column:
    """A record's chains, or one made of its surface forms where it has none."""
    one = F.struct(F.lit(0).alias("chain_order"), F.transform(F.coalesce(forms, F.array().cast("array<string>")), lambda x, i: F.struct(i.alias("position"), x.alias("raw"))).alias("occurrences"))
    return F.when(F.coalesce(F.size(chains), F.lit(0)) > 0, chains).otherwise(F.array(one))


def chain_count(chains: Column, markers: Column) -> Column:
    """Chains, else markers of routes, else one."""
    return F.coalesce(F.when(chains > 0, chains), markers, F.lit(1))


def reference(work: Column, number: Column, **places: Column) -> Column:
    """Where a record stands, as one struct."""
    return F.struct(work.alias("source_work"), number.alias("number"), *[c.alias(k) for k, c in places.items()])


def statement_phrase(phrase: Column, cleared: Column, fields: Column, label: str = "teacher_student_phrases") -> Column:
    """A statement's wording, if its source is cleared and lists the field."""
    return F.when(cleared & F.coalesce(F.array_contains(fields, label), F.lit(False)), phrase)


#: Words of evidence for hearing, in a critic's phrase.
HEARING = "سمع|روى عن|حدث عنه|لقي|ادرك"


def tells_of_hearing(phrase: Column) -> Column:
    return F.coalesce(normalize(phrase).rlike("سمع|روي عن|حدث عنه|لقي|ادرك"), F.lit(False))


def haystack(*parts: Column) -> Column:
    """The text that a search looks through: its parts joined, then normalized."""
    return normalize(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def neighbours(df: DataFrame, chain: str, position: str, form: str) -> DataFrame:
    """df with the forms before and after each."""
    w = Window.partitionBy(chain).orderBy(position)
    return df.withColumn("previous", F.lag(form).over(w)).withColumn("next", F.lead(form).over(w))


def segments(markers: DataFrame, doc: str, start: str, length: Column) -> DataFrame:
    """markers with where their segment ends: at the next marker, or the document's end."""
    w = Window.partitionBy(doc).orderBy(start)
    return markers.withColumn("segment_end", F.coalesce(F.lead(start).over(w), length))


def once_each(df: DataFrame, scope: str, key: Column, order: list) -> DataFrame:
    """The first row of each key within its scope."""
    w = Window.partitionBy(scope, key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page_of(offsets: DataFrame, pages: DataFrame, doc: str, offset: str, page: str, length: str, gap: int = 1) -> DataFrame:
    """offsets with the page they fall on. pages: doc, page, length; pages follow each other, `gap` characters apart.
    Both are one sequence by place in which the last page's number is carried forward."""
    starts = two_level(pages.select(doc, page, length), doc, [page], sums={"_upto": F.col(length) + gap})
    starts = starts.select(doc, (F.col("_upto") - F.col(length) - gap).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col(page).alias("_page"))
    rest = [c for c in offsets.columns if c != doc]
    asked = offsets.select(doc, F.col(offset).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_row"))
    both = starts.unionByName(asked, allowMissingColumns=True)
    found = two_level(both, doc, ["_at", "_kind"], lasts={"_page": F.col("_page")}).where("_kind = 1")
    return found.select(doc, "_row.*", F.col("_page").alias(page))


def preview(items: Column, n: int = 50) -> Column:
    """The first n of an array, and whether there are more."""
    return F.struct(F.slice(items, 1, n).alias("items"), (F.size(items) > n).alias("truncated"))


def records_window(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n records of each group, with the group's count and whether some are left out."""
    counts = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("record_count"))
    w = Window.partitionBy(group).orderBy(*order)
    first = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return first.join(counts, F.col(group) == F.col("_g")).drop("_g").withColumn("truncated", F.col("record_count") > n)


def next_cursor(offset: int, limit: int, returned: Column, has_next: Column) -> Column:
    """(by_limit, by_rows): the next page's offset, as the two lists count it; null on the last page."""
    return F.struct(F.when(has_next, F.lit(offset + limit)).alias("by_limit"), F.when(has_next, offset + returned).alias("by_rows"))


def column_named(df: DataFrame, name: Column) -> Column:
    """The value of the column that `name` names in each row, as text; null for a name that no column has."""
    return F.try_element_at(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]), name)


def distinct_joined(*lists: Column) -> Column:
    """Several lists as one, each value where it first stands."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def graph_of_collection(edges: DataFrame, nodes: DataFrame, collections: str, wanted: str, node: str = "id", source: str = "source", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """The edges that belong to a collection, and the nodes that they touch."""
    kept = edges.where(F.array_contains(collections, wanted))
    ends = kept.select(F.explode(F.array(source, target)).alias(node)).distinct()
    return kept, nodes.join(ends, node, "left_semi")
