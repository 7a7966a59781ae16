"""Records: projections behind a licence gate, search, pages, envelopes, families and clusters."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import fingerprint, level, short_hash

# Rights that clear a full text; the number of family colours.
CLEARED, COLOURS = ("cleared", "public-domain", "editorially-cleared"), 5


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(f"v1:{offset}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    """0 for anything that is no cursor."""
    try:
        raw = base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)).decode()
        return max(0, int(raw.removeprefix("v1:"))) if raw.startswith("v1:") else 0
    except ValueError:
        return 0


def gate(df: DataFrame, registry: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df with each field null unless its source's rights are cleared and list it; text_withheld says if any is not."""
    reg = registry.select(F.col("key").alias("_ts_key"), F.col("rights").isin(*CLEARED).alias("_ts_ok"), F.col("fields").alias("_ts_fields"))
    met = df.join(reg, F.col(key) == F.col("_ts_key"), "left")
    shown = {f: F.coalesce(F.col("_ts_ok") & F.array_contains("_ts_fields", f), F.lit(False)) for f in fields}
    all_ = F.forall(F.array(*shown.values()), lambda x: x)
    return met.select(*[F.when(shown[c], F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns], (~all_).alias("text_withheld"))


def search_substring(df: DataFrame, haystack: Column, query: str) -> DataFrame:
    """Rows whose normalized haystack has the normalized query; an empty query matches all."""
    return df.where(F.contains(haystack, F.lit(query)))


def search_phrase(df: DataFrame, haystack: Column, phrase: str) -> DataFrame:
    """Rows that have the words of the phrase one after the other, whole."""
    plain = F.concat(F.lit(" "), F.regexp_replace(haystack, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return df.where(F.contains(plain, F.lit(f" {phrase} ")))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page and, by has_next, whether another follows."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    n = F.count("*").over(Window.partitionBy())
    return rows.withColumn("has_next", n > limit).orderBy(*order).limit(limit)


def envelope(df: DataFrame, confidence: str, groups: list[str]) -> DataFrame:
    """Of each group: rows, the weakest confidence to three places and its level."""
    out = df.groupBy(*groups).agg(F.count("*").alias("n_rows"), F.round(F.min(confidence), 3).alias("confidence"))
    return out.withColumn("level", level(F.col("confidence")))


def families(df: DataFrame, cluster: str, text: Column, order: str) -> DataFrame:
    """(cluster, family, first, n, colour): families by their text, in first-seen order."""
    f = df.select(F.col(cluster).alias("cluster"), short_hash(text).alias("family"), F.col(order).alias("o")).groupBy("cluster", "family").agg(F.min("o").alias("first_id"), F.count("*").alias("n"))
    return f.withColumn("colour", (F.dense_rank().over(Window.partitionBy("cluster").orderBy("first_id")) - 1) % COLOURS)


def clusters(df: DataFrame, text: str, order: str) -> DataFrame:
    return df.groupBy(F.concat(F.lit("HCL-"), fingerprint(F.col(text))).alias("cluster")).agg(F.count("*").alias("n"), F.min(order).alias("first_id"))


def coverage(df: DataFrame, groups: list[str], state: Column) -> DataFrame:
    """Rows of each group, how many are covered, and the share in per cent to one place."""
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(state).alias("n_covered")).withColumn("percent", F.round(100.0 * F.col("n_covered") / F.col("n"), 1))


#: What an allow-list's label opens of a registry entry; phrases take a cleared source as well.
ENTRY_LABELS = {
    "entry_number": ["number"], "name_surface": ["name"], "date_assertions": ["death", "birth", "dates"], "source_pointer": ["volume", "page"], "critic_ranks": ["grade", "second_grade"], "criticism_references": ["criticisms"],
    "biographical_fields": ["long_name", "kunya", "nisbas", "laqab", "region", "generation", "metadata", "residences", "travels", "deaths", "births", "relations", "creed"], "teacher_student_phrases": ["teacher_phrase", "student_phrase"],
}
PHRASES = "teacher_student_phrases"


def public_entries(entries: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """entries as they may be shown: columns of a label that the source's list has not are null, phrases also where the source
    is not cleared; text_withheld says so. Columns that no label names stay. registry: key, rights, fields."""
    r = F.broadcast(registry.select(F.col("key").alias("_key"), F.col("rights").alias("_rights"), F.col("fields").alias("_fields")))
    label = {c: k for k, cs in ENTRY_LABELS.items() for c in cs}
    cleared = F.coalesce(F.col("_rights").isin(*CLEARED), F.lit(False))
    has = lambda k: F.coalesce(F.array_contains("_fields", k), F.lit(False)) & (cleared if k == PHRASES else F.lit(True))
    out = entries.join(r, F.col(key) == F.col("_key"), "left")
    shown = [F.when(has(label[c]), F.col(c)).alias(c) if c in label else F.col(c) for c in entries.columns]
    return out.select(*shown, (~has(PHRASES)).alias("text_withheld"), (has("criticism_references") & ~cleared).alias("criticisms_withheld"))
