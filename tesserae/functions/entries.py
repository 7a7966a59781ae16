"""Fields of registry entries: metadata lines, mapped bytes, date candidates, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"
#: Qualifiers that bound a year instead of naming it.
BOUNDING = ["بعد", "قبل", "قبيل", "بعيد", "نحو", "حدود", "قريبا من", "الي", "نيف", "بضع", "بضعه", "range", "reported-variant"]


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def metadata_fields(text: Column) -> Column:
    """`key: value` lines as a map of each key to its values in order. Lines without a key or value are left out; null has none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), _trim)
    pairs = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 1), lambda x: F.struct(_trim(F.substring_index(x, ":", 1)).alias("k"), _trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    pairs = F.filter(pairs, lambda p: p["v"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def decode_bytes(blob: Column, mapping: dict[int, str]) -> Column:
    """Bytes by a table; an unknown byte stays as [hex]. Trimmed; null gives the empty text."""
    known = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (f"{k:02x}", v)])
    codes = F.regexp_extract_all(F.lower(F.hex(blob)), F.lit("(..)"), 1)
    return F.coalesce(_trim(F.array_join(F.transform(codes, lambda c: F.coalesce(F.try_element_at(known, c), F.concat(F.lit("["), c, F.lit("]")))), "")), F.lit(""))


def date_candidates(assertions: Column, bounding: list[str] | None = None) -> Column:
    """(death_year, death_bound, birth_year) of assertions array<struct<kind, value_ah, explicit, shared, approximate, qualifier>>.

    Only years whose century is written count, in the order of the text; a bound or an approximation is never a year of death."""
    bound = lambda a: F.coalesce(a["qualifier"].isin(bounding or BOUNDING), F.lit(False))
    first = lambda kind, more: F.get(F.filter(assertions, lambda a: (a["kind"] == kind) & (a["explicit"] | a["shared"]) & more(a)), F.lit(0))
    return F.struct(
        first("death", lambda a: ~a["approximate"] & ~bound(a))["value_ah"].alias("death_year"),
        first("death", bound)["value_ah"].alias("death_bound"),
        first("birth", lambda a: F.lit(True))["value_ah"].alias("birth_year"),
    )


def entry_confidence(head: Column, has_death: Column, has_level: Column, has_teachers: Column) -> Column:
    """0.35 and 0.3 of the head's confidence, with 0.1 for a year of death, 0.07 for a level, 0.05 for teachers."""
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.round(0.35 + 0.3 * head + part(has_death, 0.1) + part(has_level, 0.07) + part(has_teachers, 0.05), 3)
