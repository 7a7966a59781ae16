"""Identifiers: buckets of names, canonical keys, seeded numbers, fallback colours, parameters."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalars import level, normalize, short_hash, stable_key

# Words that name someone only by the narrator before; prefixes of identifiers; colours of families.
RELATIVE_WORDS = ["أبيه", "عمه", "أخيه", "جده", "أمه", "امه", "ابنه", "بنته", "جدته", "زوجته", "خاله", "خالته", "عمته", "أخته", "اخته", "جدها"]
BUCKET, RELATIVE_BUCKET, PERSON = "UNC-", "UNC-REL-", "SA-P-"
COLOURS = ["teal", "clay", "gold", "ink", "sage"]
#: Levels that an occurrence's status may have.
LEVELS = ["verified", "high", "medium", "low", "unresolved", "conflict"]
_LOW = 0xFFFFFFFF


def relative_words() -> Column:
    return F.transform(F.array(*[F.lit(w) for w in RELATIVE_WORDS]), normalize)


def is_relative(form: Column, words: list[str] | None = None) -> Column:
    """Whether a name has a word that means someone only by his place in a chain. Null has none."""
    known = ["ابيه", "عمه", "اخيه", "جده", "امه", "ابنه", "بنته", "جدته", "زوجته", "خاله", "خالته", "عمته", "اخته", "جدها"] if words is None else words
    return F.arrays_overlap(F.split(normalize(form), " "), F.array(*[F.lit(w) for w in known]))


def bucket_id(record: Column, chain_order: Column, position: Column, form: Column) -> Column:
    """One bucket for each name; an empty or relative one has a bucket of its own place."""
    n = normalize(form)
    own = F.concat_ws(":", record, chain_order.cast("string"), position.cast("string"), n)
    return F.when((n == "") | is_relative(form), F.concat(F.lit(RELATIVE_BUCKET), short_hash(own))).otherwise(F.concat(F.lit(BUCKET), short_hash(n)))


def cluster_of_name(form: Column) -> Column:
    """The bucket of a name, null for an empty or relative one."""
    n = normalize(form)
    return F.when((n != "") & ~is_relative(form), F.concat(F.lit(BUCKET), short_hash(n)))


def person_key(seed: Column, collision: Column | None = None) -> Column:
    """The canonical key of an identity; collisions above 0 go into the seed."""
    c = F.lit(0) if collision is None else collision
    return F.when((seed.isNotNull()) & (seed != ""), stable_key(PERSON, F.when(c > 0, F.concat(seed, F.lit("#"), c.cast("string"))).otherwise(seed)))


def person_key_of_cluster(cluster: Column, homonym: Column | None = None) -> Column:
    """The canonical key of a bucket of names; null for what is none, and for relative ones."""
    return F.when(F.coalesce(cluster.rlike("^UNC-[0-9a-f]{12}$"), F.lit(False)), person_key(cluster, homonym))


def id_kind(x: Column) -> Column:
    """canonical, relative, cluster or unknown."""
    return F.when(x.rlike("^SA-P-[A-Z2-7]{8}$"), "canonical").when(x.rlike("^UNC-REL-[0-9a-f]{12}$"), "relative").when(x.rlike("^UNC-[0-9a-f]{12}$"), "cluster").otherwise("unknown")


def occurrence_status(status: Column) -> Column:
    """Of an importer's status: a level stays, relative forms, the prophet's mentions and unknown ones are unresolved."""
    return F.when(status.isin(LEVELS), status).otherwise("unresolved")


def level_matches(lvl: Column, score: Column) -> Column:
    """Whether a level is the one its score calls for; without a score, and for levels that no score gives, it always is."""
    return score.isNull() | ~lvl.isin("high", "medium", "low") | (level(score) == lvl)


def shortened(x: Column, n: int = 8) -> Column:
    return F.substring(x, 1, n)


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits."""
    high = F.shiftleft(F.shiftright(a, 16) * b % (1 << 16), 16)
    return (a.bitwiseAND(F.lit(0xFFFF)) * b + high).bitwiseAND(F.lit(_LOW))


def text_seed(text: Column) -> Column:
    """A 32-bit hash of a text's characters, by xor and multiplication (FNV-1a)."""
    step = lambda h, c: _times(h.bitwiseXOR(F.ascii(c).cast("long")), F.lit(0x01000193).cast("long"))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0x811C9DC5).cast("long"), step)


def nth_random(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) in [0, 1) of the generator mulberry32; it counts its state up, so any number is direct."""
    s = (seed + _times(n.cast("long"), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(F.lit(_LOW))
    a = _times(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1).cast("long")))
    b = a.bitwiseXOR((a + _times(a.bitwiseXOR(F.shiftrightunsigned(a, 7)), a.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(F.lit(_LOW)))
    return b.bitwiseXOR(F.shiftrightunsigned(b, 14)) / F.lit(4294967296.0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _swapped(items: pd.Series, numbers: pd.Series) -> pd.Series:
    def one(xs: list[str], r: list[float]) -> list[str]:
        xs = list(xs)
        for k, u in zip(range(len(xs) - 1, 0, -1), r, strict=False):
            j = int(u * (k + 1))
            xs[k], xs[j] = xs[j], xs[k]
        return xs

    return pd.Series([one(x, r) for x, r in zip(items, numbers, strict=True)])


def shuffled(items: Column, seed: Column) -> Column:
    """An array of strings, in an order that the seed fixes, by swaps from the end. For frames of a bounded size."""
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), lambda n: nth_random(text_seed(seed), n))
    return _swapped(items, numbers)


def frame_digest(ids: Column) -> Column:
    """Of the ids of a frame in their order, a line each."""
    return F.substring(F.sha2(F.array_join(ids, "\n"), 256), 1, 32)


def colour_of(name: Column) -> Column:
    """A colour for a name that has none: its characters by 31 in 32 bits, modulo the colours."""
    h = F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(F.lit(_LOW)))
    return F.get(F.array(*[F.lit(c) for c in COLOURS]), (h % len(COLOURS)).cast("int"))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """A JSON text with sorted keys and without blanks; null for what is none."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def parse_or_keep(text: Column) -> Column:
    """A stored JSON text in canonical form, or as it is."""
    return F.coalesce(canonical_json(text), text)


def first_value(fields: Column, keys: list[str]) -> Column:
    """Of a map of lists, the first value under the first of the keys that has one."""
    return F.coalesce(*[F.get(F.try_element_at(fields, F.lit(k)), F.lit(0)) for k in keys])


def clamp_int(text: Column, least: int, most: int, default: int) -> Column:
    """A parameter as a whole number between bounds; the default for what is none."""
    n = text.try_cast("int")
    return F.when(n.isNull(), default).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), n)))


def one_of(text: Column, known: list[str]) -> Column:
    return F.when(text.isin(known), text)


def cut_query(text: Column, n: int = 240) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def timeline_domain(years: Column, pad: int = 10, tick: int = 25) -> Column:
    """(first, last, ticks) of an array of years: the decades around them, and every `tick` years from the first. Without
    years: around 0 and 250."""
    least, most = F.coalesce(F.array_min(years), F.lit(0)), F.coalesce(F.array_max(years), F.lit(250))
    lo, hi = F.floor((least - pad) / 10).cast("int") * 10, F.ceil((most + pad) / 10).cast("int") * 10
    return F.struct(lo.alias("first"), hi.alias("last"), F.sequence(lo, hi, F.lit(tick)).alias("ticks"))
