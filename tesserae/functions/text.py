"""Text functions of the importer: digits, years, tokens, places, markup, surface features, word differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalars import normalize, normalize_each

# Qualifiers of a year, in the order in which they are looked for.
QUALIFIERS = {"قبيل": "shortly_before", "بعد": "after", "قبل": "before", "نحو": "circa", "حدود": "circa", "زهاء": "circa"}
# The largest year, and connectors of a reported and of an alternative year.
LAST_YEAR, REPORTED, ALTERNATIVE = 1100, "ق(?:ي|ِي)ل", "أو|او"
# Kinds of a section, by words of its normalized heading.
SECTIONS = {"hearing_evidence": "اثبات سماع|السماع", "disconnection": "الارسال|الانقطاع|لم يسمع|لم يدرك", "comparison": "المفاضله|مقارنه", "other": "التدليس|الاختلاط|البدعه|الصحبه|الادراك"}


#: Lengths that are summed in one block.
BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(lengths: Column) -> Column:
    """Where pieces of these lengths begin that follow each other. Sums are made in blocks, each from the totals of those before."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def of(ls: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / BLOCK).cast("int")), lambda k: F.slice(ls, k * BLOCK + 1, BLOCK))
        return let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda b, k: let(total(F.slice(sums, 1, k)), lambda o: F.transform(b, lambda x, i: o + total(F.slice(b, 1, i)))))))

    return let(lengths, lambda ls: F.when(F.size(ls) > 0, of(ls)).otherwise(F.array().cast("array<int>")))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def first_year(text: Column) -> Column:
    """The first run of one to four digits, null if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:^|\D)(\d{1,4})(?=\D|$)", 1).try_cast("int")


def year_phrases(phrase: Column) -> Column:
    """Every year 1 to 1100 of a phrase as (year, relation, qualifier, offset): the first is primary, later ones go by
    the words before them; equal ones count once. Null, or no year: an empty array."""
    t = ascii_digits(F.trim(F.coalesce(phrase, F.lit(""))))
    digits = F.regexp_extract_all(t, F.lit(r"(\d{1,4})"), F.lit(1))
    between = F.slice(F.split(t, r"\d{1,4}"), 1, F.size(digits))
    at = starts(F.zip_with(between, digits, lambda b, d: F.length(b) + F.length(d)))
    found = F.zip_with(F.arrays_zip(between.alias("b"), digits.alias("d")), at, lambda x, o: F.struct(x["b"].alias("before"), x["d"].cast("int").alias("year"), (o + F.length(x["b"])).alias("offset")))
    years = F.filter(found, lambda x: x["year"].between(1, LAST_YEAR))

    def qualifier(words: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(words, F.lit(w)), code) for w, code in QUALIFIERS.items()])

    def assertion(x: Column, i: Column) -> Column:
        relation = F.when(i == 0, "primary").when(F.regexp_like(x["before"], F.lit(REPORTED)), "reported").when(F.regexp_like(x["before"], F.lit(ALTERNATIVE)), "alternative").otherwise("additional")
        words = F.when(i == 0, F.substring(t, F.lit(1), x["offset"])).otherwise(x["before"])
        return F.struct(x["year"].alias("year"), relation.alias("relation"), qualifier(words).alias("qualifier"), x["offset"].alias("offset"))

    # equal ones side by side, the first of each, and back in the text's order
    said = F.array_sort(F.transform(F.transform(years, assertion), lambda x: F.struct(F.struct(x["year"], x["relation"], F.coalesce(x["qualifier"], F.lit(""))).alias("key"), x["offset"].alias("offset"), x.alias("x"))))
    first = let(said, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["key"] != x["key"])))
    return F.transform(F.array_sort(F.transform(first, lambda y: F.struct(y["offset"].alias("offset"), y["x"].alias("x")))), lambda y: y["x"])


def span_integrity(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit("[<>⦗⦘]")), "contains-markup").otherwise("verbatim")


def strip_markup(raw: Column) -> Column:
    """Text without tags (span tags leave nothing, others a space), bracketed remarks, carriage returns and hard
    spaces; runs of blanks become one, of newlines at most two. An unclosed < stays."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r|&nbsp;|⦗[^⦘]*⦘|(?i:</?span[^>]*>)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"[ \t]+", " "), r"\n{3,}", "\n\n")


def title_spans(raw: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"""(?is)<span[^>]*data-type\s*=\s*["']?title[^>]*>(.*?)</span>"""), F.lit(1))


def trim_head(text: Column) -> Column:
    """A name's head without marks at its edges."""
    return F.regexp_replace(text, r"^[ .،؛:\-()\[\]]+|[ .،؛:\-()\[\]]+$", "")


def tokens_of(normalized: Column, trim: str = "،؛,.:()[]«»\"'", particles: tuple[str, ...] = ()) -> Column:
    """Words of a normalized text without marks at their edges, ornaments and leading particles."""
    words = F.filter(F.transform(F.split(normalized, " "), lambda w: F.btrim(w, F.lit(trim))), lambda w: (w != "") & ~F.regexp_like(w, F.lit("^[﴾-﷿]+$")))
    if not particles:
        return words
    other = F.array_position(F.transform(words, lambda w: ~w.isin(*particles)), True)
    return F.when(other == 0, F.slice(words, 1, 0)).otherwise(F.slice(words, F.greatest(other, F.lit(1)).cast("int"), F.size(words)))


def surface_tokens(text: Column, trim: str = "،؛,.:()[]«»\"'", particles: tuple[str, ...] = ()) -> Column:
    return tokens_of(normalize(text), trim, particles)


def places(text: Column) -> Column:
    """Names between commas or colons, each once, in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[،,:]"), lambda p: F.trim(p)), lambda p: p != ""))


def section_kind(heading: Column) -> Column:
    n = normalize(heading)
    return F.coalesce(*[F.when(F.regexp_like(n, F.lit(words)), kind) for kind, words in SECTIONS.items()], F.lit("critic"))


def length_band(text: Column, bounds: list[int]) -> Column:
    n, out = F.length(F.trim(text)), F.lit(f"L{len(bounds)}")
    for k in reversed(range(len(bounds))):
        out = F.when(n <= bounds[k], f"L{k}").otherwise(out)
    return out


# Words that begin a name by a child, and the ends of a name by a place or tribe.
KUNYA, NISBA_ENDS = ["ابو", "ابي", "ابى", "ابا", "ام"], ["ي", "ية", "يه"]


def has_kunya(form: Column) -> Column:
    """Whether a form of several words begins with a word of a kunya."""
    w = F.split(F.trim(form), r"\s+")
    return (F.size(w) > 1) & F.get(w, F.lit(0)).isin(*KUNYA)


def has_nisba(form: Column) -> Column:
    """Whether a word has the article, an end of a nisba, and two letters at least between them."""
    bare = lambda w: F.translate(w, "،.:؛()\"«»", "")

    def one(w: Column) -> Column:
        out = F.lit(False)
        for end in NISBA_ENDS:
            out = out | (F.endswith(w, F.lit(end)) & (F.length(w) >= 4 + len(end)))
        return F.startswith(w, F.lit("ال")) & out

    return F.exists(F.transform(F.split(form, r"\s+"), bare), one)


def _alignment(x: np.ndarray, y: np.ndarray, block: int = 256) -> list[tuple[int, int]]:
    """Pairs of equal words of a longest common subsequence, words of y passed over first where either would do. The table's rows
    are kept every `block` words and made again between them, so memory grows with the root of the table, not with it."""

    def above(i: int, row: np.ndarray) -> np.ndarray:
        best = np.maximum(row[:-1], np.where(y == x[i], row[1:] + 1, 0))
        return np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(np.int32)

    row, kept = np.zeros(len(y) + 1, np.int32), {}
    for i in range(len(x), -1, -1):
        if i < len(x):
            row = above(i, row)
        if i % block == 0 or i == len(x):
            kept[i] = row
    pairs, j = [], 0
    for lo in range(0, len(x), block):
        hi = min(lo + block, len(x))
        rows = [kept[hi]]
        for i in range(hi - 1, lo - 1, -1):
            rows.append(above(i, rows[-1]))
        rows.reverse()
        for i in range(lo, hi):
            here, under = rows[i - lo], rows[i - lo + 1]
            while j < len(y) and y[j] != x[i] and here[j + 1] >= under[j]:
                j += 1
            if j < len(y) and y[j] == x[i]:
                pairs.append((i, j))
                j += 1
    return pairs


def _difference(a: list[str], b: list[str], shown_a: list[str] | None = None, shown_b: list[str] | None = None) -> list[tuple[str, str, str]]:
    """Steps from one row of words to the other: runs of equal words, and what stands between them, as one step each."""
    shown_a, shown_b = shown_a or a, shown_b or b
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in ws], np.int64) for ws in (a, b))
    in_a, in_b, out, i, j, run = set(a), set(b), [], 0, 0, []

    def close() -> None:
        if run:
            out.append(("equal", " ".join(shown_a[k] for k, _ in run), " ".join(shown_b[k] for _, k in run)))
            run.clear()

    for k, n in [*_alignment(x, y), (len(a), len(b))]:
        left, right = a[i:k], b[j:n]
        if left or right:
            close()
            kind = "replacement" if left and right else "omission" if left else "addition"
            out.append(("reorder" if in_b.issuperset(left) and in_a.issuperset(right) else kind, " ".join(shown_a[i:k]), " ".join(shown_b[j:n])))
        run.append((k, n))
        i, j = k + 1, n + 1
    run.pop()
    close()
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("kind", "before", "after")])))
def _steps(a: pd.Series, b: pd.Series, shown_a: pd.Series, shown_b: pd.Series) -> pd.Series:
    none = lambda w: [] if w is None else list(w)
    rows = zip(*(map(none, c) for c in (a, b, shown_a, shown_b)), strict=True)
    return pd.Series([[dict(zip(("kind", "before", "after"), s, strict=True)) for s in _difference(*r)] for r in rows])


def word_difference(a: Column, b: Column) -> Column:
    """Steps from one text to another by their words (runs of letters, marks and digits), compared in the search form and given
    as they stand: equal, addition, omission, replacement or reorder (words that the other text has elsewhere)."""
    words = lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    return _steps(normalize_each(words(a)), normalize_each(words(b)), words(a), words(b))
