"""Names that mean someone only by his place in a chain: which word does so, where it stands, whom it hangs on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.scalars import normalize, normalize_each
from tesserae.functions.text import surface_tokens, tokens_of

# Words of kinship and of unnamed persons with kinship, kind, person, number, whether they hang on the
# narrator before, whether they name no one, and where they count (anywhere, at the head, alone).
TERMS = """
ابيه father father third single anchored named any
ابيها father father third single anchored named any
ابوه father father third single anchored named any
ابيهما father father third dual anchored named any
امه mother other third single anchored named any
امها mother other third single anchored named any
جده grandfather grandfather third single anchored named any
جدها grandfather grandfather third single anchored named any
جدته grandmother other third single anchored named any
جدتها grandmother other third single anchored named any
عمه uncle_paternal uncle third single anchored named any
عمها uncle_paternal uncle third single anchored named any
عماه uncle_paternal uncle third dual anchored named any
عمته aunt_paternal other third single anchored named any
خاله uncle_maternal uncle third single anchored named any
خالته aunt_maternal other third single anchored named any
اخيه brother brother third single anchored named any
اخيها brother brother third single anchored named any
اخته sister other third single anchored named any
اختها sister other third single anchored named any
ابنه son other third single anchored named any
ابنها son other third single anchored named any
بنته daughter other third single anchored named any
زوجته wife other third single anchored named any
زوجها husband other third single anchored named any
شيخه shaykh unnamed_shaykh third single anchored named any
صاحبه companion other third single anchored named any
ابي father father first single anchored named whole
اخي brother brother first single anchored named whole
عمي uncle_paternal uncle first single anchored named whole
جدي grandfather grandfather first single anchored named whole
رجل unnamed_man unnamed_man third single free anonymous head
امراه unnamed_woman other third single free anonymous head
شيخ unnamed_shaykh unnamed_shaykh third single free anonymous head
بعض_اصحابه unnamed_group other third dual anchored anonymous head
بعض_اصحاب unnamed_group other third dual free anonymous head
"""
# Particles before a form, marks at the edges of a word, words that a name's words leave out.
PARTICLES = ("عن", "و", "ف", "ثم", "لي", "له", "ولي", "وله")
MARKS = ".,:؛؟!()[]{}«»\"'-*،؍/\\"
NAME_STOPWORDS = ["بن", "ابن", "ابو", "ابي", "ابا", "بنت", "مولي", "مولاه", "مولاهم", "ال", "و", "عن", "ويقال"]


def _terms() -> Column:
    rows = [line.split() for line in TERMS.strip().splitlines()]
    lit = lambda r: F.struct(*[F.lit(x).alias(k) for k, x in zip(("kinship", "kind", "person", "arity"), r[1:5], strict=True)], F.lit(r[5] == "anchored").alias("anchored"), F.lit(r[6] == "anonymous").alias("anonymous"), F.lit(r[7]).alias("scope"))
    return F.create_map(*[x for r in rows for x in (F.lit(r[0].replace("_", " ")), lit(r))])


def form_tokens(surface: Column) -> Column:
    return surface_tokens(surface, MARKS, PARTICLES)


def _names(normalized: Column) -> Column:
    return F.filter(tokens_of(normalized, MARKS, PARTICLES), lambda w: ~w.isin(*NAME_STOPWORDS))


def name_tokens(surface: Column) -> Column:
    """The words of a name that tell it from others."""
    return _names(normalize(surface))


def name_tokens_each(surfaces: Column) -> Column:
    return F.transform(normalize_each(surfaces), _names)


def mention_bags(mentions: Column) -> Column:
    """Of each mention its words, and its first without a conjunction that may stand before it."""

    def bag(w: Column) -> Column:
        first = F.get(w, F.lit(0))
        return F.when(F.startswith(first, F.lit("و")) & (F.length(first) >= 4), F.concat(w, F.array(F.substring(first, 2, 1000)))).otherwise(w)

    return F.transform(name_tokens_each(mentions), bag)


def analysis(surface: Column) -> Column:
    """(relative, match, term, kinship, kind, person, arity, anchored, anonymous, unresolvable, rest): the earliest relative
    word of a form, the longer one at the same place; where it stands (whole, leading-apposition, trailing, internal);
    and the form without it, empty where no person can be named by it. Null is an empty form."""
    terms = _terms()

    def of(ws: Column) -> Column:
        n = F.size(ws)

        def at(i: Column) -> Column:
            def hit(length: int) -> Column:
                term = F.array_join(F.slice(ws, i + 1, length), " ")
                t = F.try_element_at(terms, F.when(i + length <= n, term).otherwise(""))
                fits = (t["scope"] == "any") | ((t["scope"] == "head") & (i == 0)) | ((t["scope"] == "whole") & (i == 0) & (n == length))
                return F.when(t.isNotNull() & fits, F.struct(i.alias("at"), F.lit(length).alias("length"), term.alias("term"), t.alias("t")))

            return F.coalesce(hit(2), hit(1))

        first = F.get(F.filter(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), at), lambda x: x.isNotNull()), F.lit(0))
        found = lambda x: F.struct(
            x.isNotNull().alias("relative"),
            F.when(x.isNull(), "none").when(n == x["length"], "whole").when(x["at"] == 0, "leading-apposition").when(x["at"] + x["length"] == n, "trailing").otherwise("internal").alias("match"),
            x["term"].alias("term"), *[x["t"][k].alias(k) for k in ("kinship", "kind", "person", "arity", "anchored", "anonymous")],
            F.coalesce((n == x["length"]) | x["t"]["anonymous"], F.lit(False)).alias("unresolvable"),
            F.when(x.isNull(), F.array_join(ws, " ")).when((n == x["length"]) | x["t"]["anonymous"], "").otherwise(F.array_join(F.filter(ws, lambda w, i: (i < x["at"]) | (i >= x["at"] + x["length"])), " ")).alias("rest"),
        )
        return F.element_at(F.transform(F.array(first), found), 1)

    return F.element_at(F.transform(F.array(form_tokens(F.coalesce(surface, F.lit("")))), of), 1)


def resolution(a: Column, position: Column) -> Column:
    """(anchor, anchor_position, complete, reason) of an analysed form at a place in its chain; null where it is not relative.
    It hangs on the narrator before; at the first place that one is outside the chain."""
    anchor = F.when(~a["anchored"], "none").when(position > 0, "citing-narrator").otherwise("collector-outside-chain")
    reason = F.when(~a["anchored"], "anonymous-surface-no-anchor").when(position <= 0, "relative-anchor-outside-chain").when(a["unresolvable"], "relative-anchored-unnamed").otherwise("relative-anchored-named-apposition")
    return F.when(a["relative"], F.struct(anchor.alias("anchor"), F.when(anchor == "citing-narrator", position - 1).alias("anchor_position"), (a["arity"] == "single").alias("complete"), reason.alias("reason")))


def form_of(surface: Column, a: Column) -> Column:
    """What a name is looked up by: its normalized form, of a relative one the rest; null where nothing is left."""
    n = F.when(a["relative"], a["rest"]).otherwise(normalize(surface))
    return F.when(n != "", n)
