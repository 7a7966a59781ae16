"""Places of pattern matches as DataFrame expressions.

Spark gives a pattern's matches and, by split, what stands between them, but not their places; running sums of both
lengths give those, in code points. The sums are made in blocks of `BLOCK` matches, each from the totals of the blocks
before it, so that a text with hundreds of thousands of matches takes time in proportion. Patterns take possessive loops
where nothing can follow that needs a step back, so that a run of any length neither overflows the matcher's stack nor
takes quadratic time; `\\G` lets a match begin where the last one ended. They find what the plain patterns find
(tests/llm compares with another matcher).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,k:int,e:int,t:string>"
#: The same with up to `AROUND` characters before and after, no further than the neighbouring matches reach.
PLACED = "struct<s:int,k:int,e:int,t:string,before:string,after:string>"
BLOCK, AROUND = 256, 16


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str, kind: int, valid=None, around: bool = False, needs: list[str] | None = None) -> Column:
    """Structs (s start, k kind, e end, t text) of the matches of a non-null text that `valid` (a function of t) holds for.
    needs: strings one of which every match holds; texts without them are not searched."""
    shape = PLACED if around else SPAN
    none = F.array().cast(f"array<{shape}>")

    def struct(o: Column, x: Column) -> Column:
        s = o + x["g"]
        out = [s.alias("s"), F.lit(kind).alias("k"), (s + x["l"]).alias("e"), x["t"].alias("t")]
        return F.struct(*out, x["before"].alias("before"), x["after"].alias("after")) if around else F.struct(*out)

    def cut(m: Column, b: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            parts = [F.length(F.get(b, i)).alias("g"), F.length(t).alias("l"), t.alias("t")]
            if around:
                before = F.concat(F.when(i > 0, F.substring(F.get(m, i - 1), -AROUND, AROUND)).otherwise(""), F.substring(F.get(b, i), -AROUND, AROUND))
                after = F.concat(F.substring(F.get(b, i + 1), 1, AROUND), F.coalesce(F.substring(F.get(m, i + 1), 1, AROUND), F.lit("")))
                parts += [F.substring(before, -AROUND, AROUND).alias("before"), F.substring(after, 1, AROUND).alias("after")]
            return F.struct(*parts)

        return F.transform(m, one)

    def placed(w: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda k: F.slice(w, k * BLOCK + 1, BLOCK))
        total = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + y["g"] + y["l"])
        start = lambda o: F.struct(o.alias("o"), none.alias("x"))
        step = lambda acc, x: F.struct((acc["o"] + x["g"] + x["l"]).alias("o"), F.concat(acc["x"], F.array(struct(acc["o"], x))).alias("x"))
        run = lambda o, block: F.aggregate(block, start(o), step)["x"]
        several = let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda block, k: run(F.aggregate(F.slice(sums, 1, k), F.lit(0), lambda n, y: n + y), block))))
        return F.when(F.size(w) <= BLOCK, run(F.lit(0), w)).otherwise(several)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        has = text.contains(needs[0])
        for n in needs[1:]:
            has = has | text.contains(n)
        found = F.when(has, found).otherwise(F.array().cast("array<string>"))
    out = let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda b: let(cut(m, b), placed))))
    return out if valid is None else F.filter(out, lambda x: valid(x["t"]))


def listed(found: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda x: x["k"] == kind)).cast("long")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a sound check digit."""
    pos = F.sequence(F.lit(1), F.length(number))
    digit = lambda i: F.substring(number, F.length(number) + 1 - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    return F.aggregate(pos, F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0
