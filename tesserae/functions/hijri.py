"""Years in number words, and what a normalized text says of births and deaths.

A text is cut into words with their places once. A number phrase is read from a place on; anchors (the word year, a
bounding word, a range) say where one may begin, and a trigger verb opens a stretch in which the first anchor with a
number counts. Nothing is averaged, no century is guessed, and no birth follows from a death.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalars import BOOLEAN, DOUBLE, INT, STRING, struct_of

# Words of units, tens and hundreds in the search form, words of an open amount, the article.
UNITS = {1: "واحد واحده احدي احد احدا", 2: "اثنتين اثنين ثنتين اثنتي اثني ثنتي اثنتان اثنان", 3: "ثلاث ثلاثه ثلاثا", 4: "اربع اربعه اربعا", 5: "خمس خمسه خمسا", 6: "ست سته ستا", 7: "سبع سبعه سبعا", 8: "ثمان ثمانيه ثماني ثمانه ثمانيا", 9: "تسع تسعه تسعا"}
TENS = {10: "عشر عشره", 20: "عشرين عشرون", 30: "ثلاثين ثلاثون", 40: "اربعين اربعون", 50: "خمسين خمسون", 60: "ستين ستون", 70: "سبعين سبعون", 80: "ثمانين ثمانون", 90: "تسعين تسعون"}
HUNDREDS = {100: "مايه ميه مئه ماه", 200: "مايتين ميتين مئتين مايتي ميتي مئتي", 300: "ثلاثمايه ثلاثميه", 400: "اربعمايه اربعميه", 500: "خمسمايه خمسميه", 600: "ستمايه ستميه", 700: "سبعمايه سبعميه", 800: "ثمانمايه ثمانميه ثمانيمايه ثمانيميه", 900: "تسعمايه تسعميه"}
OPEN = set("بضع بضعه نيف نيفا كسر وكسر".split())
# Verbs of an event, from which a date is read; words that bound or blur a year; words of a duration.
VERBS = {
    "death": ["ماتت", "ماتا", "مات", "توفيت", "توفيا", "توفي", "توفاه الله", "وفاته", "وفاتها", "وفاتهما", "الوفاه", "موته", "موتها", "مقتله", "المتوفي", "استشهد", "استشهدت", "قتلته", "قتله", "قتلت", "قتلوه", "قتل", "هلك", "هلكت"],
    "birth": ["ولدت", "ولد", "مولده", "مولدها", "مولد"],
    "alive_in": ["كان حيا", "بقي الي", "بقي", "عاش الي"],
    "burial": ["دفن"],
}
QUALIFIERS = ["بعد", "قبل", "قبيل", "بعيد", "نحو", "حدود", "قريبا من", "في اول", "في اخر", "اول", "اخر"]
BOUNDS = ["بعد", "قبل", "قبيل", "بعيد", "نحو", "حدود", "قريبا من", "نيف", "بضع", "بضعه", "الي"]
DURATIONS = "سنه|سنين|سنوات|اشهر|شهرا|شهر|يوما|يوم|ليله"
LAST, STRETCH, APPROXIMATE = 1100, 140, "نحو"

_VALUES = {w: (kind, n) for kind, table in (("unit", UNITS), ("ten", TENS), ("hundred", HUNDREDS)) for n, ws in table.items() for w in ws.split()}
_KIND = {v: k for k, vs in VERBS.items() for v in vs}
_any = lambda words: "|".join(sorted(words, key=len, reverse=True))
_TRIGGER = re.compile(rf"(?:^|(?<=[\s،؛:.()\[\]«»\"]))و?({_any(_KIND)})(?![ء-ي])")
_YEAR = re.compile(r"(?:^|[\s،؛:\[\]])(?:في\s+)?(?:سنه|عام)\s*\(?\s*")
_BOUND = re.compile(rf"(?:^|[\s،؛:])(?:في\s+)?({_any(BOUNDS)})\s+(?:و?سنه\s+)?")
_FROM, _TO = re.compile(r"(?:^|[\s،؛:])(?:ما\s+)?(?:بين|من)\s+"), re.compile(r"[\s،؛]*(?:الي|و|ثم)\s+(?:سنه\s+)?")
_OTHER = re.compile(r"[\s،؛]*(او|وقيل|ويقال)\s*(?:(?:في\s+)?(سنه|عام))?\s*")
_QUALIFIER = re.compile(rf"(?:^|\s)({_any(QUALIFIERS)})(?:\s|$)")
_LASTS = re.compile(rf"\s*(?:{DURATIONS})(?![ء-ي])")
_DIGITS, _WORD, _STOP = re.compile(r"[٠-٩0-9]{2,4}(?![٠-٩0-9])"), re.compile(r"[^\s،؛:.()\"«»\[\]]+"), re.compile(r"[.؟!]|_{3,}")
_AGE = re.compile(r"(?:^|\s)(?:وله|وهو ابن|بلغ|عاش|وعاش|وقد بلغ)\s+([^\s]{2,14}(?:\s+و[^\s]{2,14})?)\s+سنه(?:\s|$|[.،؛])")
_ASCII = str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")


def _meaning(word: str) -> tuple[str, int] | None:
    return _VALUES.get(word) or (_VALUES.get(word[2:]) if word.startswith("ال") else None)


def number(words: list[str]) -> dict | None:
    """The number that words begin with: value, whether its hundreds are named, words used, whether it is open. A word with
    the conjunction adds; a unit of three or more before a bare hundred multiplies it."""
    got, named, loose, used, i = {"unit": 0, "ten": 0, "hundred": 0}, False, False, 0, 0
    bare = lambda k: words[k][1:] if words[k].startswith("و") and words[k] != "و" else words[k]
    seen = False
    while i < len(words):
        w = bare(i)
        if w in ("و", ""):
            used += i == used
            i += 1
            continue
        if w in OPEN or w.startswith("ال") and w[2:] in OPEN:
            loose = seen = True
            i += 1
            used = i
            continue
        kind, n = _meaning(w) or ("", 0)
        after = bare(i + 1) if i + 1 < len(words) else ""
        if kind == "unit" and after in ("عشر", "عشره", "العشر"):
            got["unit"], got["ten"], step = n, 10, 2
        elif kind == "unit" and n >= 3 and _meaning(after) == ("hundred", 100) and not words[i + 1].startswith("و"):
            got["hundred"], named, step = got["hundred"] + 100 * n, True, 2
        elif kind == "hundred":
            got["hundred"], named, step = got["hundred"] + n, True, 1
        elif kind == "unit" and not got["unit"] or kind == "ten" and got["ten"] in (0, 10):
            got[kind], step = n, 1
        else:
            break
        seen, i = True, i + step
        used = i
    value = sum(got.values())
    if not seen or not 1 <= value <= LAST or loose and value < 10:
        return None
    return {"value": value, "explicit": named, "used": used, "open": loose}


def year_at(text: str) -> dict | None:
    """The year that a text begins with, in digits or words; an amount of years, months or days is none."""
    if (m := _DIGITS.match(text)) and 1 <= (v := int(m[0].translate(_ASCII))) <= LAST and not _LASTS.match(text, m.end()):
        return {"value": v, "explicit": v >= 100, "open": False, "phrase": m[0], "end": m.end(), "from": None}
    spans = []
    for m in _WORD.finditer(text):
        spans.append(m)
        if len(spans) == 8:
            break
    n = number([m[0] for m in spans])
    if not n:
        return None
    end = spans[n["used"] - 1].end()
    if _LASTS.match(text, end):
        return None
    return {"value": n["value"], "explicit": n["explicit"], "open": n["open"], "phrase": " ".join(m[0] for m in spans[: n["used"]]), "end": end, "from": None}


def completed(year: dict, by: dict | None, tail: bool) -> dict:
    """year with what another reading of the same phrase names for both: its hundreds, and with `tail` the tens of a bare unit.
    A year with tens of its own takes hundreds only (with `tail`: if the tens agree)."""
    if not by or not by["explicit"] or year["explicit"] or year["value"] >= 100 or tail and year["open"]:
        return year
    hundreds, rest = by["value"] - by["value"] % 100, by["value"] % 100
    add = hundreds
    if tail and year["value"] < 10 <= by["value"]:
        add = by["value"] - by["value"] % 10
    elif tail and rest - rest % 10 != year["value"] - year["value"] % 10:
        add = 0
    return {**year, "value": year["value"] + add, "from": by["phrase"]} if add and year["value"] + add <= LAST else year


def _first(pattern: re.Pattern, text: str):
    """The first match after which a year stands, and that year."""
    at = 0
    while m := pattern.search(text, at):
        if y := year_at(text[m.end() :]):
            return m, y
        at = max(m.end(), at + 1)
    return None, None


def _range(text: str) -> dict | None:
    at = 0
    while m := _FROM.search(text, at):
        at = max(m.end(), at + 1)
        a = year_at(text[m.end() :])
        link = a and _TO.match(text, m.end() + a["end"])
        b = link and year_at(text[link.end() :])
        if b:
            lo, hi = completed(a, b, False), completed(b, a, False)
            if 0 < hi["value"] - lo["value"] <= 100:
                return {**lo, "until": hi["value"], "phrase": text[m.end() : link.end() + b["end"]].strip(), "open": True}
    return None


def assertions(text: str | None) -> list[dict]:
    """All dates of a normalized text, in its order."""
    hits = list(_TRIGGER.finditer(text or ""))
    starts, out = [h.start(1) for h in hits], []
    for h in hits:
        k = bisect_left(starts, h.end())
        end = min(len(text), h.end() + STRETCH, starts[k] if k < len(starts) else len(text))
        part = text[h.end() : end]
        part = part[: m.start()] if (m := _STOP.search(part)) else part
        say = lambda y, qualifier, confidence, until=None: out.append({"kind": _KIND[h[1]], "verb": h[1], "qualifier": qualifier, "value": y["value"], "until": until, "explicit": y["explicit"], "shared": y["from"] is not None, "shared_from": y["from"], "approximate": y["open"], "phrase": y["phrase"], "offset": h.start(1), "confidence": confidence})  # noqa: B023, E731
        m, y = _first(_YEAR, part)
        gap, bound, at = (part[: m.start()], None, m.end()) if m else ("", None, 0)
        if not y and (d := re.match(r"[\s،؛:]*(?=[٠-٩0-9]{2,4})", part)) and (y := year_at(part[d.end() :])):
            at = d.end()
        if not y and (r := _range(part)):
            say(r, "range", 0.6, r["until"])
            continue
        if not y:
            m, y = _first(_BOUND, part)
            if not y:
                continue
            gap, bound, at = part[: m.end()], m[1], m.end()
        other = _OTHER.match(part, at + y["end"])
        second = year_at(part[other.end() :]) if other else None
        if second and other[1] == "او" and not other[2]:
            y = completed(y, second, True)
        q = _QUALIFIER.search(gap[-40:])
        sure = y["explicit"] or y["from"] is not None
        say(y, q[1] if q else bound or (APPROXIMATE if y["open"] else None), (0.68 if y["open"] else 0.85) if sure else 0.65)
        if second:
            say(second, "reported-variant", 0.6)
    return out


ASSERTION = T.ArrayType(
    struct_of(kind=STRING, verb=STRING, qualifier=STRING, value=INT, until=INT, explicit=BOOLEAN, shared=BOOLEAN, shared_from=STRING, approximate=BOOLEAN, phrase=STRING, offset=INT, confidence=DOUBLE)
)


@F.pandas_udf(ASSERTION)
def date_assertions(text: pd.Series) -> pd.Series:
    return text.map(assertions)


@F.pandas_udf(T.IntegerType())
def year_words(phrase: pd.Series) -> pd.Series:
    """The number that a normalized phrase begins with, null for none."""
    return phrase.map(lambda p: (number(p.split()) or {}).get("value") if p else None).astype("Int32")


@F.pandas_udf(T.IntegerType())
def age_at_death(text: pd.Series) -> pd.Series:
    """The age in years that a normalized text tells, from 15 to 130."""

    def one(t: str | None) -> int | None:
        m = _AGE.search(t or "")
        n = number(m[1].split()) if m else None
        return n["value"] if n and 15 <= n["value"] <= 130 else None

    return text.map(one).astype("Int32")


def precision(a: Column) -> Column:
    """How exact a date is: unknown without one, approximate if it is open or its century is not named with it."""
    return F.when(a.isNull(), "unknown").when(a["approximate"] | ~a["explicit"], "approximate").otherwise("exact")


def first_of(dates: Column, kind: str) -> Column:
    return F.get(F.filter(dates, lambda x: x["kind"] == kind), F.lit(0))
