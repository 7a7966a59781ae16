"""The head of a registry entry: where the name ends, its other forms, notes on spelling, and the fields of the name.

A head is a short row of words, each with its search form; one small reader works on it in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalars import BOOLEAN, STRING, struct_of

# What ends a name for certain, and what only describes its bearer.
ENDS = (
    "عن|روي عن|سمع|سمع من|حدث عن|اخذ عن|يروي عن|وعنه|عنه|روي عنه|حدث عنه|يروي عنه|رواه عنه|قال|قالت|وقال|قلت|وقلت|ثقه|صدوق|ضعيف|ضعفوه|مجهول|متروك|مستور|مقبول|لين|هالك|كذاب|واه|صحابي|صحابيه|تابعي|له صحبه|"
    "لا يعرف|لا يعتمد|لا يدري|لا يصح|لا شي|لا يتابع|تركوه|متهم|وضاع|لا باس به|فيه نظر|فيه جهاله|وثقه|وثقوه|وثق|ضعفه|ثم|مات|ماتت|توفي|توفيت|استشهد|قتل|هلك|المتوفي|دفن|بلغ|عاش|روي له|له في|اخرج له|اخرج|"
    "ذكره|وذكره|ذكر|انظر|تقدم|يايي|تمييز|مبتدع|زاهد|مشهور|محله الصدق|صالح الحديث|منكر الحديث|حسن الحديث|منكر|اسمه|واسمه|يقال|ويقال|وقد|وكان|كان|من الطبقه|من كبار|من صغار|بخ|خت|وزعم|زعم|اختلف|وهم|"
    "يعرف|لقبه|ولقبه|خلط|سماعه|ثبت|له|وله|كذا|نسبه|وفي|الذي|التي|انه|انها|وانه|متاخر|مقدم|صلي الله عليه وسلم|رضي الله عنه|رضي الله عنها|عليه السلام"
).split("|")
DESCRIBES = "مولي|مولاه|مولاهم|حليف|والد|ابنه|اخو|اخوه|اخت|جد|جده|حفيد|عم|عمه|ابن عم|بنت عم|ابن اخي|ابن اخت|ابن بنت|زوج|زوجه|قاضي|امام|حافظ|شيخ|صاحب|احد|سكن|نزيل|اصله|الاصل|امراه|امرايه|والده|والدته|جدته|اخته|بنته|ابن اخيه|ابن عمه".split("|")
FORMS = "ويقال له|ويقال لها|يقال له|يقال لها|وقيل له|قيل له|ويقال|يقال|وقيل|قيل|ويسمي|يسمي|واسمه|اسمه|واسمها|اسمها|واسم ابيه|واسم امه|ولقبه|لقبه|ويلقب|يلقب|ويعرف ب|يعرف ب|ويعرف|يعرف|المعروف ب|المعروف|وكنيته|كنيته|ويكني|يكني|وقد ينسب|وينسب|ينسب|وكان يقال|واسم|اسم|او|وهو|هو|وهي|هي".split("|")
# Parts of a name, words that join two of them, nisbas that are none, and the places of those that are.
JOINS, COMPOUND = ["بن", "ابن"], ["عبد", "عبيد", "ابو", "ابي", "ابا", "ام", "امه", "ذو", "ذي", "ال"]
MARKS_OF_NAMES = r"(?:^|\s)(?:ابن|بن|ابو|ابي|ابا|ام|بنت|مولي|مولاه|مولاهم)(?:\s|$)"
NO_NISBA = "صحابي تابعي مولاي والدي اخي ابني نفسي يعني الذي التي الباقي الماضي حي في علي الي المتوفي الاتي الثاني الاولي".split()
REGIONS = {
    "الكوفي": "الكوفة", "كوفي": "الكوفة", "البصري": "البصرة", "بصري": "البصرة", "المدني": "المدينة", "مدني": "المدينة", "المكي": "مكة", "مكي": "مكة", "الدمشقي": "دمشق", "دمشقي": "دمشق", "الشامي": "الشام", "شامي": "الشام", "المصري": "مصر", "مصري": "مصر", "الواسطي": "واسط", "واسطي": "واسط",
    "البغدادي": "بغداد", "بغدادي": "بغداد", "اليماني": "اليمن", "يماني": "اليمن", "الخراساني": "خراسان", "خراساني": "خراسان", "المروزي": "مرو", "مروزي": "مرو", "المروي": "مرو", "النيسابوري": "نيسابور", "الرازي": "الري", "رازي": "الري", "الحمصي": "حمص", "حمصي": "حمص", "الحلبي": "حلب", "الجزري": "الجزيرة",
    "الاندلسي": "الأندلس", "الاصبهاني": "أصبهان", "الاصفهاني": "أصبهان", "الهروي": "هراة", "البلخي": "بلخ", "الطبري": "طبرستان", "الانطاكي": "أنطاكية", "الحراني": "حران", "الموصلي": "الموصل", "السمرقندي": "سمرقند", "البخاري": "بخارى", "الجرجاني": "جرجان", "العسقلاني": "عسقلان", "القرطبي": "قرطبة",
    "الطرسوسي": "طرسوس", "العدني": "عدن", "الصنعاني": "صنعاء", "الايلي": "أيلة", "الطايفي": "الطائف", "الاسكندراني": "الإسكندرية", "التستري": "تستر", "الفلسطيني": "فلسطين", "الاهوازي": "الأهواز", "القزويني": "قزوين", "الهمداني": "همدان", "الهمذاني": "همذان", "السجستاني": "سجستان", "الطوسي": "طوس",
    "الرملي": "الرملة", "التنيسي": "تنيس", "البيروتي": "بيروت", "المرعشي": "مرعش", "الجندي": "الجند", "الطرابلسي": "طرابلس", "البيهقي": "بيهق", "الهجري": "هجر",
}
# Words that begin a note on spelling, and those that go on with it.
SPELLS = "بضم بفتح بكسر بسكون باسكان بعدها بعده بعدهما بالتصغير بالتخفيف بالتشديد بالقصر بالمد بمعجمه بمهمله بموحده بمثناه بمثلثه بنون بجيم بحاء بخاء بدال بذال براء بزاي بسين بشين بصاد بضاد بطاء بظاء بعين بغين بفاء بقاف بكاف بلام بميم بهاء بواو بياء بهمزه بباء بتاء بثاء بمعجمات بمهملات بمعجمتين بمهملتين بلفظ مصغر مصغرا".split()
SPELLED = "وسكون وفتح وضم وكسر واسكان وبفتحها وبكسرها وبضمها ثم واخره واخرها اخره مهمله معجمه موحده مثناه مثلثه تحتانيه فوقانيه ساكنه خفيفه ثقيله مشدده مخففه والمد والقصر حرف حروف الحروف لفظ كسرها فتحها ضمها وحكي المهمله المعجمه الموحده معا معجمتين مهملتين نون جيم حاء خاء دال ذال راء زاي سين شين صاد ضاد طاء ظاء عين غين فاء قاف كاف لام ميم هاء واو ياء همزه باء تاء ثاء اللام الميم الراء النون الفاء القاف الكاف العين الحاء الجيم الدال الزاي السين الشين الصاد الطاء الياء الواو الهاء الباء التاء الثاء".split()


_ENDS, _SOFT, _FORMS = set(ENDS), set(ENDS) | set(DESCRIBES), set(FORMS)
_SPELLS, _SPELLED, _NO_NISBA = set(SPELLS), set(SPELLED), set(NO_NISBA)
_EDGES = re.compile(r"^[.:،؛()\[\]\"]+|[.:،؛()\[\]\"]+$")
#: A head's words: as they stand, and their search forms.
Words = list[tuple[str, str]]
_LIST = T.ArrayType(STRING)
HEAD = struct_of(
    name=STRING, normalized=STRING, rule=STRING, forms=_LIST, described=STRING, cut=BOOLEAN, notes=_LIST,
    kunya=STRING, nisbas=_LIST, name_chain=STRING, chain_names=_LIST, region=STRING, residence=STRING,
)


def _text(ws: Words) -> str:
    return " ".join(r for r, _ in ws).rstrip(" ،؛:.-")


def phrase_at(ws: Words, i: int, phrases: set[str]) -> int:
    """Words of the longest of the phrases that stands at i, 0 for none."""
    return next((n for n in (4, 3, 2, 1) if i + n <= len(ws) and " ".join(w for _, w in ws[i : i + n]) in phrases), 0)


def cut(ws: Words, phrases: set[str]) -> int:
    """The first place after the first word where one of the phrases stands; the end if none does."""
    return next((i for i in range(1, len(ws)) if phrase_at(ws, i, phrases)), len(ws))


def components(ws: Words) -> int:
    """Parts of a name: joining words count nothing, a compound is one."""
    n, joined = 0, False
    for _, w in ws:
        if joined:
            joined = False
        elif w not in JOINS:
            n, joined = n + 1, w in COMPOUND
    return n


def substantial(ws: Words) -> bool:
    return components(ws) >= 2 and len(" ".join(w for _, w in ws)) >= 8


def unglossed(ws: Words) -> tuple[Words, list[str]]:
    """Words without notes on spelling, and those notes: runs that a word of spelling begins."""
    kept, notes, run = [], [], []
    for r, w in [*ws, ("", "")]:
        if w in _SPELLS or run and w in _SPELLED:
            run.append(r)
            continue
        if run:
            notes.append(" ".join(run).strip("،؛ "))
            run = []
        kept.append((r, w))
    return kept[:-1], notes


def chosen(ws: Words) -> tuple[Words, str, list[str], str | None, bool]:
    """The name, the rule, its other forms, what describes its bearer, whether anything was cut. What only describes cuts a name
    too, unless too little is left; then the certain ends alone count, and if that is still too little the other forms
    stay with the name. A head that has no mark of a name gives way to a form that has one."""
    at = cut(ws, _FORMS)
    first, rest = ws[:at], ws[at:]
    forms = []
    while rest:
        rest = rest[phrase_at(rest, 0, _FORMS) :]
        n = cut(rest, _FORMS)
        if form := unglossed(rest[: min(n, cut(rest, _SOFT))])[0]:
            forms.append(form)
        rest = rest[n:]
    end, rule = cut(first, _SOFT), "name-form-and-boundary"
    if not substantial(first[:end]) and (hard := cut(first, _ENDS)) > end:
        end, rule = hard, "name-form-and-hard-boundary"
    if not substantial(first[:end]) and forms and (whole := cut(ws, _ENDS - _FORMS)) > end:
        return ws[:whole], "hard-boundary", [], _text(ws[whole:]) or None, whole < len(ws)
    named = lambda x: re.search(MARKS_OF_NAMES, " ".join(w for _, w in x))
    if not named(first[:end]) and (better := next((f for f in forms if named(f)), None)):
        return better, "promoted-name-form", [_text(f) for f in forms if f is not better], _text(first) or None, True
    return first[:end], rule, [_text(f) for f in forms], _text(first[end:]) or None, end < len(ws)


def fields(ws: Words) -> dict:
    """Kunya, nisbas, the chain of names before them, the region of the first nisba that has one, and the residence."""
    w = ["", *(x for _, x in ws), "", "", ""]  # one word before, three after
    n = range(1, len(ws) + 1)
    verbs = ("يكني", "ويكني")
    at = next((i for i in n if i < len(ws) and (w[i] in ("ابو", "ام", "ابا") and w[i - 1] not in JOINS or w[i] in verbs)), 0)
    kunya = None
    if at:
        k = at + (w[at] in verbs)
        parts = [w[k]] + [w[k + 1]] * (w[k + 1] not in ("", *JOINS))
        kunya = " ".join(parts + [w[k + 2]] * (parts[1:] != [] and parts[1] in ("عبد", "ابي", "ابن", "ال") and w[k + 2] != ""))
    looks = lambda i: re.fullmatch("ال[ء-ي]{3,}ي", w[i]) or i > 1 and re.fullmatch("[ء-ي]{4,}ي", w[i])
    places = [i for i in n if looks(i) and w[i] not in _NO_NISBA and not w[i].startswith("لل") and w[i - 1] not in (*JOINS, "ابو", "ابي", "ام", "ابا") and w[i + 1] not in JOINS]
    nisbas = list(dict.fromkeys(w[i] for i in places))
    end = min([i for i in (at, *places[:1]) if i > 1], default=len(ws) + 1)
    own = w[1:end]
    home = re.search(r"(?:^|\s)نزيل\s+([^\s،؛.]{3,20})", " ".join(w[1 : len(ws) + 1]))
    return {"kunya": kunya, "nisbas": nisbas, "name_chain": " ".join(own), "chain_names": [x for x in own if x not in JOINS], "region": next((REGIONS[x] for x in nisbas if x in REGIONS), None), "residence": home[1] if home else None}


def read_head(raw: str, norm: str) -> dict:
    ws = [(r, _EDGES.sub("", n)) for r, n in zip(raw.split(), norm.split(), strict=False)]
    head, rule, forms, described, was_cut = chosen(ws)
    kept, notes = unglossed(head)
    whole, more = unglossed(ws)
    return {"name": _text(kept), "normalized": " ".join(w for _, w in kept), "rule": rule, "forms": forms[:6], "described": described, "cut": was_cut, "notes": notes or more, **fields(whole)}


@F.pandas_udf(HEAD)
def name_head(raw: pd.Series, norm: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_head(r or "", n or "") for r, n in zip(raw, norm, strict=True)])
