"""From the pages of a work to records, chains, narrators and registry entries.

Pages are rows. A page's markers come from one pattern, headings are carried forward over the pages of a work, an entry's
parts on several pages are joined by a running count of markers. Both scans are two-level, so a work may have any number of pages;
a page is what one row holds. Readers of single texts are in functions.chains and functions.hijri.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import chains as C
from tesserae.functions.names import MARKS_OF_NAMES, name_head
from tesserae.functions.scalars import FOLDED, fingerprint, level, normalize
from tesserae.functions.text import ascii_digits, title_spans
from tesserae.operators.scans import two_level

# How a record is numbered, by collection; the largest number, and of a collection's main count.
MARKERS = {"muslim": r"(?:^|\n)([٠-٩0-9]{1,5})\s*-\s*\(([٠-٩0-9]{1,5})\)\s*", "": r"(?:^|\n)([٠-٩0-9]{1,5})\s*-\s*()"}
LAST_NUMBER, LAST_OF = 10_000, {"muslim": 3033}
#: A foreword that is no part of the work, by collection; the line that cuts off footnotes.
FOREWORD, FOOTNOTES = {"bukhari": "المقدمة"}, r"(?s)\n_{5,}\n.*$"


def headings(pages: DataFrame, work: str, order: str) -> DataFrame:
    """pages with book and chapter, carried forward: a page's last title is a book if it is numbered and no chapter, a chapter
    if it says so."""
    title = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(title_spans(F.col("text")), -1), "<[^>]+>", " "), r"\s+", " "))
    p = pages.withColumn("_t", F.when(F.size(title_spans(F.col("text"))) > 0, F.nullif(title, F.lit("")))).withColumn("_n", ascii_digits(normalize(F.col("_t"))))
    lasts = {"book": F.when(F.col("_n").rlike(r"^\d+\s*-\s*(?!باب)"), F.col("_t")), "chapter": F.when(F.col("_n").contains("باب"), F.col("_t"))}
    return two_level(p, work, [order], lasts=lasts).drop("_t", "_n")


def marked(text: Column, pattern: str) -> Column:
    """Parts of a text, each with its marker and where its body begins: (first, second, at, body, end, part). What stands before
    the first marker is a part without one."""
    return F.transform(F.split(F.regexp_replace(text, pattern, "$0"), ""), lambda p: F.struct(F.regexp_extract(p, f"^{pattern}", 1).alias("first"), F.regexp_extract(p, f"^{pattern}", 2).alias("second"), F.substring_index(p, "", -1).alias("body"), F.contains(p, F.lit("")).alias("is_marked"), (F.length(p) - F.contains(p, F.lit("")).cast("int")).alias("length")))


def segments(pages: DataFrame, collection: str) -> DataFrame:
    """pages (page, vol, text, ...) -> a row for each numbered record: number, route, place on the page, and its text."""
    pattern = MARKERS.get(collection, MARKERS[""])
    kept = pages.where(~F.col("vol").eqNullSafe(F.lit(FOREWORD[collection]))) if collection in FOREWORD else pages
    rest = [c for c in pages.columns if c != "text"]
    parts = kept.select(*rest, F.posexplode(marked(F.col("text"), pattern)).alias("place", "p")).where("p.is_marked")
    number = lambda c: ascii_digits(F.col(c)).try_cast("int")
    out = parts.select(*rest, "place", F.coalesce(number("p.second"), number("p.first")).alias("number"), number("p.first").alias("route"), F.regexp_replace("p.body", FOOTNOTES, "").alias("body"))
    return out.where(F.col("number").between(1, LAST_OF.get(collection, LAST_NUMBER)))


def records(parts: DataFrame, collection: str) -> DataFrame:
    """segments -> records: id, class, chain and report in the search form, the rule that parted them, its confidence, whether a
    strong term of transmission stands in it, and the report's fingerprint. Nothing is left out: what cannot be parted is
    unparsed, with its reason."""
    from tesserae.functions.text import strip_markup

    p = parts.withColumn("text", normalize(strip_markup(F.col("body")))).withColumn("b", C.record_boundary(F.col("text")))
    id_ = F.concat_ws("-", F.lit(collection), F.col("number").cast("string"), F.col("route").cast("string"), F.col("page").cast("string"))
    cut = F.when(F.col("b.error").isNotNull(), F.length("text")).otherwise(F.col("b.boundary"))
    report = F.when(F.col("b.error").isNull(), F.trim(F.regexp_replace(F.substring(F.col("text"), F.col("b.boundary") + 1, F.length("text")), r"^[\s:،؛.-]+", ""))).otherwise("")
    rest = [c for c in parts.columns if c not in ("body", "text")]
    out = p.select(id_.alias("id"), *rest, "text", F.col("b.class").alias("class"), F.trim(F.substring(F.col("text"), F.lit(1), cut)).alias("chain"), report.alias("report"), F.col("b.rule").alias("rule"), F.col("b.confidence").alias("confidence"), F.col("b.error").alias("error"), F.col("b.strong").alias("strong"), cut.alias("cut"))
    return out.withColumn("fingerprint", fingerprint(F.col("report"))).withColumn("level", level(F.col("confidence")))


#: Letters after a chain in which the prophet's name still belongs to it.
AFTER = 90


def chains(found: DataFrame) -> DataFrame:
    """records -> (id, chain_id, chain_order, start, end, chain): the ways of each record that could be parted."""
    has = found.where("error is null and class <> 'structural-heading'")
    ways = has.select("id", "text", "cut", F.posexplode(C.chain_routes(F.substring(F.col("text"), F.lit(1), F.col("cut")))).alias("chain_order", "w"))
    return ways.select("id", F.concat_ws("#c", "id", F.col("chain_order").cast("string")).alias("chain_id"), "chain_order", "w.start", "w.end", F.trim(F.substring(F.col("text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))).alias("chain"), F.substring(F.col("text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("scope"), F.when(F.col("w.end") == F.col("cut"), F.substring(F.col("text"), F.col("cut") + 1, F.lit(AFTER))).otherwise("").alias("after"))


def narrators(ways: DataFrame) -> DataFrame:
    """chains -> (id, chain_id, position, form, term, start, end, status): a row for each narrator, places in the chain."""
    n = ways.select("id", "chain_id", F.explode(C.chain_narrators(F.col("scope"), F.col("after"))).alias("n")).select("id", "chain_id", "n.*")
    status = F.when(F.col("prophet"), "prophet-mention").when(F.col("relative"), "unresolved-relative").otherwise("unresolved")
    return n.select("id", "chain_id", "position", "form", "term", "start", "end", status.alias("status"))


# registry entries

# How an entry is numbered.
ENTRY_MARKERS = {"tahdhib": r"(?:^|\n)\[([٠-٩0-9]{1,5})\](\s*[(\[][^)\]]{0,24}[)\]])?\s*", "": r"(?:^|\n)([٠-٩0-9]{1,5})\s*-\s*()"}
# Generations in their order, and what may stand before one.
ORDINALS = ["الاولي", "الثانيه", "الثالثه", "الرابعه", "الخامسه", "السادسه", "السابعه", "الثامنه", "التاسعه", "العاشره", "الحاديه عشره", "الثانيه عشره"]
TABAQA = r"من\s+(كبار|صغار|اواسط|اوساط)?\s*(" + "|".join(ORDINALS) + ")"
def entries(pages: DataFrame, work: str, order: str, source: str) -> DataFrame:
    """pages (work, order, text plain) -> (work, entry, number, page, last_page, text): entries over page boundaries, footnotes cut
    off page by page. What stands before the first marker of a work belongs to no entry."""
    pattern = ENTRY_MARKERS.get(source, ENTRY_MARKERS[""])
    body = F.regexp_replace("text", FOOTNOTES, "")
    parts = pages.select(work, order, F.posexplode(marked(body, pattern)).alias("_k", "p"))
    parts = two_level(parts, work, [order, "_k"], sums={"entry": F.col("p.is_marked").cast("int")}).where("entry > 0 and (p.is_marked or trim(p.body) <> '')")
    number = F.max(F.when(F.col("p.is_marked"), ascii_digits(F.col("p.first")).try_cast("int")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "_k", F.col("p.body").alias("t")))), lambda x: x["t"]), "\n")
    return parts.groupBy(work, "entry").agg(number.alias("number"), F.min(order).alias("page"), F.max(order).alias("last_page"), text.alias("text"))


# Signs of sources before a name, whole or with a bracket missing, and within it; words that begin a head and words that
# are left hanging at its end.
SIGN = r"(?:[(\[]\s*(?:[ء-ي٤]{1,3}\s*[،,]?\s*){1,8}[)\]]|[(\[]\s*تمييز\s*[)\]])\s*"
SIGNS = r"(?:[ء-ي٤]{1,3}(?:\s+|\s*[،,]\s*)){0,7}[ء-ي٤]{1,3}"
BROKEN_SIGN = rf"(?:[(\[]\s*{SIGNS}\s*[»«\"]|{SIGNS}\s*[)\]])\s*"
INNER_SIGN = r"\[(?![^\]]*[ء-ي]{4})[^\]]{0,18}\]"
JOINING = r"^(?:فاما|واما|اما|فأما|وأما|أما|ثم|منهم|وفيهم|وقد|وهو)\s+"
HANGING = "من في الي عن ثم و بن ابن ابو ابي ابا ام ال هو هي له لها بني".split()


def _spelt(word: str) -> str:
    """A pattern for a word of the search form as raw texts spell it: letters in all variants, with marks between."""
    return "".join("[" + "".join([c, *(k for k, v in FOLDED.items() if v == c)]) + r"][\p{M}ـ]*" for c in word)


_EDGE, _HANGS = r"[\s،؛:.\-•/]+$", r"(?:^|[\s،؛])(?:" + "|".join(map(_spelt, HANGING)) + ")$"


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _leading(head: Column, pattern: str, most: Column) -> Column:
    """(signs, rest): what the pattern takes off the beginning again and again, `most` times at most."""
    run = F.regexp_extract_all(F.regexp_extract(head, f"^(?:{pattern})+", 0), F.lit(pattern), F.lit(0))
    length = lambda signs: F.aggregate(signs, F.lit(0), lambda n, x: n + F.length(x))
    return _with(F.slice(run, F.lit(1), most), lambda signs: F.struct(F.transform(signs, lambda x: F.trim(x)).alias("signs"), F.substring(head, length(signs) + 1, F.length(head)).alias("rest")))


def cleaned_head(raw: Column) -> Column:
    """(head, sigla): a name's head without marks of footnotes, and the signs of sources before and within it, one each.

    Signs come off first: whole ones, four at most, then those with a bracket missing, six in all, then short ones before a
    dash, as what a later dash parts is no name. Words left hanging at the end go, four at most."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\(\s*\^?\s*[٠-٩0-9]{1,3}\s*\)|⦗[^⦘]*⦘|\(\s*\^?\s*[٠-٩0-9]{1,3}\s*[»«\"]", " "), r"^\s*\^?\s*[٠-٩0-9]{0,3}\s*[)\]]\s*", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))

    def dashed(x: Column) -> Column:
        """(signs, rest) of a head whose signs before a dash are letters and brackets, six at most."""
        before = F.regexp_extract(x["rest"], r"^([^-]{0,14}?)\s+-\s+(?s:.+)$", 1)
        signs = (before != "") & before.rlike(r"^[ء-ي\s،؛()\[\]]*$") & (F.length(F.regexp_replace(before, r"[\s،؛ـ]+", "")) <= 6)
        return F.struct(F.when(signs, F.concat(x["signs"], F.array(F.trim(before)))).otherwise(x["signs"]).alias("signs"), F.when(signs, F.regexp_replace(x["rest"], r"^[^-]{0,14}?\s+-\s+", "")).otherwise(x["rest"]).alias("rest"))

    def named(x: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["rest"], r"(?s)\s+-\s+.*$", ""), r"^[\s،؛:.\-/]+", ""), JOINING, "")
        return F.struct(x["signs"].alias("signs"), F.trim(F.regexp_replace(rest, _EDGE, "")).alias("rest"))

    def ended(x: Column) -> Column:
        head = F.regexp_replace(F.regexp_replace(x["rest"], INNER_SIGN, " "), r"\s+", " ")
        head = F.trim(F.regexp_replace(head, rf"^[\s،؛:.\-/]+|{_EDGE}", ""))
        for _ in range(4):
            head = F.regexp_replace(F.regexp_replace(head, _EDGE, ""), _HANGS, "")
        return F.struct(F.regexp_replace(head, _EDGE, "").alias("head"), F.concat(x["signs"], F.regexp_extract_all(x["rest"], F.lit(INNER_SIGN), F.lit(0))).alias("sigla"))

    whole = _with(t, lambda h: _leading(h, SIGN, F.lit(4)))
    both = _with(whole, lambda x: _with(_leading(x["rest"], BROKEN_SIGN, 6 - F.size(x["signs"])), lambda y: F.struct(F.concat(x["signs"], y["signs"]).alias("signs"), y["rest"].alias("rest"))))
    return _with(_with(_with(both, dashed), named), ended)


def generation(text: Column) -> Column:
    """(label, ordinal, modifier) of the generation that a normalized text names; null for none."""
    which, how = F.regexp_extract(text, TABAQA, 2), F.regexp_extract(text, TABAQA, 1)
    order = F.array_position(F.array(*[F.lit(o) for o in ORDINALS]), which).cast("int")
    return F.when(which != "", F.struct(F.concat_ws(" ", F.nullif(how, F.lit("")), which).alias("label"), order.alias("ordinal"), F.nullif(how, F.lit("")).alias("modifier")))


# Words before teachers and before students, and words that end either list.
TEACHERS, STUDENTS = "روي عن|يروي عن|روي عنه ايضا|حدث عن|سمع من|اخذ عن|قرا علي|عن", "روي عنه|يروي عنه|حدث عنه|رواه عنه|اخذ عنه|وعنه|عنه"
_JUDGED = "ثقه|صدوق|ضعيف|مجهول|متروك|مستور|مقبول|لين|هالك|كذاب|وثقه|وثق|قال|وقال|قلت|مات|ماتت|توفي|وفاته|روي له|اخرج له|ذكره|وذكره|من الطبقه|فيه نظر|تمييز"
TEACHERS_END = f"{_JUDGED}|وعنه|روي عنه|حدث عنه|يروي عنه|رواه عنه|اخذ عنه|له|لا يعرف|صالح الحديث|منكر الحديث|من كبار|من صغار"
NO_MENTION = r"^(?:و|جماعه|وجماعه|غيره|وغيره|اخرين|واخرين|خلق|وخلق)$"


def relation_phrase(text: Column, cues: str, ends: str) -> Column:
    """What stands between the first cue and the first word that ends the list, up to 600 letters; null for none."""
    stop = "|".join([ends, *[f"من {o}" for o in ORDINALS]])
    p = F.regexp_extract(text, rf"(?s)(?:^|[\s،؛.])(?:{cues})\s*[:：]?\s+(.{{2,600}}?)(?=[\s،؛.](?:{stop})(?=[\s،؛.:]|$)|$)", 1)
    return F.nullif(F.trim(F.regexp_replace(p, r"[\s،؛:.-]+$", "")), F.lit(""))


def mentions(phrase: Column, most: int = 40) -> Column:
    """The single mentions of a phrase, of 3 to 80 letters."""
    pieces = F.transform(F.split(F.coalesce(phrase, F.lit("")), r"\s*[،؛]\s*"), lambda x: F.trim(F.regexp_replace(x, r"^[\s،؛:.-]+|[\s،؛:.-]+$", "")))
    return F.slice(F.filter(pieces, lambda x: F.length(x).between(3, 80) & ~x.rlike(NO_MENTION)), 1, most)


def entry_fields(found: DataFrame) -> DataFrame:
    """entries -> everything that is read from an entry: its name and what describes it, fields of the name, generation,
    teachers and students, and the reasons for which it goes to review; an entry with reasons is kept with them."""
    head = F.regexp_replace(F.substring(F.substring_index(F.col("text"), "\n", 1), 1, 280), r"\s+", " ")
    e = found.withColumn("normalized", normalize(F.col("text"))).withColumn("_c", cleaned_head(head)).withColumn("_n", normalize(F.col("_c.head")))
    e = e.withColumn("_h", name_head(F.col("_c.head"), F.col("_n"))).withColumn("name_normalized", F.col("_h.normalized"))
    e = e.withColumn("teacher_phrase", relation_phrase(F.col("normalized"), TEACHERS, TEACHERS_END)).withColumn("student_phrase", relation_phrase(F.col("normalized"), STUDENTS, _JUDGED))
    named = F.col("_n").rlike(MARKS_OF_NAMES) | (F.size("_h.nisbas") > 0) | F.col("_h.kunya").isNotNull()
    n, m = F.length("normalized"), F.length("name_normalized")
    reasons = F.array_compact(F.array(
        F.when(F.col("number").isNull(), "entry-number-unreadable"), F.when(n < 12, "segment-too-short"), F.when(n > 24_000, "segment-too-long"), F.when(m < 3, "name-head-too-short"), F.when(m > 220, "name-head-too-long"),
        F.when(~F.col("name_normalized").rlike("[ء-ي]"), "name-head-not-arabic"), F.when(~named, "no-personal-name-marker"),
    ))
    return e.select(
        *found.columns, "normalized", "_h.name", "name_normalized", "_h.rule", "_h.forms", "_h.described", "_h.cut", F.col("_c.sigla").alias("sigla"), "_h.notes",
        "_h.kunya", "_h.nisbas", "_h.name_chain", "_h.chain_names", "_h.region", "_h.residence", generation(F.col("normalized")).alias("generation"), "teacher_phrase", "student_phrase", mentions(F.col("teacher_phrase")).alias("teachers"), mentions(F.col("student_phrase")).alias("students"), reasons.alias("reasons"),
    )


def criticisms(biographies: DataFrame, key: str, text: str) -> DataFrame:
    """(key, critic, kind, phrase, work, volume, page, source_page, n): statements of critics in a biography. Sections part at two
    empty lines, the first line names the critic, a statement ends with its citation `work (volume/ page)`, after which a
    number alone is the page of the source."""
    from tesserae.functions.text import section_kind

    sections = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), r"\n\s*\n\s*\n+"), lambda x: F.trim(x)), lambda x: x != "")
    s = biographies.select(key, F.posexplode(sections).alias("_s", "t"))
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    s = s.withColumn("lines", lines).where("size(lines) >= 3").withColumn("critic", F.trim(F.regexp_replace(F.get("lines", F.lit(0)), r"^:\s*", "")))
    row = s.select(key, "_s", "critic", F.posexplode("lines").alias("_l", "line")).where("_l > 0")
    cited = r"^(.+?)\s*\(([^/()]+)/\s*([^()]+)\)$"
    row = row.withColumn("is_cited", F.col("line").rlike(cited))
    w = Window.partitionBy(key, "_s").orderBy("_l")
    row = row.withColumn("_before", F.lag("is_cited").over(w)).withColumn("_page", F.when(F.coalesce(F.col("_before"), F.lit(False)) & F.col("line").rlike(r"^\d+$"), F.col("line").cast("int")))
    row = row.withColumn("source_page", F.lead("_page").over(w)).where("_page is null")
    row = row.withColumn("_group", F.coalesce(F.sum(F.col("is_cited").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = row.groupBy(key, "_s", "critic", "_group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_cited"), F.struct("_l", "line")))), lambda x: x["line"]), " ").alias("phrase"), F.max(F.when(F.col("is_cited"), F.struct("line", "source_page"))).alias("c"))
    g = g.where("c is not null").withColumn("phrase", F.trim(F.regexp_replace("phrase", r"\s+", " "))).where("phrase <> ''")
    part = lambda k: F.trim(F.regexp_extract("c.line", cited, k))
    n = F.row_number().over(Window.partitionBy(key).orderBy("_s", "_group")) - 1
    out = g.select(key, "critic", "phrase", part(1).alias("work"), part(2).alias("volume"), part(3).alias("page"), F.col("c.source_page").alias("source_page"), n.alias("n"))
    return out.withColumn("kind", section_kind(F.col("critic")))
