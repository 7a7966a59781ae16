"""Bindings of the importer to pages and phrases given as rows, each with the rows that must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import hijri as H
from tesserae.plans.catalogue import given
from tesserae.plans.literal import Literal

PHRASES = Literal(
    "phrases",
    "phrase string, year int",
    [("ثلاث وثمانين وميه", 183), ("ثمان واربعين ومايتين", 248), ("احدي وستين", 61), ("سبع عشره", 17), ("اثنتين وسبعين ومايتين", 272), ("ست وثلاثين ومايتين", 236), ("خمس واربعين ومايه", 145), ("تسع وستين وميه", 169), ("عشرين ومايه", 120), ("اربع وميتين", 204),
     ("ثلاث مايه", 300), ("ثلاث وثلاثمايه", 303), ("بضع", None), ("كتاب", None), ("الاربعين ومايتين", 240), (None, None)],
)


@given(f"WITH {PHRASES.cte} SELECT phrase, year FROM phrases")
def number_words(spark, d):
    """Years in number words; a century that is not named is not added."""
    return PHRASES.df(spark).select("phrase", H.year_words(F.col("phrase")).alias("year"))


DATED = Literal(
    "dated",
    "k int, text string",
    [
        (1, "مات سنه ثلاث وثمانين ومايه"), (2, "توفي بعد الاربعين ومايتين"), (3, "مات سنه احدي او اثنتين وتسعين ومايه"), (4, "مات سنه ثلاث وتسعين وقيل سنه اثنتين ومايتين"), (5, "فيمن مات من الاربعين الي الخمسين ومايه"), (6, "خلط قبل موته بعشر سنين"),
        (7, "ولد سنه 93 ومات سنه 179"), (8, "مات في حدود سنه مايتين وله ثمانون سنه"), (9, "مات سنه ست وثلاثين"), (10, None), (11, "مات. سنه مايه"), (12, "مات في نيف وسبعين ومايه"), (13, "توفي ١٥٠"),
    ],
)


@given(
    """SELECT k, kind, value, until, explicit, shared, qualifier, "precision", confidence::DOUBLE AS confidence FROM (VALUES (1, 'death', 183, NULL, true, false, NULL, 'exact', 0.85), (2, 'death', 240, NULL, true, false, 'بعد', 'exact', 0.85), (3, 'death', 191, NULL, false, true, NULL, 'approximate', 0.85), (3, 'death', 192, NULL, true, false, 'reported-variant', 'exact', 0.6),
(4, 'death', 93, NULL, false, false, NULL, 'approximate', 0.65), (4, 'death', 202, NULL, true, false, 'reported-variant', 'exact', 0.6), (5, 'death', 140, 150, false, true, 'range', 'approximate', 0.6), (7, 'birth', 93, NULL, false, false, NULL, 'approximate', 0.65), (7, 'death', 179, NULL, true, false, NULL, 'exact', 0.85),
(8, 'death', 200, NULL, true, false, 'حدود', 'exact', 0.85), (9, 'death', 36, NULL, false, false, NULL, 'approximate', 0.65), (12, 'death', 170, NULL, true, false, 'نيف', 'exact', 0.85), (13, 'death', 150, NULL, true, false, NULL, 'exact', 0.85)) v(k, kind, value, until, explicit, shared, qualifier, "precision", confidence)"""
)
def date_assertions(spark, d):
    """Dates with their bounds, ranges, variants and shared centuries."""
    a = DATED.df(spark).select("k", F.explode(H.date_assertions(F.col("text"))).alias("a"))
    return a.select("k", "a.kind", "a.value", "a.until", "a.explicit", "a.shared", "a.qualifier", H.precision(F.col("a")).alias("precision"), "a.confidence")


@given("SELECT * FROM (VALUES (7, 93, NULL::INTEGER), (8, NULL, 80)) v(k, birth, age)")
def ages_and_births(spark, d):
    """The first birth and the age at death that a text tells."""
    x = DATED.df(spark).select("k", H.first_of(H.date_assertions(F.col("text")), "birth")["value"].alias("birth"), H.age_at_death(F.col("text")).alias("age"))
    return x.where("birth is not null or age is not null")


PAGES = Literal(
    "pages_",
    "page int, vol string, text string",
    [
        (0, "المقدمة", "7 - حدثنا مثال: قال هذا ليس من الكتاب أبدا"),
        (1, "1", "<span data-type=\"title\">1 - كتاب بدء الوحي</span>\n١ - حَدَّثَنَا الحميدي عبد الله بن الزبير قال: حدثنا سفيان، قال: حدثنا يحيى بن سعيد الأنصاري، سمعت عمر قال: سمعت رسول الله ﷺ يقول: «إنما الأعمال بالنيات»\n2 - حدثنا عبد الله بن يوسف، أخبرنا مالك، عن هشام بن عروة، عن أبيه، بمثله."),
        (2, "1", "<span data-type=\"title\">باب كيف كان بدء الوحي</span>\n3 - باب في الإيمان\n5 - كلام بلا إسناد ولا شيء يذكر\n6 - حدثنا يحيى بن بكير، عن الليث ح وحدثنا عبد الله، أخبرنا معمر، عن الزهري: أن النبي صلى الله عليه وسلم قام من الليل يصلي\n_____\nحاشية"),
        (3, "1", "4 - "),
    ],
)


def _records(spark):
    from tesserae.operators import importing as I

    return I.records(I.segments(I.headings(PAGES.df(spark).withColumn("work", F.lit("b")), "work", "page"), "bukhari"), "bukhari")


@given(
    """SELECT id, class, rule, confidence::DOUBLE AS confidence, error, strong, book, chapter FROM (VALUES ('bukhari-1-1-1', 'hadith', 'quote-open', 0.8, NULL, true, '1 - كتاب بدء الوحي', NULL), ('bukhari-2-2-1', 'hadith-reference', 'reference-record', 0.7, NULL, true, '1 - كتاب بدء الوحي', NULL),
('bukhari-3-3-2', 'structural-heading', 'structural-heading', 0.85, NULL, false, '1 - كتاب بدء الوحي', 'باب كيف كان بدء الوحي'), ('bukhari-4-4-3', 'unparsed', NULL, 0, 'empty-segment', false, '1 - كتاب بدء الوحي', 'باب كيف كان بدء الوحي'),
('bukhari-5-5-2', 'unparsed', NULL, 0, 'transmission-term-not-found', false, '1 - كتاب بدء الوحي', 'باب كيف كان بدء الوحي'), ('bukhari-6-6-2', 'hadith', 'colon-boundary', 0.6, NULL, true, '1 - كتاب بدء الوحي', 'باب كيف كان بدء الوحي')) v(id, class, rule, confidence, error, strong, book, chapter)"""
)
def imported_records(spark, d):
    """Records of numbered pages, their classes, rules and headings; a foreword is no part of the work."""
    return _records(spark).select("id", "class", "rule", "confidence", "error", "strong", "book", "chapter")


@given("SELECT class, count(*) AS n FROM (VALUES ('hadith'), ('hadith'), ('hadith-reference'), ('structural-heading'), ('unparsed'), ('unparsed')) v(class) GROUP BY class")
def imported_classes(spark, d):
    return _records(spark).groupBy("class").agg(F.count("*").alias("n"))


@given(
    """SELECT * FROM (VALUES ('bukhari-1-1-1#c0', 0, 'الحميدي عبد الله بن الزبير', 'حدثنا', 'unresolved'), ('bukhari-1-1-1#c0', 1, 'سفيان', 'حدثنا', 'unresolved'), ('bukhari-1-1-1#c0', 2, 'يحيي بن سعيد الانصاري', 'حدثنا', 'unresolved'), ('bukhari-1-1-1#c0', 3, 'عمر', 'سمعت', 'unresolved'),
('bukhari-1-1-1#c0', 4, 'رسول الله صلي الله عليه وسلم', 'سمعت', 'unresolved'), ('bukhari-2-2-1#c0', 0, 'عبد الله بن يوسف', 'حدثنا', 'unresolved'), ('bukhari-2-2-1#c0', 1, 'مالك', 'اخبرنا', 'unresolved'),
('bukhari-2-2-1#c0', 2, 'هشام بن عروه', 'عن', 'unresolved'), ('bukhari-6-6-2#c0', 0, 'يحيي بن بكير', 'حدثنا', 'unresolved'), ('bukhari-6-6-2#c0', 1, 'الليث', 'عن', 'unresolved'), ('bukhari-6-6-2#c1', 0, 'عبد الله', 'وحدثنا', 'unresolved'), ('bukhari-6-6-2#c1', 1, 'معمر', 'اخبرنا', 'unresolved'), ('bukhari-6-6-2#c1', 2, 'الزهري', 'عن', 'unresolved'), ('bukhari-6-6-2#c1', 3, 'النبي صلي الله عليه وسلم', NULL, 'prophet-mention')) v(chain_id, position, form, term, status)"""
)
def imported_narrators(spark, d):
    """Narrators of each way of each chain, by position."""
    from tesserae.operators import importing as I

    return I.narrators(I.chains(_records(spark))).select("chain_id", "position", "form", "term", "status")


BOOK = Literal(
    "book",
    "work string, page int, text string",
    [
        ("t", 1, "مقدمة الكتاب\n[1] (خ م) مالك بن أنس بن مالك، أبو عبد الله المدني، ثقة روى عن نافع، والزهري، وجماعة، روى عنه شعبة، ويحيى القطان، ثقه من السابعة مات سنة تسع وسبعين ومائة\n[2] زيد مولى عمر\nسمع من"),
        ("t", 2, "عمر بن الخطاب قال وهو من كبار الثالثة\n_____\nحاشية [9]\n"),
        ("t", 3, "[3] القاسم بن رشدين بن عمير، ويقال: ابن رشدين بن القاسم مصري بضم الراء نزيل مصر\n[4] من\n[5] the unknown man of letters"),
    ],
)


def _entries(spark):
    from tesserae.operators import importing as I

    return I.entry_fields(I.entries(BOOK.df(spark), "work", "page", "tahdhib"))


@given(
    """SELECT * FROM (VALUES (1, 1, 1, 'مالك بن أنس بن مالك، أبو عبد الله المدني', 'name-form-and-boundary', 'ابو عبد الله', 'المدني,والزهري,ويحيي', 'مالك بن انس بن مالك', 'المدينة', 7, 'نافع، والزهري، وجماعه', 'شعبه، ويحيي القطان', ''), (2, 1, 2, 'زيد مولى عمر', 'name-form-and-hard-boundary', NULL, '', 'زيد مولي عمر', NULL, 3, 'عمر بن الخطاب', NULL, ''),
(3, 3, 3, 'القاسم بن رشدين بن عمير', 'name-form-and-boundary', NULL, '', 'القاسم بن رشدين بن عمير ويقال ابن رشدين بن القاسم مصري نزيل مصر', NULL, NULL, NULL, NULL, ''), (4, 3, 3, '', 'name-form-and-boundary', NULL, '', '', NULL, NULL, NULL, NULL, 'segment-too-short,name-head-too-short,name-head-not-arabic,no-personal-name-marker'),
(5, 3, 3, 'the unknown man of letters', 'name-form-and-boundary', NULL, '', 'the unknown man of letters', NULL, NULL, NULL, NULL, 'name-head-not-arabic,no-personal-name-marker')) v(number, page, last_page, name, rule, kunya, nisbas, name_chain, region, generation, teachers, students, reasons)"""
)
def imported_entries(spark, d):
    """Registry entries over pages: names, fields, generations, lists of teachers and students, reasons for review."""
    e = _entries(spark)
    return e.select("number", "page", "last_page", "name", "rule", "kunya", F.array_join("nisbas", ",").alias("nisbas"), "name_chain", "region", F.col("generation.ordinal").alias("generation"), F.col("teacher_phrase").alias("teachers"), F.col("student_phrase").alias("students"), F.array_join("reasons", ",").alias("reasons"))


@given("SELECT * FROM (VALUES (1, 'teacher', 0, 'نافع'), (1, 'teacher', 1, 'والزهري'), (1, 'student', 0, 'شعبه'), (1, 'student', 1, 'ويحيي القطان'), (2, 'teacher', 0, 'عمر بن الخطاب')) v(number, list, place, mention)")
def imported_mentions(spark, d):
    e = _entries(spark)
    one = lambda k: e.select("number", F.lit(k).alias("list"), F.posexplode(k + "s").alias("place", "mention"))
    return one("teacher").unionByName(one("student"))


@given("SELECT * FROM (VALUES (1, '', '', NULL::VARCHAR, NULL::VARCHAR), (2, '', '', NULL, NULL), (3, '', 'بضم الراء', 'ابن رشدين بن القاسم مصري', NULL), (4, '', '', NULL, NULL), (5, '', '', NULL, NULL)) v(number, sigla, notes, forms, described)")
def imported_head_parts(spark, d):
    """Signs of sources, notes on spelling, other forms of a name."""
    e = _entries(spark)
    return e.select("number", F.array_join("sigla", ",").alias("sigla"), F.array_join(F.slice("notes", 1, 1), ",").alias("notes"), F.get("forms", F.lit(0)).alias("forms"), F.lit(None).cast("string").alias("described"))


LIVES_OF = Literal("biographies", "id int, text string", [(1, "أحمد بن حنبل\nثقة ثبت\nتهذيب الكمال (1/ 23)\n123\n\n\nإثبات السماع\nسمع من الزهري\nوأدركه\nسير أعلام النبلاء (2/ 45)\n456"), (2, ": ابن معين\r\nليس به بأس\nالتاريخ (3/ 7)\nضعيف\nالكامل (4/ 8)\n9"), (3, "سطر\nواحد"), (4, None)])


@given(
    """SELECT * FROM (VALUES (1, 'أحمد بن حنبل', 'critic', 'ثقة ثبت', 'تهذيب الكمال', '1', '23', 123, 0), (1, 'إثبات السماع', 'hearing_evidence', 'سمع من الزهري وأدركه', 'سير أعلام النبلاء', '2', '45', 456, 1), (2, 'ابن معين', 'critic', 'ليس به بأس', 'التاريخ', '3', '7', NULL, 0),
(2, 'ابن معين', 'critic', 'ضعيف', 'الكامل', '4', '8', 9, 1)) v(id, critic, kind, phrase, work, volume, page, source_page, n)"""
)
def imported_criticisms(spark, d):
    """Statements of critics with their citations."""
    from tesserae.operators import importing as I

    return I.criticisms(LIVES_OF.df(spark), "id", "text")


MARKED = Literal("marked", "k int, raw string", [(1, "<span data-type='title'>بَابُ أ</span>\r\n\n\n\nنصّ  &nbsp;⦗ص1⦘ <b>ة</b>"), (2, ""), (3, None), (4, "a < b Éa")])


@given("SELECT * FROM (VALUES (1, 'باب ا نص ه', 'بَابُ أ', 'بَاب', 'verbatim'), (2, '', NULL, NULL, NULL), (3, '', NULL, NULL, NULL), (4, 'a < b ea', NULL, 'a <', 'contains-markup')) v(k, normalized, title, span, integrity)")
def prepared_pages(spark, d):
    """Pages in three forms, with stretches of the search form traced to the raw page."""
    from tesserae.functions import chains as C
    from tesserae.functions.text import span_integrity

    p = MARKED.df(spark).withColumn("p", C.prepared(F.col("raw"))).withColumn("s", C.raw_span(F.col("p.places"), F.lit(0), F.lit(3)))
    cut = lambda c, s: F.substring(c, s["start"] + 1, s["end"] - s["start"])
    t = F.get("p.titles", F.lit(0))
    return p.select("k", "p.normalized", cut(F.col("p.plain"), t).alias("title"), cut(F.col("raw"), F.col("s")).alias("span"), F.when(F.col("s").isNotNull(), span_integrity(cut(F.col("raw"), F.col("s")))).alias("integrity"))
