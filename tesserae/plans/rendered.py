"""The importer over the driver's tables: texts are written from columns by a rule, read by the importer, and SQL knows from the same
columns what must come out.

Names, words of numbers and formulas are lists; a row picks among them by its keys. Each query runs over all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import hijri as H
from tesserae.functions.text import span_integrity, strip_markup
from tesserae.operators import importing as I
from tesserae.plans.catalogue import query, t
from tesserae.sources.scratch import stored

# Names and number words in the search form.
NAMES = ["مالك", "نافع", "سفيان", "شعبه", "معمر", "الزهري", "قتاده", "هشام بن عروه", "عبد الله بن يوسف", "الليث", "يحيي بن بكير", "جابر", "طاوس", "عطاء", "حماد بن زيد", "ايوب", "مسدد", "وكيع", "ابراهيم", "علقمه"]
UNITS = ["احدي", "اثنتين", "ثلاث", "اربع", "خمس", "ست", "سبع", "ثمان", "تسع"]
TENS = ["عشر", "عشرين", "ثلاثين", "اربعين", "خمسين", "ستين", "سبعين", "ثمانين", "تسعين"]
HUNDREDS = ["مايه", "مايتين", "ثلاثمايه", "اربعمايه", "خمسمايه", "ستمايه", "سبعمايه", "ثمانمايه", "تسعمايه"]
FIRST, SECOND = ["مالك", "جابر", "سعيد", "خالد", "طلحه", "حمزه", "راشد"], ["انس", "عمر", "هارون", "صالح", "داود"]
KUNYAS, NISBAS = ["صالح", "داود", "طلحه"], ["المدني", "الكوفي", "البصري", "الدمشقي"]
PLACES = ["المدينة", "الكوفة", "البصرة", "دمشق"]
TEACHERS, STUDENTS = ["نافع", "عطاء", "طاوس", "عكرمه"], ["شعبه", "معمر", "وكيع"]
CRITICS, WORKS = ["أحمد بن حنبل", "ابن معين", "البخاري"], ["تهذيب الكمال", "التاريخ", "الكامل", "سير أعلام النبلاء"]
PHRASES = ["ثقة ثبت", "ليس به بأس", "ضعيف", "صدوق ربما وهم"]
HEADINGS = [*CRITICS, "إثبات السماع", "الإرسال والانقطاع", "المفاضلة", "التدليس"]
KINDS = ["critic", "critic", "critic", "hearing_evidence", "disconnection", "comparison", "other"]


def _pick(words: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), n.cast("int"))


def _sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _words(n: Column) -> Column:
    """A number from 1 to 999 in words."""
    hundred, rest = F.floor(n / 100), n % 100
    ten, unit = F.floor(rest / 10), rest % 10
    u, v = _pick(UNITS, unit - 1), _pick(TENS, ten - 1)
    small = F.when(rest == 0, F.lit(None)).when(ten == 0, u).when(unit == 0, v).when(ten == 1, F.concat(u, F.lit(" عشره"))).otherwise(F.concat(u, F.lit(" و"), v))
    return F.concat_ws(" و", small, _pick(HUNDREDS, hundred - 1))


@query("SELECT o_orderkey, (o_orderkey % 999 + 1)::INTEGER AS year FROM orders")
def number_words(spark, d):
    """Numbers of orders in words, read back."""
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 999 + 1).alias("n"))
    return o.select("o_orderkey", H.year_words(_words(F.col("n"))).alias("year"))


_N = "(o_orderkey * 7 % 899 + 100)::INTEGER"


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS c, {_N} AS n, (o_orderkey % 70 + 20)::INTEGER AS m, (o_orderkey % 9 + 1)::INTEGER AS u, (o_orderkey % 60 + 1)::INTEGER AS s FROM orders)
SELECT k, 'death' AS kind, n AS value, NULL::INTEGER AS until, true AS explicit, false AS shared, NULL AS qualifier, 'exact' AS "precision", 0.85::DOUBLE AS confidence FROM o WHERE c IN (0, 1)
UNION ALL SELECT k, 'birth', n - 50, NULL, n - 50 >= 100, false, NULL, CASE WHEN n - 50 >= 100 THEN 'exact' ELSE 'approximate' END, CASE WHEN n - 50 >= 100 THEN 0.85 ELSE 0.65 END FROM o WHERE c = 1
UNION ALL SELECT k, 'death', m, NULL, false, false, NULL, 'approximate', 0.65 FROM o WHERE c = 2
UNION ALL SELECT k, 'death', n, NULL, true, false, 'بعد', 'exact', 0.85 FROM o WHERE c = 3
UNION ALL SELECT k, 'death', n, least(999, n + s), true, false, 'range', 'approximate', 0.6 FROM o WHERE c = 4 AND least(999, n + s) > n"""
)
def date_assertions(spark, d):
    """What texts of orders say of births and deaths: digits and words, bounds, ranges, bare years without a century, and nothing."""
    n = (F.col("o_orderkey") * 7 % 899 + 100).cast("int")
    k, year, upto = F.col("o_orderkey"), F.lit("سنه "), F.least(F.lit(999), n + (F.col("o_orderkey") % 60 + 1).cast("int"))
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("ثقه مات "), year, _words(n))).when(k % 6 == 1, F.concat(F.lit("ولد "), year, (n - 50).cast("string"), F.lit(" ومات "), year, n.cast("string")))
        .when(k % 6 == 2, F.concat(F.lit("مات "), year, _words(k % 70 + 20))).when(k % 6 == 3, F.concat(F.lit("توفي بعد "), year, _words(n)))
        .when((k % 6 == 4) & (upto > n), F.concat(F.lit("مات من "), _words(n), F.lit(" الي "), _words(upto))).otherwise(F.lit("صدوق ربما وهم"))
    )
    a = t(spark, d, "orders").select(k.alias("k"), F.explode(H.date_assertions(text)).alias("a"))
    return a.select("k", "a.kind", "a.value", "a.until", "a.explicit", "a.shared", "a.qualifier", H.precision(F.col("a")).alias("precision"), "a.confidence")


@query(
    """WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 140)::INTEGER AS n FROM orders), w AS (SELECT *, (n % 10 > 0)::INTEGER + (n % 100 >= 10)::INTEGER + (n >= 100)::INTEGER AS words FROM o)
SELECT k, CASE WHEN k % 3 > 0 AND n BETWEEN 15 AND 130 AND words <= 2 AND n % 100 NOT BETWEEN 11 AND 19 THEN n END AS age FROM w"""
)
def ages_and_births(spark, d):
    """Ages that texts of orders tell; under 15 and over 130 are none, and neither are those of other than a word or two that
    `and` joins."""
    n = F.col("o_orderkey") % 140
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("مات ثقه")).otherwise(F.concat(F.lit("مات وله "), F.when(n > 0, _words(n)).otherwise(F.lit("صفر")), F.lit(" سنه")))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), H.age_at_death(text).alias("age"))


# a record of transmission for each order: its chain is its lineitems' suppliers, its page one in five orders, a book each 100 pages
_ROW = "row_number() OVER (ORDER BY o_orderkey) - 1"


def _record_pages(spark, d: str) -> DataFrame:
    """(work, page, vol, text): five orders a page, in the order of their keys."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    name = _pick(NAMES, (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % len(NAMES))
    chain = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", name.alias("name")))).alias("x"))  # a few lines an order
    names = F.transform("x", lambda y: y["name"])
    said = F.concat(F.lit("حدثنا "), F.array_join(names, "، عن "))
    k = F.col("o_orderkey")
    body = (
        F.when(k % 5 == 1, F.lit("باب في الإيمان")).when((k % 5 == 2) | F.col("x").isNull(), F.lit("كلام بلا إسناد ولا شيء يذكر")).when(k % 5 == 3, F.concat(said, F.lit("، بمثله.")))
        .otherwise(F.concat(said, F.lit("، قال: «انما الاعمال بالنيات رقم "), k.cast("string"), F.lit("»")))
    )
    o = t(spark, d, "orders").select("o_orderkey").join(chain, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", body.alias("body"))
    page = F.floor(k / 20).cast("int")
    line = F.concat((k % 9000 + 1).cast("string"), F.lit(" - "), F.col("body"))
    pages = o.groupBy(page.alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("t")))), lambda y: y["t"]), "\n").alias("text"))
    title = F.when(F.col("page") % 25 == 0, F.concat(F.lit('<span data-type="title">'), (F.floor(F.col("page") / 25) + 1).cast("string"), F.lit(" - كتاب الايمان</span>\n"))).otherwise("")
    return pages.select(F.lit("b").alias("work"), "page", F.lit("1").alias("vol"), F.concat(title, "text").alias("text"))


def _imported(spark, d: str) -> DataFrame:
    pages = I.headings(_record_pages(spark, d), "work", "page")
    return I.records(I.segments(pages, "bukhari"), "bukhari")


_RECORDS = f"""c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS k, (o_orderkey // 20)::INTEGER AS page, (o_orderkey % 9000 + 1)::INTEGER AS number, o_orderkey % 5 AS kind, n IS NULL AS none FROM orders LEFT JOIN c ON l_orderkey = o_orderkey)"""


@query(
    f"""WITH {_RECORDS}, b AS (SELECT DISTINCT page, max(CASE WHEN page % 25 = 0 THEN page // 25 + 1 END) OVER (ORDER BY page) AS book FROM r)
SELECT concat_ws('-', 'bukhari', number, number, page) AS id, CASE WHEN kind = 1 THEN 'structural-heading' WHEN kind = 2 OR none THEN 'unparsed' WHEN kind = 3 THEN 'hadith-reference' ELSE 'hadith' END AS class,
CASE WHEN kind = 1 THEN 'structural-heading' WHEN kind = 2 OR none THEN NULL WHEN kind = 3 THEN 'reference-record' ELSE 'quote-open' END AS rule,
CASE WHEN kind = 1 THEN 0.85 WHEN kind = 2 OR none THEN 0 WHEN kind = 3 THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence,
CASE WHEN kind = 2 OR kind <> 1 AND none THEN 'transmission-term-not-found' END AS error, kind NOT IN (1, 2) AND NOT none AS strong, book || ' - كتاب الايمان' AS book FROM r JOIN b USING (page)"""
)
def imported_records(spark, d):
    """Records of a work of all orders: numbers, classes, rules, reasons, and the book that its pages carry forward."""
    return _imported(spark, d).select("id", "class", "rule", "confidence", "error", "strong", "book")


@query(f"WITH {_RECORDS} SELECT CASE WHEN kind = 1 THEN 'structural-heading' WHEN kind = 2 OR none THEN 'unparsed' WHEN kind = 3 THEN 'hadith-reference' ELSE 'hadith' END AS class, count(*) AS n FROM r GROUP BY 1")
def imported_classes(spark, d):
    return _imported(spark, d).groupBy("class").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_RECORDS}, l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS i, {_sql(NAMES)}[((l_suppkey * 7 + l_linenumber) % {len(NAMES)} + 1)::INTEGER] AS form, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
f AS (SELECT k, form, min(i) AS i FROM l WHERE k % 5 <> 3 OR i < n GROUP BY k, form)
SELECT concat_ws('-', 'bukhari', number, number, page) || '#c0' AS chain_id, (row_number() OVER (PARTITION BY r.k ORDER BY i) - 1)::INTEGER AS position, form, CASE WHEN i = 1 THEN 'حدثنا' ELSE 'عن' END AS term FROM r JOIN f USING (k) WHERE kind IN (0, 3, 4)"""
)
def imported_narrators(spark, d):
    """The narrators of each order's chain, each once, by the place where it first stands. A record that refers to another ends at its
    last term, so the name after it is no narrator."""
    return I.narrators(I.chains(_imported(spark, d))).select("chain_id", "position", "form", "term")


# a registry entry for each customer: three a page, some over two pages with a footnote between
def _entry_pages(spark, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(_pick(FIRST, k % 7), F.lit(" بن "), _pick(SECOND, k % 5), F.lit("، ابو "), _pick(KUNYAS, k % 3), F.lit(" "), _pick(NISBAS, k % 4))
    signs = F.when(k % 4 == 1, F.lit("(خ م) ")).when(k % 4 == 2, F.lit("د ت - ")).otherwise(F.lit(""))
    ordinal = _pick(I.ORDINALS[:10], k % 10)
    start = F.concat(F.lit("["), (k % 90_000 + 1).cast("string"), F.lit("] "), signs, name, F.lit(" ثقه روي عن "), _pick(TEACHERS, k % 4), F.lit("، و"), _pick(TEACHERS, (k + 1) % 4), F.lit(" روي عنه "), _pick(STUDENTS, k % 3))
    rest = F.concat(F.lit("، و"), _pick(STUDENTS, (k + 1) % 3), F.lit(" ثقه من "), ordinal, F.lit(" مات سنه "), _words(k % 899 + 100))
    page = F.floor(k / 3).cast("int") * 2
    whole = F.when(k % 3 == 2, start).otherwise(F.concat(start, rest))
    first = t(spark, d, "customer").select(page.alias("page"), k.alias("o"), whole.alias("t"))
    after = t(spark, d, "customer").where(k % 3 == 2).select((page + 1).alias("page"), k.alias("o"), rest.alias("t"))
    pages = first.unionByName(after).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda y: y["t"]), "\n").alias("text"))
    return pages.select(F.lit("t").alias("work"), "page", F.concat("text", F.lit("\n_____\nحاشيه [7] لا شيء")).alias("text"))


def _read_entries(spark, d: str) -> DataFrame:
    return I.entry_fields(I.entries(stored(_entry_pages(spark, d)), "work", "page", "tahdhib"))


@query(
    f"""SELECT (c_custkey % 90000 + 1)::INTEGER AS number, (c_custkey // 3 * 2)::INTEGER AS page, (c_custkey // 3 * 2 + CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END)::INTEGER AS last_page,
{_sql(FIRST)}[(c_custkey % 7 + 1)::INTEGER] || ' بن ' || {_sql(SECOND)}[(c_custkey % 5 + 1)::INTEGER] || '، ابو ' || {_sql(KUNYAS)}[(c_custkey % 3 + 1)::INTEGER] || ' ' || {_sql(NISBAS)}[(c_custkey % 4 + 1)::INTEGER] AS name,
CASE c_custkey % 4 WHEN 2 THEN 'د ت' ELSE '' END AS sigla, 'ابو ' || {_sql(KUNYAS)}[(c_custkey % 3 + 1)::INTEGER] AS kunya, {_sql(PLACES)}[(c_custkey % 4 + 1)::INTEGER] AS region, (c_custkey % 10 + 1)::INTEGER AS generation,
{_sql(TEACHERS)}[(c_custkey % 4 + 1)::INTEGER] || ',و' || {_sql(TEACHERS)}[((c_custkey + 1) % 4 + 1)::INTEGER] AS teachers, {_sql(STUDENTS)}[(c_custkey % 3 + 1)::INTEGER] || ',و' || {_sql(STUDENTS)}[((c_custkey + 1) % 3 + 1)::INTEGER] AS students, (c_custkey % 899 + 100)::INTEGER AS death, '' AS reasons FROM customer"""
)
def imported_entries(spark, d):
    """Registry entries of all customers over their pages: signs, names, fields, generations, teachers, students, deaths. Signs in
    brackets after a number belong to the marker."""
    e = _read_entries(spark, d)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return e.select("number", "page", "last_page", "name", joined("sigla"), "kunya", "region", F.col("generation.ordinal").alias("generation"), joined("teachers"), joined("students"), H.first_of(H.date_assertions(F.col("normalized")), "death")["value"].alias("death"), joined("reasons"))


@query(
    f"""WITH c AS (SELECT c_custkey AS k, (c_custkey % 90000 + 1)::INTEGER AS number FROM customer)
SELECT number, 'teacher' AS list, i::INTEGER AS place, CASE i WHEN 1 THEN 'و' ELSE '' END || {_sql(TEACHERS)}[((k + i) % 4 + 1)::INTEGER] AS mention FROM c, range(0, 2) x(i)
UNION ALL SELECT number, 'student', i::INTEGER, CASE i WHEN 1 THEN 'و' ELSE '' END || {_sql(STUDENTS)}[((k + i) % 3 + 1)::INTEGER] FROM c, range(0, 2) x(i)"""
)
def imported_mentions(spark, d):
    """Teachers and students of all customers' entries, one by one."""
    e = _read_entries(spark, d)
    one = lambda k: e.select("number", F.lit(k).alias("list"), F.posexplode(k + "s").alias("place", "mention"))
    return one("teacher").unionByName(one("student"))


@query(
    f"""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '(خ م)' WHEN 1 THEN 'د ت' WHEN 2 THEN 'م)' ELSE '[خ د]' END AS sigla, CASE WHEN p_partkey % 3 = 0 THEN 'بضم الراء' ELSE '' END AS notes, CASE WHEN p_partkey % 2 = 0 THEN 'ابن ' || {_sql(SECOND)}[(p_partkey % 5 + 1)::INTEGER] || ' بن هاشم' ELSE '' END AS forms,
{_sql(FIRST)}[(p_partkey % 7 + 1)::INTEGER] || ' بن ' || {_sql(SECOND)}[(p_partkey % 5 + 1)::INTEGER] AS name FROM part"""
)
def imported_head_parts(spark, d):
    """Heads of all parts: signs of sources in their kinds, notes on spelling, other forms, and the name."""
    from tesserae.functions.names import name_head
    from tesserae.functions.scalars import normalize

    k = F.col("p_partkey")
    name = F.concat(_pick(FIRST, k % 7), F.lit(" بن "), _pick(SECOND, k % 5))
    signs = F.when(k % 4 == 0, "(خ م) ").when(k % 4 == 1, "د ت - ").when(k % 4 == 2, "م) ").otherwise("")
    head = F.concat(signs, name, F.when(k % 4 == 3, " [خ د]").otherwise(""), F.when(k % 3 == 0, " بضم الراء").otherwise(""), F.when(k % 2 == 0, F.concat(F.lit("، ويقال: ابن "), _pick(SECOND, k % 5), F.lit(" بن هاشم"))).otherwise(""))
    h = t(spark, d, "part").select(k.alias("k"), I.cleaned_head(head).alias("c")).withColumn("h", name_head(F.col("c.head"), normalize(F.col("c.head"))))
    return h.select("k", F.array_join("c.sigla", ",").alias("sigla"), F.array_join("h.notes", ",").alias("notes"), F.array_join("h.forms", ",").alias("forms"), F.col("h.name").alias("name"))


# a page for each document: a title of two letters before empty lines, a remark and markup after the text, or a title and a paragraph
_PAGE = r"""r AS (SELECT doc_id, doc_id % 3 AS kind, lang, source, CASE doc_id % 3 WHEN 0 THEN '<span data-type="title">' || lang || '</span>' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || text
WHEN 1 THEN text || '⦗ص' || doc_id || '⦘&nbsp;<b>' || source || '</b>' ELSE '<span class=x data-type=''title''>' || source || '</span>' || chr(9) || ' ' || chr(10) || '<p>' || text || '</p>' END AS raw FROM documents)"""


@query(
    rf"""WITH {_PAGE}, p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\r|(?i:</?span[^>]*>)', '', 'g'), '<[^>]*>|⦗[^⦘]*⦘|&nbsp;', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain,
CASE kind WHEN 0 THEN lang || '</span>' || chr(13) || chr(10) WHEN 1 THEN substr(raw, 1, 3) ELSE substr(source, 1, 3) END AS span FROM r)
SELECT doc_id, plain, lower(trim(regexp_replace(strip_accents(plain), '\s+', ' ', 'g'))) AS normalized, CASE kind WHEN 0 THEN lang WHEN 2 THEN source END AS title, span, CASE WHEN regexp_matches(span, '[<>⦗⦘]') THEN 'contains-markup' ELSE 'verbatim' END AS integrity FROM p"""
)
def prepared_pages(spark, d):
    """A page of each document in its forms: plain and in the search form with places, its title, and what stands in the raw page where
    the search form's first three letters come from, which may cross markup."""
    from tesserae.functions import chains as C

    k = F.col("doc_id") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit('<span data-type="title">'), "lang", F.lit("</span>\r\n\n\n\n"), "text")).when(k == 1, F.concat("text", F.lit("⦗ص"), F.col("doc_id").cast("string"), F.lit("⦘&nbsp;<b>"), "source", F.lit("</b>")))
        .otherwise(F.concat(F.lit("<span class=x data-type='title'>"), "source", F.lit("</span>\t \n<p>"), "text", F.lit("</p>")))
    )
    cut = lambda c, s: F.substring(c, s["start"] + 1, s["end"] - s["start"])
    p = C.prepared_with_span(t(spark, d, "documents").select("doc_id", raw.alias("raw")), "raw", 0, 3).withColumn("span", cut(F.col("raw"), F.col("span")))
    return p.select("doc_id", "plain", "normalized", cut(F.col("plain"), F.get("titles", F.lit(0))).alias("title"), "span", span_integrity(F.col("span")).alias("integrity"))


# of a part's biography each section is a critic's or one of the other kinds; one in five states two things in each, one in four over two lines
_STATED = f"""s AS (SELECT p_partkey AS id, unnest(range(0, p_partkey % 3 + 1)) AS i FROM part), x AS (SELECT id, i, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS most, unnest(range(0, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END)) AS j FROM s)"""


@query(
    f"""WITH {_STATED} SELECT id, {_sql(HEADINGS)}[((id + i) % {len(HEADINGS)} + 1)::INTEGER] AS critic, {_sql(KINDS)}[((id + i) % {len(HEADINGS)} + 1)::INTEGER] AS kind, {_sql(PHRASES)}[((id + 2 * i + j) % 4 + 1)::INTEGER] || CASE WHEN j = 0 AND id % 4 = 1 THEN ' وأدركه' ELSE '' END AS phrase,
{_sql(WORKS)}[((id + i + j) % 4 + 1)::INTEGER] AS work, (id % 40 + 1)::VARCHAR AS volume, (id % 700 + i + j)::VARCHAR AS page, CASE WHEN id % 2 = 0 AND j = 0 THEN (id % 900 + 1)::INTEGER END AS source_page, (i * most + j)::INTEGER AS n FROM x"""
)
def imported_criticisms(spark, d):
    """Statements in biographies of all parts, with their kinds and citations: of critics, and of hearing, disconnection, comparison and
    the rest. Some sections state two things, some phrases stand on two lines, some texts have carriage returns, some critics a colon,
    and sections of two lines state nothing."""
    k = F.col("p_partkey")
    cited = lambda i, j: F.concat(_pick(WORKS, (k + i + j) % 4), F.lit(" ("), (k % 40 + 1).cast("string"), F.lit("/ "), (k % 700 + i + j).cast("string"), F.lit(")"))
    phrase = lambda i, j: _pick(PHRASES, (k + 2 * i + j) % 4)
    heading = lambda i: F.concat(F.when(k % 11 == 0, ": ").otherwise(""), _pick(HEADINGS, (k + i) % len(HEADINGS)))
    part = lambda i: F.concat_ws("\n", heading(i), phrase(i, 0), F.when(k % 4 == 1, "وأدركه"), cited(i, 0), F.when(k % 2 == 0, (k % 900 + 1).cast("string")), F.when(k % 5 == 0, F.concat_ws("\n", phrase(i, 1), cited(i, 1))))
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 3), part), "\n\n\n\n"), F.when(k % 7 == 3, "\n\n\nسطر\nواحد").otherwise(""))
    text = F.when(k % 13 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    c = I.criticisms(t(spark, d, "part").select(k.alias("id"), text.alias("text")), "id", "text")
    return c.select("id", "critic", "kind", "phrase", "work", "volume", "page", "source_page", "n")


@query(
    """WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title FROM pages), r AS (SELECT page_id, trim(regexp_replace(regexp_replace(title, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM p)
SELECT page_id, title FROM r"""
)
def titles_without_markup(spark, d):
    """First headings of web pages without their markup."""
    title = F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    return t(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(strip_markup(title), r"\s+", " ")).alias("title"))
