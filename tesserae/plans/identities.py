"""Bindings of relative forms, statements, identities and evaluation to a small archive given as rows, each with its SQL or
the rows that must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import relative as R
from tesserae.functions import statements as T
from tesserae.operators import editorial, gold, identities, scoring
from tesserae.operators.resolve import bounds_verdict, rank_names
from tesserae.plans.catalogue import given, query, t
from tesserae.plans.literal import Literal, ctes

FORMS = Literal(
    "forms",
    "k int, surface string, position int",
    [(1, "عن أبيه", 2), (2, "أبيه عروة", 1), (3, "عروة عن جده", 0), (4, "رجل", 3), (5, "رجل من الأنصار", 1), (6, "بعض أصحابه", 4), (7, "مالك بن أنس", 0), (8, "أبي", 1), (9, "أبي هريرة", 1), (10, "", 0), (11, None, 0), (12, "هشام أخيه الأكبر", 5)],
)


@given(
    """SELECT * FROM (VALUES (1, true, 'whole', 'father', true, '', 'citing-narrator', 1, true, 'relative-anchored-unnamed'), (2, true, 'leading-apposition', 'father', false, 'عروه', 'citing-narrator', 0, true, 'relative-anchored-named-apposition'),
(3, true, 'trailing', 'grandfather', false, 'عروه عن', 'collector-outside-chain', NULL, true, 'relative-anchor-outside-chain'), (4, true, 'whole', 'unnamed_man', true, '', 'none', NULL, true, 'anonymous-surface-no-anchor'),
(5, true, 'leading-apposition', 'unnamed_man', true, '', 'none', NULL, true, 'anonymous-surface-no-anchor'), (6, true, 'whole', 'unnamed_group', true, '', 'citing-narrator', 3, false, 'relative-anchored-unnamed'), (7, false, 'none', NULL, false, 'مالك بن انس', NULL, NULL, NULL, NULL),
(8, true, 'whole', 'father', true, '', 'citing-narrator', 0, true, 'relative-anchored-unnamed'), (9, false, 'none', NULL, false, 'ابي هريره', NULL, NULL, NULL, NULL), (10, false, 'none', NULL, false, '', NULL, NULL, NULL, NULL), (11, false, 'none', NULL, false, '', NULL, NULL, NULL, NULL),
(12, true, 'internal', 'brother', false, 'هشام الاكبر', 'citing-narrator', 4, true, 'relative-anchored-named-apposition')) v(k, relative, "match", kinship, unresolvable, rest, anchor, anchor_position, complete, reason)"""
)
def relative_forms(spark, d):
    """Relative words in a form, where they stand, and whom they hang on."""
    f = FORMS.df(spark).withColumn("a", R.analysis(F.col("surface"))).withColumn("r", R.resolution(F.col("a"), F.col("position")))
    return f.select("k", "a.relative", "a.match", "a.kinship", "a.unresolvable", "a.rest", "r.anchor", "r.anchor_position", "r.complete", "r.reason")


MENTIONS = Literal(
    "mentions",
    "id string, head string, text string, teachers array<string>, students array<string>",
    [
        ("t-1", "مالك بن أنس", "روى عن نافع وحماد بن زيد وجماعة وأبيه قال وعنه يحيى القطان ووكيع ونافع", ["نافع (خ)", "وحماد بن زيد", "وجماعة", "أبيه", "قال فلان", "نافع", "الزهري", "مالك بن أنس"], ["يحيى القطان", "ووكيع", "", "قيل. آخر"]),
        ("t-2", None, "روى عن نافع", ["نافع"], None),
        ("t-3", "شعبة", None, ["قتادة"], []),
        ("t-4", "سفيان", "روى عن عمرو بن دينار في الحديث ووهب وعطاء", ["عمرو بن دينار في الحديث", "وهب وعطاء", "أخوه", "وهب"], None),
    ],
)


@given(
    """SELECT * FROM (VALUES ('t-1', 'teacher', 0, 'نافع', NULL), ('t-1', 'teacher', 1, 'حماد بن زيد', NULL), ('t-1', 'teacher', 2, 'جماعة', 'no_person_named'), ('t-1', 'teacher', 3, 'أبيه', 'relative_form'), ('t-1', 'teacher', 4, 'قال فلان', 'unsegmented_phrase'),
('t-1', 'teacher', 5, 'نافع', 'duplicate'), ('t-1', 'teacher', 6, 'الزهري', 'phrase_not_in_passage'), ('t-1', 'teacher', 7, 'مالك بن أنس', 'phrase_not_in_passage'), ('t-1', 'student', 0, 'يحيى القطان', NULL), ('t-1', 'student', 1, 'وكيع', NULL),
('t-1', 'student', 2, '', 'empty_after_cleaning'), ('t-1', 'student', 3, 'قيل. آخر', 'unsegmented_phrase'), ('t-2', 'teacher', 0, '', 'subject_not_named'), ('t-3', 'teacher', 0, 'قتادة', 'entry_text_missing'),
('t-4', 'teacher', 0, 'عمرو بن دينار في الحديث', 'unsegmented_phrase'), ('t-4', 'teacher', 1, 'هب وعطاء', 'unsegmented_phrase'), ('t-4', 'teacher', 2, 'أخوه', 'relative_form'), ('t-4', 'teacher', 3, 'هب', NULL)) v(id, list, "index", surface, code)"""
)
def mention_verdicts(spark, d):
    """Mentions of teachers and students, cleaned, with the reason for which each is left out."""
    return T.statements(MENTIONS.df(spark)).select("id", "list", "index", "surface", "code")


@given("SELECT 't-' || i AS id, code, n FROM (VALUES (1, 'rijal_statement_identity_unresolved', 4::BIGINT), (1, 'rijal_statement_no_person_named', 1), (1, 'rijal_statement_relative_form', 1), (1, 'rijal_statement_unsegmented_phrase', 2), (1, 'rijal_statement_duplicate', 1), (1, 'rijal_statement_phrase_not_in_passage', 2), (1, 'rijal_statement_empty_after_cleaning', 1), (2, 'rijal_statement_subject_not_named', 1), (3, 'rijal_statement_entry_text_missing', 1), (4, 'rijal_statement_unsegmented_phrase', 2), (4, 'rijal_statement_relative_form', 1), (4, 'rijal_statement_identity_unresolved', 1)) v(i, code, n)")
def rejection_histogram(spark, d):
    """The review queue's rows by code."""
    return T.review_rows(T.statements(MENTIONS.df(spark))).groupBy("id", "code").agg(F.count("*").alias("n"))


@given("SELECT 't-1' AS id, 'UNC-' || substr(sha1(a), 1, 12) AS teacher, 'UNC-' || substr(sha1(b), 1, 12) AS student FROM (VALUES ('نافع', 'مالك بن انس'), ('حماد بن زيد', 'مالك بن انس'), ('مالك بن انس', 'يحيي القطان'), ('مالك بن انس', 'وكيع')) v(a, b) UNION ALL SELECT 't-4', 'UNC-' || substr(sha1('هب'), 1, 12), 'UNC-' || substr(sha1('سفيان'), 1, 12)")
def statement_relations(spark, d):
    """Accepted statements as relations from teacher to student."""
    return T.statements(MENTIONS.df(spark)).where("code is null").select("id", "teacher", "student")


OCCURRENCES = Literal(
    "occurrences",
    "chain string, position int, raw string, prophet boolean",
    [
        ("a", 0, "مالك بن أنس", False), ("a", 1, "نافع", False), ("a", 2, "ابن عمر", False), ("a", 3, "النبي", True), ("b", 0, "هشام بن عروة", False), ("b", 1, "أبيه", False), ("b", 2, "عائشة", False), ("b", 3, "النبي", False),
        ("c", 0, "مالِكُ بن أنس", False), ("c", 1, "رجل", False), ("c", 2, "", False), ("d", 0, "أبيه عروة", False), ("d", 1, "نافع", None),
    ],
)


@given("SELECT 13::BIGINT AS occurrences, 1::BIGINT AS by_flag, 1::BIGINT AS by_form, 3::BIGINT AS relative, 1::BIGINT AS \"empty\", 6::BIGINT AS forms, 8::BIGINT AS covered, 1.33 AS factor".replace("1.33 AS", "1.33::DOUBLE AS"))
def form_counters(spark, d):
    """Occurrences by kind, distinct forms and their factor."""
    return identities.form_counters(OCCURRENCES.df(spark))


@given("SELECT * FROM (VALUES ('مالك بن انس', 2::BIGINT, 'a', 0), ('نافع', 2, 'a', 1), ('ابن عمر', 1, 'a', 2), ('هشام بن عروه', 1, 'b', 0), ('عاءشه', 1, 'b', 2), ('عروه', 1, 'd', 0)) v(form, occurrences, first_chain, first_position)".replace("عاءشه", "عايشه"))
def distinct_forms(spark, d):
    """The names of a corpus, each once."""
    return identities.distinct_forms(OCCURRENCES.df(spark))


@given("SELECT * FROM (VALUES ('b', 1, 'father', 'whole', 'citing-narrator', 0, true, 'relative-anchored-unnamed'), ('c', 1, 'unnamed_man', 'whole', 'none', NULL, true, 'anonymous-surface-no-anchor'), ('d', 0, 'father', 'leading-apposition', 'collector-outside-chain', NULL, true, 'relative-anchor-outside-chain')) v(chain, position, kinship, \"match\", anchor, anchor_position, complete, reason)")
def relative_references(spark, d):
    return identities.relatives(OCCURRENCES.df(spark))


ENTRIES = Literal(
    "entries",
    "id string, name string, name_chain string, chain_names array<string>, kunya string, nisbas array<string>, region string, residence string, death int, teachers array<string>, students array<string>, sigla array<string>",
    [
        ("e-1", "مالك بن أنس", "مالك بن أنس بن مالك", ["مالك", "أنس"], "أبو عبد الله", ["الأصبحي"], "المدينة", None, 179, ["نافع", "والزهري"], ["وشعبة بن الحجاج", "والبخاري"], ["ع"]),
        ("e-2", "مالك بن دينار", None, ["مالك", "دينار"], "أبو يحيى", [], "البصرة", "المدينة", 130, ["أنس"], [], ["خت"]),
        ("e-3", "أنس بن مالك الأنصاري", None, ["أنس"], None, ["الأنصاري"], "البصرة", None, 93, [], ["ونافع"], ["م"]),
        ("e-4", "نافع مولى ابن عمر", None, [], None, None, "المدينة", None, 117, None, ["مالك بن أنس"], None),
    ],
)
ASKED = Literal(
    "asked",
    "form string, citing array<string>, cited array<string>, region string, collection string, year int, chronology string",
    [
        ("مالك بن انس", ["شعبة بن الحجاج"], ["نافع"], "المدينة", "bukhari", 170, "possible"),
        ("مالك الاصبحي", None, ["الزهري"], None, "bukhari", None, "possible"),
        ("انس بن مالك", ["نافع"], None, "البصرة", "muslim", 100, "impossible"),
        ("ابيه", None, None, None, None, None, None),
        ("فلان", None, None, None, None, None, None),
    ],
)


_SCORED = """s AS (SELECT form, id, score::DOUBLE AS score, blocked FROM (VALUES ('مالك بن انس', 'e-1', 0.72, false), ('مالك بن انس', 'e-2', 0.14, false), ('مالك بن انس', 'e-3', 0.11, false), ('مالك الاصبحي', 'e-1', 0.6, false), ('مالك الاصبحي', 'e-2', 0.31, false), ('مالك الاصبحي', 'e-3', 0.25, false),
('انس بن مالك', 'e-1', 0.28, true), ('انس بن مالك', 'e-2', 0.19, true), ('انس بن مالك', 'e-3', 0.22, true)) v(form, id, score, blocked))"""


@given(f"WITH {_SCORED} SELECT * FROM s")
def archive_scores(spark, d):
    return identities.ranked(ASKED.df(spark), ENTRIES.df(spark)).select("form", "id", "score", "blocked")


@given(
    """SELECT form, id, score::DOUBLE AS score, level, auto_link, n_candidates FROM (VALUES ('مالك بن انس', 'e-1', 0.72, 'medium', false, 3::BIGINT), ('مالك الاصبحي', 'e-1', 0.6, 'low', false, 3), ('انس بن مالك', NULL, NULL, 'conflict', false, 3), ('ابيه', NULL, NULL, 'unresolved', false, 0),
('فلان', NULL, NULL, 'unresolved', false, 0)) v(form, id, score, level, auto_link, n_candidates)"""
)
def archive_proposals(spark, d):
    """The proposal of every form; relatives and unknown names stay unresolved, blocked ones are in conflict."""
    return identities.batch(ASKED.df(spark), ENTRIES.df(spark))


@given("SELECT 5::BIGINT AS forms, 2::BIGINT AS without, 9::BIGINT AS total, 1.8::DOUBLE AS mean, 3::BIGINT AS most, 0::BIGINT AS high, 1::BIGINT AS medium, 1::BIGINT AS low, 2::BIGINT AS unresolved, 1::BIGINT AS conflict, 0::BIGINT AS auto_link")
def batch_report(spark, d):
    return identities.batch_stats(identities.batch(ASKED.df(spark), ENTRIES.df(spark)))


@given(
    """SELECT measure, name, value::DOUBLE AS value FROM (VALUES ('forms', 'occurrences', 13), ('forms', 'by_flag', 1), ('forms', 'by_form', 1), ('forms', 'relative', 3), ('forms', 'empty', 1), ('forms', 'forms', 6), ('forms', 'covered', 8), ('forms', 'factor', 1.33),
('index', 'tokens', 10), ('index', 'postings', 13), ('index', 'largest', 3), ('index', 'singletons', 8), ('relatives_by_kinship', 'father', 2), ('relatives_by_kinship', 'unnamed_man', 1), ('relatives_by_match', 'whole', 2), ('relatives_by_match', 'leading-apposition', 1)) v(measure, name, value)"""
)
def archive_measures(spark, d):
    """The whole run measured, but for the proposals."""
    return identities.measures(OCCURRENCES.df(spark), ENTRIES.df(spark)).where("measure <> 'batch'")


CLAIMS = Literal("claims", "form string, id string, passage string", [("مالك بن انس", "e-1", "p. 12"), ("مالك بن انس", "e-1", "p. 13"), ("مالك بن انس", "e-2", None), ("مالك بن انس", "e-3", "")])


@given(f"WITH {_SCORED}, {CLAIMS.cte} SELECT form, id, EXISTS (SELECT 1 FROM claims c WHERE c.form = s.form AND c.id = s.id AND passage <> '') AS source_conflict FROM s")
def source_conflicts(spark, d):
    """Candidates that a source rules out, with a passage for it."""
    return scoring.source_conflicts(archive_scores(spark, d).select("form", "id"), CLAIMS.df(spark), "form", "id")


@given(f"WITH {_SCORED} SELECT form, min(id) AS id, count(*) AS hits, 'unresolved' AS level FROM s WHERE form <> 'مالك بن انس' OR id = 'e-1' GROUP BY form")
def chain_lookup(spark, d):
    """Registry hits of each form of a chain: exact ones if there are any, else all; the first and how many."""
    ranks = archive_scores(spark, d).select("form", "id", F.when((F.col("form") == "مالك بن انس") & (F.col("id") == "e-1"), 0).otherwise(1).alias("rank"))
    return identities.chosen(ranks, "form")


@query(
    """WITH q AS (SELECT (SELECT min(p_type) FROM part) AS q), r AS (SELECT p_partkey, CASE WHEN p_name = q THEN 0 WHEN p_name <> '' AND (starts_with(p_name, q) OR starts_with(q, p_name)) THEN 1 WHEN contains(p_name, q) THEN 2 WHEN contains(p_type || ' ' || p_brand, q) THEN 3 END AS rank FROM part, q)
SELECT rank, count(*) AS n FROM r WHERE rank IS NOT NULL GROUP BY rank"""
)
def mention_ranking(spark, d):
    """Candidates by name, and after them those whose text mentions the query."""
    part = t(spark, d, "part")
    q = part.agg(F.min("p_type")).first()[0]
    return rank_names(part, F.col("p_name"), q, F.concat_ws(" ", "p_type", "p_brand"), True).groupBy("rank").agg(F.count("*").alias("n"))


LIVES = Literal(
    "lives",
    "k string, event string, lo int, hi int, source string",
    [("a", "birth", 100, 100, "x"), ("a", "death", 160, 160, "x"), ("b", "birth", 140, 142, "x"), ("b", "death", 200, 200, "y"), ("c", "birth", 160, 160, "x"), ("c", "death", 220, 220, "x"), ("d", "birth", 175, 175, "z"), ("d", "death", 230, 235, "z"), ("e", "death", 150, 150, "x"), ("f", "birth", 90, 90, "x"), ("f", "birth", 150, 150, "y"), ("f", "death", 120, 120, "x")],
)
PAIRS = Literal("pairs", "a string, b string", [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("f", "a"), ("f", "d")])


def _lives(spark):
    x = LIVES.df(spark)
    return editorial.life_intervals(x.where("event = 'birth'").selectExpr("k", "lo birth"), x.where("event = 'death'").selectExpr("k", "hi death"), "k")


@given("SELECT * FROM (VALUES ('a', 'b', 'possible', 20, NULL::INTEGER), ('a', 'c', 'impossible', NULL, NULL), ('a', 'd', 'impossible', NULL, 15), ('a', 'e', 'insufficient', NULL, NULL), ('f', 'a', 'possible', 20, NULL), ('f', 'd', 'impossible', NULL, 55)) v(a, b, verdict, overlap_years, gap_years)")
def interval_verdicts(spark, d):
    """Lives compared: overlaps, gaps, touching years, missing births."""
    return editorial.compare_lives(PAIRS.df(spark), _lives(spark), "k")


@given(f"WITH {ctes(LIVES, PAIRS)}, h AS (SELECT DISTINCT x.k FROM lives x JOIN lives y ON x.k = y.k AND x.event = 'birth' AND y.event = 'death' AND x.lo <= y.hi) SELECT a, b, count(*) AS dates, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM pairs JOIN lives ON k IN (a, b) WHERE a IN (SELECT k FROM h) AND b IN (SELECT k FROM h) GROUP BY ALL")
def interval_evidence(spark, d):
    """The dates that a comparison rests on; none where it is insufficient."""
    e = editorial.chronology_evidence(PAIRS.df(spark), _lives(spark), LIVES.df(spark), "k")
    return e.groupBy("a", "b").agg(F.count("*").alias("dates"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@given(f"WITH {ctes(LIVES, PAIRS)}, g AS (SELECT k, min(lo) FILTER (event = 'birth') AS birth, max(hi) FILTER (event = 'death') AS death, string_agg(lo::VARCHAR, ',' ORDER BY lo) FILTER (event = 'birth') AS births FROM lives GROUP BY k) SELECT a, b, CASE WHEN x.birth > y.death THEN 'impossible' WHEN y.birth > x.death THEN 'impossible' WHEN x.birth IS NULL OR y.birth IS NULL THEN 'insufficient' ELSE 'possible' END AS verdict, x.births FROM pairs JOIN g x ON x.k = a JOIN g y ON y.k = b")
def bounds_verdicts(spark, d):
    """The same pairs by their earliest birth and latest death."""
    g = LIVES.df(spark).groupBy("k").agg(F.min(F.when(F.col("event") == "birth", F.col("lo"))).alias("birth"), F.max(F.when(F.col("event") == "death", F.col("hi"))).alias("death"), F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("event") == "birth", F.col("lo")))), lambda y: y.cast("string")), ",").alias("births"))
    p = PAIRS.df(spark).join(g.toDF("a", "birth", "death", "births"), "a").join(g.toDF("b", "birth2", "death2", "x"), "b")
    return p.select("a", "b", bounds_verdict(F.col("birth"), F.col("death"), F.col("birth2"), F.col("death2"))["verdict"].alias("verdict"), F.nullif("births", F.lit("")).alias("births"))


@given(f"WITH {ENTRIES.cte} SELECT c AS cluster, id, death FROM (VALUES ('مالك بن انس'), ('نافع')) v(c) JOIN entries ON replace(name, 'أ', 'ا') = c WHERE death IS NOT NULL")
def dated_clusters(spark, d):
    """Dates of a name by the entries that have exactly that head."""
    from tesserae.functions.scalars import normalize

    asked = spark.createDataFrame([("مالك بن انس",), ("نافع",)], "cluster string")
    e = ENTRIES.df(spark).where("death is not null").select("id", "death", normalize(F.col("name")).alias("cluster"))
    return asked.join(e, "cluster")


# evaluation


@query("WITH u AS (SELECT doc_id, lang FROM documents) SELECT (SELECT count(*) FROM u) / 40.0::DOUBLE AS weight, 40::BIGINT AS n, 40::BIGINT AS ids")
def simple_frame(spark, d):
    """A simple random frame: its size and weight. Which rows are drawn is tested on the generator's numbers."""
    f = gold.simple_frame(t(spark, d, "documents"), "doc_id", 40, "gold")
    return f.groupBy("weight").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query(
    """WITH s AS (SELECT p_brand || '|' || CASE WHEN length(p_name) <= 12 THEN 'L0' WHEN length(p_name) <= 20 THEN 'L1' ELSE 'L2' END || '|' || CASE WHEN starts_with(p_name, 'a') THEN 'K' ELSE '-' END || '|' || CASE WHEN p_size > 25 THEN 'N' ELSE '-' END AS stratum FROM part)
SELECT stratum, count(*) AS cell_size FROM s GROUP BY 1"""
)
def head_strata(spark, d):
    from tesserae.functions.text import length_band

    s = gold.head_stratum(F.col("p_brand"), length_band(F.col("p_name"), [12, 20]), F.startswith("p_name", F.lit("a")), F.col("p_size") > 25)
    return t(spark, d, "part").groupBy(s.alias("stratum")).agg(F.count("*").alias("cell_size"))


@query(
    """WITH h AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), s AS (SELECT CASE WHEN length(p_name) <= 12 THEN 'L0' ELSE 'L1' END || '|' || CASE WHEN starts_with(p_name, 'a') THEN 'K' ELSE '-' END || '|' || CASE WHEN p_size > 25 THEN 'N' ELSE '-' END || '|-|' || CASE WHEN n >= 2 THEN 'H' ELSE '-' END AS stratum FROM part JOIN h USING (p_name))
SELECT stratum, count(*) AS cell_size FROM s GROUP BY 1"""
)
def occurrence_strata(spark, d):
    """Five-part strata with the homonym flag of exact heads."""
    from tesserae.functions.text import length_band
    from tesserae.operators.corpus import named_heads

    p = named_heads(t(spark, d, "part"), "p_name", t(spark, d, "part"), ["p_name"])
    s = gold.occurrence_stratum(length_band(F.col("p_name"), [12]), F.startswith("p_name", F.lit("a")), F.col("p_size") > 25, F.lit(False), F.col("heads") >= 2)
    return p.groupBy(s.alias("stratum")).agg(F.count("*").alias("cell_size"))


FRAME = Literal("frame", "id int, stratum string, cell_size long, weight double", [(1, "a", 4, 2.0), (2, "a", 4, 2.0), (5, "b", 3, 1.0), (5, "b", 3, 1.0), (9, "b", 3, 0.5), (7, "c", 2, 2.0)])
PEOPLE = Literal("people", "id int, stratum string", [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "b"), (6, "b"), (7, "c"), (8, "d")])


@given("SELECT * FROM (VALUES ('duplicate_id', 1::BIGINT), ('unknown_id', 1), ('cell_size', 2), ('weight_sum', 1), ('empty_cell', 1), ('digest', 1)) v(\"check\", n)")
def frame_checks(spark, d):
    return gold.check_frame(FRAME.df(spark), PEOPLE.df(spark), "0" * 32)


_SAID = "id int, annotator string, decision string, narrator string, revision int"
FIRST = Literal("first", _SAID, [(1, "u", "identified", "p", 1), (2, "u", "ambiguous", None, None), (3, "u", "identified", "q", 1), (4, "u", "maybe", None, None), (5, "u", "identified", None, None), (6, "u", "unreadable", "p", 1)])
SECOND = Literal("second", _SAID, [(1, "v", "identified", "p", 1), (2, "v", "identified", "p", 1), (3, "v", "identified", "r", None), (4, "v", "ambiguous", None, None), (7, "v", "ambiguous", None, None)])
THIRD = Literal("third", _SAID, [(2, "w", "ambiguous", None, None), (3, "u", "identified", "q", 1)])


@given("SELECT * FROM (VALUES (4, 'u', 'unknown-decision'), (5, 'u', 'person-missing'), (6, 'u', 'person-unwanted'), (3, 'v', 'revision-missing')) v(id, annotator, code)")
def annotation_errors(spark, d):
    return gold.annotation_errors(FIRST.df(spark).unionByName(SECOND.df(spark)))


@given("SELECT 4::BIGINT AS n, 2::BIGINT AS same_decision, 2::BIGINT AS both_identified, 1::BIGINT AS same_person, 0.5::DOUBLE AS exact")
def annotator_agreement(spark, d):
    return gold.agreement(FIRST.df(spark), SECOND.df(spark))


@given("SELECT * FROM (VALUES (1, 'identified', 'p', 'both'), (2, 'ambiguous', NULL, 'third'), (3, NULL, NULL, 'open'), (4, NULL, NULL, 'open')) v(id, decision, narrator, \"by\")")
def adjudication(spark, d):
    return gold.adjudicated(FIRST.df(spark), SECOND.df(spark), THIRD.df(spark))


@query(
    """WITH j AS (SELECT lang, CASE WHEN quality = 1 THEN doc_id % 3 END AS truth, CASE WHEN n_chars > 800 THEN doc_id % 2 END AS said, toxic = 1 AS conflict, 1.0 + doc_id % 2 AS w FROM documents JOIN labels USING (doc_id)),
g AS (SELECT grouping(lang)::INTEGER AS gid, lang, sum(w) FILTER (said IS NOT NULL AND truth IS NOT DISTINCT FROM said) AS tp, sum(w) FILTER (said IS NOT NULL AND truth IS DISTINCT FROM said) AS fp, sum(w) FILTER (truth IS NOT NULL AND truth IS DISTINCT FROM said) AS fn,
sum(w) FILTER (said IS NOT NULL) AS c, sum(w) FILTER (said IS NULL) AS a, sum(w) FILTER (conflict) AS x, sum(w) AS n FROM j GROUP BY GROUPING SETS ((), (lang))), z AS (SELECT gid, lang, coalesce(tp, 0)::DOUBLE AS tp, coalesce(fp, 0)::DOUBLE AS fp, coalesce(fn, 0)::DOUBLE AS fn, coalesce(c, 0)::DOUBLE AS c, coalesce(a, 0)::DOUBLE AS a, coalesce(x, 0)::DOUBLE AS x, n::DOUBLE AS n FROM g)
SELECT gid, lang, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, round(c / n, 6) AS coverage, round(a / n, 6) AS abstention, round(x / n, 6) AS conflict_rate FROM z"""
)
def weighted_metrics(spark, d):
    """Weighted precision, recall, coverage, abstention and conflict, over all rows and each language."""
    j = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id")
    j = j.select("lang", F.when(F.col("quality") == 1, F.col("doc_id") % 3).alias("truth"), F.when(F.col("n_chars") > 800, F.col("doc_id") % 2).alias("said"), (F.col("toxic") == 1).alias("conflict"), (1.0 + F.col("doc_id") % 2).alias("w"))
    return gold.prediction_metrics(j, ["lang"], "w").dropDuplicates(["gid", "lang"])
