"""Identity proposals for a whole corpus: distinct forms, profiles of entries, blocking, scores, hard rules, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import relative as R
from tesserae.functions.scalars import level, normalize, normalize_each
from tesserae.operators import resolve, scoring
from tesserae.sources.scratch import small, stored

# Signs by which an entry names a collection, and the compilers that its students may name.
SIGLA = {"bukhari": ["خ", "خت", "ع", "صح"], "muslim": ["م", "ع", "صح"]}
COMPILERS = {"bukhari": "البخاري", "muslim": "مسلم"}
#: Postings that a form may ask for, and candidates that it keeps.
BUDGET, KEPT = 1500, 8


def classified(occurrences: DataFrame) -> DataFrame:
    """occurrences (chain, position, raw, prophet) with a (the analysis of the form), form (what it is looked up by) and kind:
    prophet, prophet-form (a form that is a prophet's elsewhere), relative, empty or name.

    Surfaces are few beside occurrences: each is read once, and occurrences take what was read from it."""
    prophet = F.coalesce("prophet", F.lit(False))
    s = occurrences.groupBy("raw").agg(F.bool_or(prophet).alias("_p"))
    s = s.withColumn("a", R.analysis(F.col("raw"))).withColumn("_n", normalize(F.col("raw")))
    s = stored(s.withColumn("form", R.form_of(F.col("raw"), F.col("a"))))
    known = s.where("_p and _n <> ''").select("_n").distinct().withColumn("_known", F.lit(True))
    s = small(s.drop("_p").withColumnRenamed("raw", "_raw").join(known, "_n", "left").drop("_n"))
    met = occurrences.join(s, F.col("raw").eqNullSafe(F.col("_raw")))
    kind = F.when(prophet, "prophet").when(F.col("_known"), "prophet-form").when(F.col("a.relative") & F.col("a.unresolvable"), "relative").when(F.col("form").isNull(), "empty").otherwise("name")
    return met.withColumn("kind", kind).drop("_raw", "_known")


def distinct_forms(occurrences: DataFrame) -> DataFrame:
    """(form, occurrences, first_chain, first_position) of the names; relative ones that name no one stay in their places."""
    names = classified(occurrences).where("kind = 'name'")
    return names.groupBy("form").agg(F.count("*").alias("occurrences"), F.min(F.struct("chain", "position")).alias("p")).select("form", "occurrences", F.col("p.chain").alias("first_chain"), F.col("p.position").alias("first_position"))


def form_counters(occurrences: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: occurrences of each kind, distinct forms, and how many occurrences a form stands for on average. Relative
    forms count with those that name someone beside. weight: a column that says how often a row occurs."""
    c = classified(occurrences)
    w = F.col(weight) if weight else F.lit(1).cast("long")
    total = lambda when: F.coalesce(F.sum(F.when(when, w)), F.lit(0).cast("long"))
    n = lambda k: total(F.col("kind") == k)
    relative = total(~F.col("kind").isin("prophet", "prophet-form") & F.col("a.relative"))
    return c.agg(total(F.lit(True)).alias("occurrences"), n("prophet").alias("by_flag"), n("prophet-form").alias("by_form"), relative.alias("relative"), n("empty").alias("empty"), F.countDistinct(F.when(F.col("kind") == "name", F.col("form"))).alias("forms"), n("name").alias("covered")).withColumn("factor", F.coalesce(F.round(F.try_divide("covered", "forms"), 2), F.lit(0.0)))


def relatives(occurrences: DataFrame) -> DataFrame:
    """(chain, position, kinship, match, anchor, anchor_position, complete, reason) of the relative forms."""
    c = classified(occurrences).where("kind not in ('prophet', 'prophet-form') and a.relative").withColumn("r", R.resolution(F.col("a"), F.col("position")))
    return c.select("chain", "position", "a.kinship", "a.match", "r.*")


def head_tokens(entries: DataFrame) -> DataFrame:
    """(token, id): the words of an entry's name, chain of names, kunya and nisbas; its biography is left out."""
    none = F.array().cast("array<string>")
    words = F.flatten(F.array(R.name_tokens(F.coalesce("name", F.lit(""))), F.flatten(R.name_tokens_each(F.coalesce("chain_names", none))), R.name_tokens(F.coalesce("kunya", F.lit(""))), F.flatten(R.name_tokens_each(F.coalesce("nisbas", none)))))
    return entries.select(F.explode(F.array_distinct(words)).alias("token"), "id")


def collections_of(sigla: Column, students: Column) -> Column:
    """The collections that an entry's signs or its students' names point to."""
    signs = F.split(F.regexp_replace(F.array_join(F.coalesce(sigla, F.array().cast("array<string>")), " "), r"[\[\](),،]", " "), r"\s+")
    named = F.array_join(F.coalesce(students, F.array().cast("array<string>")), " ")
    hit = lambda c: F.arrays_overlap(signs, F.array(*[F.lit(x) for x in SIGLA[c]])) | named.contains(COMPILERS[c])
    return F.array_compact(F.array(*[F.when(hit(c), c) for c in SIGLA]))


def profiles(entries: DataFrame) -> DataFrame:
    """What an entry says of its person: names, variants, regions, death, mentions of teachers and students, collections."""
    none = F.array().cast("array<string>")
    full = lambda *cs: F.filter(F.array_compact(F.array(*cs)), lambda x: x != "")
    some = lambda c: F.filter(F.coalesce(c, none), lambda x: x != "")
    return entries.select(
        "id", full(F.col("name"), F.col("name_chain")).alias("names"), F.concat(full(F.col("kunya")), some(F.col("nisbas"))).alias("variants"), normalize_each(full(F.col("region"), F.col("residence"))).alias("regions"), "death",
        some(F.col("teachers")).alias("teachers"), some(F.col("students")).alias("students"), collections_of(F.col("sigla"), F.col("students")).alias("collections"),
    )


def candidates(forms: DataFrame, entries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(form, id) of the entries that a form's words lead to, within the budget."""
    index = head_tokens(entries)
    tokens = forms.select("form", F.explode(F.array_distinct(R.name_tokens(F.col("form")))).alias("token")).join(resolve.posting_sizes(index), "token")
    return resolve.within_budget(tokens, index, budget).where("used").join(index, "token").select("form", "id").distinct()


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (form, the context columns citing, cited, region, collection, year and chronology, and a profile) with score and
    blocked. chronology: possible, impossible or insufficient against the neighbours. Null context counts for nothing."""
    none = F.array().cast("array<string>")
    p = pairs.withColumns({"_w": R.name_tokens(F.col("form")), "_n": normalize_each(F.col("names")), "_nt": R.name_tokens_each(F.col("names")), "_v": normalize_each(F.col("variants")), "_vt": R.name_tokens_each(F.col("variants"))})
    forms = lambda c: R.name_tokens_each(F.coalesce(c, none))
    p = p.withColumns({"_citing": forms("citing"), "_cited": forms("cited"), "_teachers": R.mention_bags(F.col("teachers")), "_students": R.mention_bags(F.col("students")), "_region": normalize(F.col("region"))})
    same = F.array_contains("_n", F.col("form"))
    name = F.when(same, 1.0).otherwise(F.coalesce(F.array_max(F.transform("_nt", lambda n: scoring.overlap_ratio(F.col("_w"), n))), F.lit(0.0)))
    s1 = F.when(name >= scoring.LEAST_SIMILARITY, F.round(scoring.WEIGHTS["name"] * name, 4)).otherwise(0.0)
    variant = F.array_contains("_v", F.col("form")) | F.exists("_vt", lambda v: (F.size(v) > 0) & (F.size(F.array_except(v, F.col("_w"))) == 0))
    s2 = F.when(variant & ~same, scoring.WEIGHTS["variant"]).otherwise(0.0)
    s3 = scoring.neighbour_signal(F.col("_citing"), F.col("_cited"), F.col("_teachers"), F.col("_students"))
    blocked = F.coalesce(F.col("chronology") == "impossible", F.lit(False)) | F.coalesce("source_conflict", F.lit(False))
    s4 = scoring.flag_signal("chronology", (F.col("chronology") == "possible") & ~blocked)
    s5 = scoring.flag_signal("region", F.array_contains("regions", F.col("_region")) & F.col("region").isNotNull())
    s6 = scoring.flag_signal("book", F.array_contains("collections", F.col("collection")))
    s7 = scoring.flag_signal("death", F.coalesce(F.col("year") > F.col("death"), F.lit(False)))
    return p.withColumns({"score": scoring.total(s1, s2, s3, s4, s5, s6, s7), "blocked": blocked}).select(*pairs.columns, "score", "blocked")


CONTEXT = {"citing": "array<string>", "cited": "array<string>", "region": "string", "collection": "string", "year": "int", "chronology": "string", "source_conflict": "boolean"}


def ranked(forms: DataFrame, entries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(form, id, score, blocked, competing, place) of each form's best candidates. A form that only means a relative gets
    none. Context columns that forms have not are null."""
    missing = {k: F.lit(None).cast(t) for k, t in CONTEXT.items() if k not in forms.columns}
    named = forms.withColumns(missing).where(~R.analysis(F.col("form"))["unresolvable"])
    pairs = candidates(named, entries, budget).join(named, "form").join(profiles(entries), "id")
    best = scoring.ranked(scored(pairs).select("form", "id", "score", "blocked"), "form", "id", KEPT)
    return scoring.competing(best, "form", "id").withColumn("blocked", F.col("blocked") | F.col("competing"))


def batch(forms: DataFrame, entries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(form, id, score, level, auto_link, n_candidates) for every form: its proposal, or unresolved without one."""
    counts = candidates(forms, entries, budget).groupBy("form").agg(F.count("*").alias("n_candidates"))
    p = scoring.proposals(ranked(forms, entries, budget), "form", "id")
    out = forms.select("form").join(p, "form", "left").join(counts, "form", "left")
    return out.select("form", "id", "score", F.coalesce("level", F.lit("unresolved")).alias("level"), F.coalesce("auto_link", F.lit(False)).alias("auto_link"), F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"))


def batch_stats(proposed: DataFrame) -> DataFrame:
    """One row: forms, those without a candidate, candidates in all, on average and at most, proposals of each level."""
    n = lambda v: F.count_if(F.col("level") == v).alias(v)
    return proposed.agg(F.count("*").alias("forms"), F.count_if(F.col("n_candidates") == 0).alias("without"), F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("total"), F.round(F.avg("n_candidates"), 1).alias("mean"), F.max("n_candidates").alias("most"), *map(n, ("high", "medium", "low", "unresolved", "conflict")), F.count_if("auto_link").alias("auto_link"))


def measures(occurrences: DataFrame, entries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(measure, name, value): counters of forms, relatives by kinship and by place, postings, proposals. Equal surfaces are counted
    once and read once."""
    row = lambda df, measure: df.select(F.lit(measure).alias("measure"), F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "value"))
    sizes = resolve.posting_sizes(head_tokens(entries)).agg(F.count("*").alias("tokens"), F.sum("n").alias("postings"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))
    surfaces = stored(occurrences.groupBy("raw", "prophet").agg(F.count("*").alias("n")))
    forms = stored(classified(surfaces).select("form", "kind", "a", "n"))
    named = forms.where("kind = 'name'").select("form").distinct()
    rel = forms.where("kind not in ('prophet', 'prophet-form') and a.relative").select("a.kinship", "a.match", "n")
    by = lambda c: rel.groupBy(c).agg(F.sum("n").cast("double").alias("value")).select(F.lit(f"relatives_by_{c}").alias("measure"), F.col(c).alias("name"), "value")
    out = row(form_counters(surfaces, "n"), "forms").unionByName(row(sizes, "index")).unionByName(row(batch_stats(batch(named, entries, budget)), "batch"))
    return out.unionByName(by("kinship")).unionByName(by("match"))


def chosen(ranks: DataFrame, group: str, hits: str | None = None) -> DataFrame:
    """Of each group's registry hits (rank, id): exact ones if there are any, else all; the first, and how many. hits: a column that says
    how many hits a row stands for, of which id is the first."""
    n = F.col(hits) if hits else F.lit(1).cast("long")
    exact = F.col("rank") == 0
    g = ranks.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(F.struct("rank", "id")).alias("m"), F.sum(n).alias("_all"), F.sum(F.when(exact, n)).alias("_exact"))
    return g.select(group, F.col("m.id").alias("id"), F.coalesce("_exact", "_all").alias("hits"), level(F.lit(None).cast("double")).alias("level"))
