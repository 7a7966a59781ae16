"""Mentions of teachers and students in an entry: cleaned, judged, and turned into relations of two names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.identifiers import cluster_of_name, is_relative
from tesserae.functions.scalars import normalize

# Words that begin a mention of no one in particular, and particles before them.
COLLECTIVE = "غير غيرهم غيرهما غيرهن غيره غيرها اخر اخران اخرون اخرين الاخرون جماعه الجماعه خلق خلائق جمع عده طايفه طائفه ناس اخرهم عدد سوي الباقون باقون شيخان".split()
COLLECTIVE_PARTICLES = ["في", "من", "وفي", "ومن"]
# Words of statements and comments that begin no name.
NO_NAME = (
    "عن حدثنا حدثني حدثناه حدثنيه اخبرنا اخبرني اخبرناه اخبرنيه انبانا انباني نبانا ثنا نا سمعت سمعنا سمع روي يروي يرويه رواه قال وقال قلت قيل وقيل ذكر ذكره وذكره كتب كتبت اخرج اخرجه واخرجه اخرجاه "
    "اخرجا ساق سالت ساله وثقه وثق نسبه ياتي سياتي هو هي هما هم من في لم لن لا ليس كان كانت يكون لانه ان انه انها انما ثم وقد قرا قرات بن له مات توفي عامل حكي ارسل قاله فيه فيحتمل حديثا نسيبه حفيده حفيدها بعضه الصحيح كانه منهم خاليه"
).split()
# Words at which a name goes over into a sentence, and heads that mean a relative.
NO_NAME_INSIDE = "عن عنه عنها في فيه بواسطه حديثا مرسلا خلاف اختلاف قصه القصه مسايل المسايل وحده وحدها".split()
RELATIVE_HEADS = "اخوه اخوها ابوه ابوها والده والدها ولده ولدها ابناه ابنا ابني ابناوه ابناء ابنته زوجها شيخه شيخها".split()
# Words after which a word may begin with the conjunction's letter, and words that always may.
BEFORE_WAW, WITH_WAW = ["بن", "ابن", "ابي", "ابو", "بنت", "ام", "عبد"], ["وسلم"]
MOST_WORDS = 8
_EDGES = r"^[\s.,،؛:\-–—()\[\]]+|[\s.,،؛:\-–—()\[\]]+$"


def _waw(w: Column) -> Column:
    return F.startswith(w, F.lit("و")) & (F.length(w) > 2)


def mention_surface(raw: Column, index: Column) -> Column:
    """A mention without brackets, quotes and marks at its edges, and, after the first, without the conjunction before it."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[(\[][^)\]]*[)\]]", " "), r"[\"«»”“„']", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), _EDGES, "")
    return F.regexp_replace(F.when((index > 0) & _waw(t), F.substring(t, F.lit(2), F.length(t))).otherwise(t), _EDGES, "")


def mention_code(surface: Column, entry_text: Column) -> Column:
    """Why a cleaned mention names no single person, null if it names one that stands in the entry's text. The checks go in
    their order; the first that holds gives the code."""
    at = lambda w, i: F.coalesce(F.get(w, i), F.lit(""))

    def judged(x: Column) -> Column:
        ws, norm, relative = x["ws"], x["norm"], x["relative"]
        head = F.when(at(ws, F.lit(0)).isin(*COLLECTIVE_PARTICLES) & (F.size(ws) > 1), at(ws, F.lit(1))).otherwise(at(ws, F.lit(0)))
        collective = head.isin(*COLLECTIVE) | (_waw(head) & F.substring(head, 2, 1000).isin(*COLLECTIVE))
        rest = F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1)))
        several = F.exists(F.transform(rest, lambda w, i: _waw(w) & ~w.isin(*WITH_WAW) & ~at(ws, i).isin(*BEFORE_WAW)), lambda x: x)
        unsegmented = F.lit("unsegmented_phrase")
        return (
            F.when(surface == "", "empty_after_cleaning").when(surface.contains("."), unsegmented).when(norm == "", "empty_after_cleaning").when(relative, "relative_form")
            .when(F.size(ws) > MOST_WORDS, unsegmented).when(F.exists(ws, lambda w: F.length(w) == 1), unsegmented)
            .when(collective, "no_person_named").when(at(ws, F.lit(0)).isin(*RELATIVE_HEADS), "relative_form").when(at(ws, F.lit(0)).isin(*NO_NAME), unsegmented)
            .when(F.exists(rest, lambda w: w.isin(*NO_NAME_INSIDE)), unsegmented).when(surface.rlike(r"[:\-–—/\[\]]"), unsegmented).when(several, unsegmented)
            .when(F.coalesce(entry_text, F.lit("")) == "", "entry_text_missing").when(~F.contains(entry_text, surface), "phrase_not_in_passage")
        )

    n = normalize(surface)
    one = F.struct(F.filter(F.split(n, " "), lambda w: w != "").alias("ws"), n.alias("norm"), is_relative(surface).alias("relative"))
    return F.element_at(F.transform(F.array(one), judged), 1)


def statements(entries: DataFrame) -> DataFrame:
    """entries (id, head, text, teachers, students) -> (id, list, index, surface, code, teacher, student): every mention, those
    accepted without a code and with the buckets of both ends, the teacher first. Within an entry a relation counts once,
    where it first stands, teachers before students; none goes from a name to itself; an entry without a name has none."""
    lists = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("list"), F.coalesce(n + "s", F.array().cast("array<string>")).alias("m")) for k, n in enumerate(("teacher", "student"))])
    m = entries.select("id", "head", "text", F.explode(lists).alias("l")).select("id", "head", "text", "l.k", "l.list", F.posexplode("l.m").alias("index", "raw"))
    m = m.withColumn("own", cluster_of_name(F.coalesce("head", F.lit("")))).withColumn("surface", F.when(F.col("own").isNull(), "").otherwise(mention_surface(F.col("raw"), F.col("index"))))
    code = F.when(F.col("own").isNull(), "subject_not_named").otherwise(mention_code(F.col("surface"), F.col("text")))
    m = m.withColumn("code", code).withColumn("named", F.when(F.col("code").isNull(), cluster_of_name(F.col("surface"))))
    m = m.withColumn("code", F.when(F.col("code").isNull() & (F.col("named") == F.col("own")), "self_reference").otherwise(F.col("code")))
    ends = {"teacher": F.when(F.col("list") == "teacher", F.col("named")).otherwise(F.col("own")), "student": F.when(F.col("list") == "teacher", F.col("own")).otherwise(F.col("named"))}
    m = m.withColumns({k: F.when(F.col("code").isNull(), c) for k, c in ends.items()})
    first = Window.partitionBy("id", "teacher", "student").orderBy("k", "index")
    n = F.when(F.col("code").isNull(), F.row_number().over(first))
    m = m.withColumn("n", n).withColumn("code", F.when(F.col("n") > 1, "duplicate").otherwise(F.col("code")))
    return m.select("id", "list", "index", "surface", "code", *[F.when(F.col("code").isNull(), F.col(k)).alias(k) for k in ends])


def review_rows(found: DataFrame) -> DataFrame:
    """found, as rows of a review queue: what was left out by its reason, what was accepted as an open question of identity."""
    return found.select("id", "list", "index", F.coalesce(F.concat(F.lit("rijal_statement_"), "code"), F.lit("rijal_statement_identity_unresolved")).alias("code"), F.coalesce("surface", F.lit("")).alias("surface"))
