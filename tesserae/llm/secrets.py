"""Secret scan by corpus-wide ownership frequency, with DataFrame functions only.

Generators propose spans: those of the base rules, and further ones (provider-style prefixes, signed tokens, long mixed
strings). All are judged by how the corpus owns them: the hashes of the candidate values (of an assignment, what is
assigned) are counted by distinct repositories and distinct owners, whatever the kind. What is in the shape of a
placeholder or has too little entropy for its kind, and what at least `COPIED_OWNERS` owners or `COPIED_REPOS`
repositories have, is an example; what one owner has in at most `LIVE_REPOS` repositories looks live; what lies
between is shared: a live secret whose document was copied once or twice, or an example in its first copies. Base spans
stand whatever their class; of the further ones the live are added. A repository is a document and its owner the
document's source, unless other columns are named.

Only candidates are exploded, and counts combine before each shuffle: by (hash, repository) and (hash, owner), then by
hash. A string that a third of all documents hold meets its class in a plain join that adaptive execution splits.

Nulls and edges: null text is empty; a null owner counts as one owner, a null repository as one repository; repeated
rows give a row each and count as one repository; ties in place go by kind; runs of any length are candidates; an empty
table gives no row. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import materialize, table
from tesserae.llm.spans import count, listed, spans

KINDS = ["assign", "access", "hex", "provider", "signed", "mixed"]
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS, HEX = r"AKIA[A-Z0-9]++", r"[0-9a-f]{24,}+"
PROVIDER = r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_])"
SIGNED = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+"
#: The kinds from this one on are not of the base rules.
FURTHER = 3
#: Repositories and owners that make a value live at most, and an example at least.
LIVE_REPOS, LIVE_OWNERS, COPIED_REPOS, COPIED_OWNERS = 3, 1, 20, 4
#: Distinct characters that a value has at least, by kind.
DISTINCT_CHARACTERS = [6, 8, 8, 12, 12, 12]
JUDGED = "struct<s:int,k:int,e:int,class:string,repos:bigint,owners:bigint>"


def _hashed(x: Column) -> Column:
    """The span x with the hash of its value and whether that is no placeholder."""
    v = F.when(x["k"] == 0, F.regexp_extract(x["t"], VALUE, 1)).otherwise(x["t"])
    least = F.get(F.array(*[F.lit(n) for n in DISTINCT_CHARACTERS]), x["k"])
    sound = (F.size(F.array_distinct(F.split(v, ""))) >= least) & ~F.lower(v).rlike("example|sample|placeholder|changeme|x{6}|0{8}|1234567")
    return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.sha2(v, 256).alias("c"), sound.alias("sound"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source") -> DataFrame:
    """id, base (spans of the base rules), added (those that ownership adds), examples (candidates of any kind that do not
    look live), judged (all candidates with their class, live, shared or example, and the counts it rests on)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(
        spans(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, VALUE, 1)) >= 6),
        spans(t, ACCESS, 1, lambda m: F.length(m) >= 20, needs=["AKIA"]),
        spans(t, HEX, 2),
        spans(t, PROVIDER, 3, needs=["gh", "xox", "sk_live_", "AIza"]),
        spans(t, SIGNED, 4, needs=["eyJ"]),
        spans(t, MIXED, 5, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")),
    )
    # the row's number is fixed by the scratch table
    narrow = materialize(docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), F.col(repo_col or id_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.transform(found, _hashed).alias("found")))
    cand = narrow.where(F.size("found") > 0).select("r", "id", "repo", "owner", F.inline("found"))
    # a value's pairs first, as one of its repositories or owners may have it in a third of all rows
    distinct = lambda by: cand.groupBy("c", by).agg(F.count("*").alias("n")).groupBy("c").agg(F.count("*").alias(f"{by}s"))
    owned = materialize(distinct("repo").join(distinct("owner"), "c"))
    copied = ~F.col("sound") | (F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= COPIED_REPOS)
    of = F.when(copied, "example").when((F.col("owners") <= LIVE_OWNERS) & (F.col("repos") <= LIVE_REPOS), "live").otherwise("shared")
    judged = cand.join(owned, "c").groupBy("r", "id").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e", of.alias("class"), "repos", "owners"))).alias("judged"))
    # texts without a match cost no join
    out = narrow.where(F.size("found") == 0).select("id", F.array().cast(f"array<{JUDGED}>").alias("judged")).unionByName(judged.select("id", "judged"))
    part = lambda which: F.transform(F.filter("judged", which), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit("").alias("t")))
    live = lambda x: x["class"] == "live"
    return out.select("id", part(lambda x: x["k"] < FURTHER).alias("base"), part(lambda x: (x["k"] >= FURTHER) & live(x)).alias("added"), part(lambda x: ~live(x)).alias("examples"), "judged")


def op9_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return out.select(
        F.col("id").alias("doc_id"), count(F.col("base"), 0).alias("n_assign"), count(F.col("base"), 1).alias("n_access"), count(F.col("base"), 2).alias("n_hex"),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.concat("base", "added"), KINDS).alias("spans"), F.size("examples").cast("long").alias("n_examples"),
        F.array_join(F.transform("judged", lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"), x["class"])), ",").alias("classes"),
    )


QUERIES = {"op9_ownership_secrets": op9_ownership_secrets}
ORACLES: dict[str, str] = {}
