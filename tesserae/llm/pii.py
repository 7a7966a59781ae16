"""Personal data by gradient boosting over candidates, with DataFrame functions only.

High-recall generators propose overlapping spans: loose addresses, dotted quads, runs of digits, numbers of
telephones. Boosted trees score each candidate from its format (lengths, digits, separators, groups) and its
context (the characters before and after, cue words); a threshold for each kind, calibrated on the training sample,
selects what is added. The spans of the base rules stand whatever the score.

Training: base hits of a sample of documents (about `SAMPLE_DOCS` of those with a digit run or an at sign, drawn by a hash
of id and text; all of fewer) are rewritten in their place into the forms that the base rules miss. Spelled-out or spaced addresses, masked dots, cards in
dotted groups and telephones without country are positives; octets over 255, broken check digits, card runs too short
for one, words in place of a top-level domain and runs like a telephone without cue or brackets are negatives, and so
are the sample's own card runs of unsound check digit. Base spans themselves are no training rows, as none is ever
added. Rows are whole-number features; equal rows are counted by Spark, and the driver sees at most `SAMPLE_ROWS` of them,
the first by a hash. Trees of depth two are fitted by gradient steps on the logistic loss and turned
into CASE expressions, so scoring stays inside generated code. Thresholds are the least score at which the sample's
precision is at least `PRECISION`, and never under `LEAST`.

Candidates that touch a base span are set aside by running maxima and minima over a document's spans in their order, so
a text with hundreds of thousands of them takes time in proportion.

Nulls and edges: null text is empty; a text of any length is read whole; repeated rows give a row each; equal spans
of one kind are one; an empty table gives no row; a sample without both classes adds nothing. Only the two named columns
are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import materialize, table
from tesserae.llm.spans import PLACED, SPAN, count, digits, listed, luhn, spans

KINDS = ["email", "ip", "card", "phone"]
SAMPLE_DOCS, SAMPLE_ROWS, TREES, RATE, PRECISION, LEAST = 20_000, 20_000, 12, 0.5, 0.99, 0.9

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators beyond the base rules, by kind.
LOOSE = {
    0: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++",
    1: r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])",
    2: r"(?<![0-9+])[0-9]{4}(?:[.\x20-]?[0-9]{4}){2}[.\x20-]?[0-9]{1,7}(?![0-9])",
    3: r"(?<![0-9+.(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
FEATURES = ["kind", "length", "digits", "separators", "groups", "letters", "at", "plus", "before_space", "after_space", "cue", "check", "spaces", "dots", "marks"]
_TLD, _CUE = r"(?i)^(?:com|org|net|edu|gov|mil|info|biz|[a-z]{2})$", "tel. "


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255))


def base_spans(t: Column, around: bool = False) -> Column:
    card = lambda m: F.length(digits(m)).between(14, 19) & luhn(digits(m))
    phone = lambda m: F.length(digits(m)).between(10, 15)
    return F.concat(spans(t, EMAIL, 0, around=around, needs=["@"]), spans(t, IP, 1, _octets, around), spans(t, CARD, 2, card, around), spans(t, PHONE, 3, phone, around, ["+"]))


def candidates(t: Column) -> Column:
    needs = {0: ["@", "(at)", "[at]"], 1: ["[.]"]}
    return F.concat(*[spans(t, p, k, around=True, needs=needs.get(k)) for k, p in LOOSE.items()])


def _sound(k: Column, m: Column) -> Column:
    """Whether a candidate passes its kind's check: top-level domain, octets, check digit. Telephones have none."""
    card = F.when(F.length(digits(m)).between(14, 19), luhn(digits(m))).otherwise(False)
    return F.when(k == 0, F.regexp_extract(m, "[A-Za-z]+$", 0).rlike(_TLD)).when(k == 1, _octets(F.regexp_replace(m, r"\[\.\]", "."))).when(k == 2, card).otherwise(False)


def _features(x: Column) -> list[Column]:
    """Whole numbers that describe candidate x."""
    m = x["t"]
    before, after = F.lower(x["before"]), F.substring(x["after"], 1, 1)
    n = lambda p: F.length(F.regexp_replace(m, p, ""))
    cue = before.rlike(r"(?:mail|contact|write|tel|phone|call|fax|card|visa|pay|ip|host|server|address|from|to)\W{0,3}$")
    return [x["k"], F.length(m), n("[^0-9]"), n(r"[^\x20.()\[\]-]"), F.size(F.split(m, r"[^A-Za-z0-9]+")), n("[^A-Za-z]"), n("[^@]"), F.when(before.endswith("+"), 1).otherwise(0),
            F.when(before.rlike(r"(?:^|\s)$"), 1).otherwise(0), F.when((after == "") | after.rlike(r"\s"), 1).otherwise(0), F.when(cue, 1).otherwise(0), _sound(x["k"], m).cast("int"), n("[^\x20]"), n("[^.]"), F.size(F.split(m, r"\[\.\]|[(\[](?:at|dot)[)\]]")) - 1]


class Boosted:
    """For each kind with both labels a prior and trees of depth two, as (feature, cut, feature, cut, feature, cut, four
    leaves), and a threshold."""

    def __init__(self) -> None:
        self.trees, self.limits = {}, [2.0] * len(KINDS)

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best, where = 1e-9, (0, np.inf)
        total = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[1:]:
                left = x[:, f] < cut
                a, b = g[left], g[~left]
                gain = a.sum() ** 2 / (h[left].sum() + 1) + b.sum() ** 2 / (h[~left].sum() + 1) - total
                if gain > best:
                    best, where = gain, (f, float(cut))
        return where

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        for k in range(len(KINDS)):
            own = x[:, 0] == k
            if 0 < (y * w)[own].sum() < w[own].sum():
                self._fit(k, x[own], y[own], w[own])
        return self

    def _fit(self, k: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        p = (y * w).sum() / w.sum()
        prior, trees = float(np.log(p / (1 - p))), []
        s = np.full(len(x), prior)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-s))
            g, h = w * (y - q), w * q * (1 - q)
            f, c = self._split(x, g, h)
            tree, up = [f, c], x[:, f] >= c
            leaves = []
            for side in (~up, up):
                f2, c2 = self._split(x[side], g[side], h[side]) if side.any() else (0, np.inf)
                tree += [f2, c2]
                for part in (side & (x[:, f2] < c2), side & (x[:, f2] >= c2)):
                    v = float(RATE * g[part].sum() / (h[part].sum() + 1))
                    s[part] += v
                    leaves.append(round(v, 6))
            trees.append((*tree, *leaves))
        self.trees[k] = prior, trees
        q = 1 / (1 + np.exp(-s))
        for limit in sorted({*q[q >= LEAST]}):
            over = q >= limit
            if (y * w)[over].sum() >= PRECISION * w[over].sum():
                self.limits[k] = float(limit) - 1e-6
                break

    def score(self, features: list[Column]) -> Column:
        branch = lambda f, c, a, b: F.when(features[f] < c, a).otherwise(b) if np.isfinite(c) else F.lit(a)
        out = F.lit(0.0)
        for k, (prior, trees) in self.trees.items():
            total = F.lit(prior)
            for f, c, f0, c0, f1, c1, *v in trees:
                lo, hi = branch(f0, c0, v[0], v[1]), branch(f1, c1, v[2], v[3])
                total = total + (F.when(features[f] < c, lo).otherwise(hi) if np.isfinite(c) else lo)
            out = F.when(features[0] == k, 1 / (1 + F.exp(-total))).otherwise(out)
        return out


def _rewritten(k: Column, m: Column, after: Column) -> Column:
    """Structs (pre, form, y): a base span in forms that the base rules miss, what is written before it, and its label."""
    one = lambda y, form, pre="": F.struct(F.lit(pre).alias("pre"), form.alias("form"), F.lit(y).alias("y"))
    put = lambda v, new: F.regexp_replace(v, r"\.", new)
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    word, label = F.regexp_extract(after, "[A-Za-z]{2,24}", 0), F.substring_index(host, ".", 1)
    word = F.when(word.rlike(_TLD), None).otherwise(word)
    tld = F.substring_index(host, ".", -1)
    # short and whole hosts with both labels, so that their number tells nothing
    stems = [label, F.substring(host, F.lit(1), F.length(host) - F.length(tld) - 1)]
    email = [one(1, F.concat(local, F.lit(at), put(F.concat_ws(".", x, tld), dot))) for x in stems for at, dot in (("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", "."), ("(at)", "."), ("@", "(dot)"))]
    email += [one(0, F.concat(local, F.lit(at), x, F.lit(dot), word)) for x in stems for at, dot in (("@", ". "), (" @ ", "."), (" @ ", ". "))]
    parts = F.split(m, r"\.")
    far = lambda i: F.array_join(F.transform(parts, lambda p, j: F.when(j == i, (p.cast("int") + 256).cast("string")).otherwise(p)), "[.]")
    ip = [one(1, put(m, "[.]")), one(0, far(0)), one(0, far(3))]
    d = digits(m)
    broken = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((F.substring(d, -1, 1).cast("int") + 1) % 10).cast("string"))
    grouped = lambda v, by: F.concat_ws(by, F.substring(v, 1, 4), F.substring(v, 5, 4), F.substring(v, 9, 4), F.substring(v, F.lit(13), F.length(v)))
    card = [one(1, grouped(d, ".")), *[one(0, grouped(broken, by)) for by in (".", " ", "-", "")], *[one(0, grouped(F.substring(d, 1, 13), by)) for by in (".", " ", "")]]
    a, b, c = F.substring(d, -10, 3), F.substring(d, -7, 3), F.substring(d, -4, 4)
    bracket = F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c)
    phone = [one(1, x, pre) for x in (bracket, F.concat_ws("-", a, b, c)) for pre in ("", _CUE)]
    phone += [one(y, F.concat_ws(by, a, b, c), pre) for by in (" ", ".") for y, pre in ((1, _CUE), (0, "was "))]
    return F.when(k == 0, F.array(*email)).when(k == 1, F.array(*ip)).when(k == 2, F.array(*card)).otherwise(F.array(*phone))


def free(rows: DataFrame) -> DataFrame:
    """rows of r, base and cand -> (r, x): the candidates that touch no base span."""
    marks = lambda c, n: rows.select("r", F.explode(c).alias("x")).select("r", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.lit(n).alias("c"), (F.col("x") if n else F.lit(None).cast(PLACED)).alias("x"))
    order = Window.partitionBy("r").orderBy("s", "c", "e")
    over = F.max(F.when(F.col("c") == 0, F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    under = F.min(F.when(F.col("c") == 0, F.col("s"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    placed = marks("base", 0).unionByName(marks("cand", 1)).select("r", "s", "e", "c", "x", over.alias("over"), under.alias("under"))
    return placed.where("c = 1 and coalesce(over <= s, true) and coalesce(under >= e, true)").select("r", "x")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Boosted:
    """Fits on the candidates of a sample of documents."""
    eligible = docs.select(F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h")).where(F.col(text_col).rlike("[0-9]{3}|@"))
    n = eligible.count()
    if not n:
        return Boosted()
    share = 1 << 20
    some = eligible.where(F.pmod("h", F.lit(share)) < min(share, max(1, share * SAMPLE_DOCS // n)))
    rows = some.select(F.monotonically_increasing_id().alias("r"), base_spans(F.col("t"), True).alias("base"), candidates(F.col("t")).alias("cand"))
    rows = materialize(rows.where(F.size("base") + F.size("cand") > 0))
    # a base hit with what its features read of its surroundings
    near = rows.select(F.explode("base").alias("x")).select("x.k", F.col("x.t").alias("m"), "x.before", "x.after")
    near = near.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    made = near.select("k", "before", "after", F.explode(_rewritten(F.col("k"), F.col("m"), F.col("after"))).alias("v")).where("v.form is not null")
    made = made.select("k", "v.y", F.concat("before", "v.pre").alias("before"), "v.form", F.concat("before", "v.pre", "v.form", "after").alias("t"))
    made = made.select("k", "y", F.length("before").alias("s"), F.length("form").alias("n"), base_spans(F.col("t")).alias("b"), F.explode(candidates(F.col("t"))).alias("x")).where("x.k = k and x.s = s and x.e = s + n")
    made = made.where(~F.exists("b", lambda v: (v["s"] < F.col("x.e")) & (F.col("x.s") < v["e"])))
    own = free(rows.where(F.exists("cand", lambda x: x["k"] == 2))).where("x.k = 2").where(~_sound(F.col("x.k"), F.col("x.t")))
    rows = made.select("y", "x").unionByName(own.select(F.lit(0).alias("y"), "x"))
    counted = rows.select("y", *[c.cast("int").alias(n) for c, n in zip(_features(F.col("x")), FEATURES, strict=True)]).groupBy("y", *FEATURES).count()
    got = counted.orderBy(F.xxhash64("y", *FEATURES), "y", *FEATURES).limit(SAMPLE_ROWS).collect()
    x = np.array([[r[n] for n in FEATURES] for r in got], float).reshape(-1, len(FEATURES))
    return Boosted().fit(x, np.array([r["y"] for r in got], float), np.array([r["count"] for r in got], float))


def find(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id, text (if asked for), base and added spans of every document."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), t.alias("text"))
    cand = candidates(F.col("text")) if model.trees else F.array().cast(f"array<{PLACED}>")
    # the row's number is fixed by the scratch table
    d = materialize(d.select("r", "id", *(["text"] if with_text else []), base_spans(F.col("text")).alias("base"), cand.alias("cand")))
    limit = F.array(*[F.lit(v) for v in model.limits])
    some = free(d.where(F.size("cand") > 0).select("r", "base", "cand"))
    some = some.where(model.score(_features(F.col("x"))) >= F.get(limit, F.col("x.k"))).select("r", F.struct("x.s", "x.k", "x.e", "x.t").alias("x"))
    some = some.groupBy("r").agg(F.sort_array(F.collect_set("x")).alias("added"))
    none = F.array().cast(f"array<{SPAN}>")
    # what has no candidate costs no join
    met = d.where(F.size("cand") > 0).join(some, "r", "left").withColumn("added", F.coalesce("added", none))
    out = d.where(F.size("cand") == 0).withColumn("added", none).unionByName(met)
    return out.select("id", *(["text"] if with_text else []), "base", "added")


def redact(found: DataFrame) -> DataFrame:
    """found with the text's spans replaced by their kinds in brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    step = lambda acc, x: F.when(x["s"] < acc["o"], acc).otherwise(F.struct(x["e"].alias("o"), F.concat(acc["x"], F.substring(F.col("text"), acc["o"] + 1, x["s"] - acc["o"]), F.get(names, x["k"])).alias("x")))
    done = F.aggregate(F.array_sort(F.concat("base", "added")), F.struct(F.lit(0).alias("o"), F.lit("").alias("x")), step)
    return found.withColumn("redacted", F.concat(done["x"], F.substring(F.col("text"), done["o"] + 1, F.length("text"))))


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, train(docs), with_text=False)
    n = [count(F.col("base"), k).alias(f"n_{x}") for k, x in enumerate(KINDS)]
    return out.select(F.col("id").alias("doc_id"), *n, F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.concat("base", "added"), KINDS).alias("spans"))


QUERIES = {"op5_boosted_pii": op5_boosted_pii}
ORACLES: dict[str, str] = {}
