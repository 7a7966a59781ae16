"""Many forms against all names, tier by tier, against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import matching, resolve


def data(spark):
    r = np.random.default_rng(7)
    parts = ["ab", "abc", "ibn", "zayd", "ali", "a", "é", "umar", " "]
    names = ["".join(r.choice(parts, int(r.integers(0, 6)))) for _ in range(90)] + ["", "x" * 5000, "ab ibn zayd"]
    texts = ["".join(r.choice([*parts, "qq"], int(r.integers(0, 20)))) for _ in names]
    forms = ["ab", "a", "", "é", "ibnzayd", "zz", "x" * 4097, "qq", "ab ibn zayd al-x", "umar ", *names[:25], names[0], None]
    n = spark.createDataFrame([(i % 80, a, b) for i, (a, b) in enumerate(zip(names, texts, strict=True))] + [(None, "ab", "ab"), (500, None, "ab"), (1, names[1], texts[1])], "id long, name string, text string")
    return spark.createDataFrame([(f,) for f in forms], "form string"), n


def brute(forms, names, k, text, require):
    out = []
    rows = sorted({(r.id, r.name) for r in names if r.id is not None and r.name is not None})
    for f in sorted({r.form for r in forms if r.form is not None}):
        ranked = []
        for i, n in rows:
            prefix = (n.startswith(f) or f.startswith(n)) and (not require or n != "")
            rank = 0 if n == f else 1 if prefix else 2 if f in n else None
            if rank is None and text and f and any(f in (r.text or "") for r in names if r.id == i and r.name is not None):
                rank = 3
            if rank is not None:
                ranked.append((rank, len(n), i, n))
        out += [(f, i, n, rank, p) for p, (rank, _, i, n) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "text", "require"), [(24, None, False), (3, "text", False), (1000, "text", True)])
def test_ranks(spark, k, text, require):
    forms, names = data(spark)
    got, told = matching.match_forms(forms, names, k, text, require)
    assert sorted((r.form, r.id, r.name, r.rank, r.place) for r in got.collect()) == brute(forms.collect(), names.collect(), k, text, require)
    assert [x["rank"] for x in told] == list(range(4 if text else 3))
    asked = [x["forms"] for x in told]
    assert asked == sorted(asked, reverse=True) and (k > 24 or asked[-1] < asked[0])


def test_ranks_are_those_of_one_query(spark):
    forms, names = data(spark)
    got, _ = matching.match_forms(forms.where("form = 'ab'"), names, 1000)
    one = resolve.rank_names(names.where("id is not null and name is not null").select("id", "name").distinct(), F.col("name"), "ab")
    assert sorted((r.id, r.name, r["rank"]) for r in got.collect()) == sorted((r.id, r.name, r["rank"]) for r in one.collect())


def test_no_nested_loops_and_empty_tables(spark):
    forms, names = data(spark)
    short = forms.where("form is not null")
    plans = [matching._beginnings(short, "form", names, "name"), matching.containing(short, names.select("id", "name"), "name")]
    assert not any("NestedLoop" in p._jdf.queryExecution().executedPlan().toString() or "Cartesian" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    for f, n in ((forms.limit(0), names), (forms, names.limit(0))):
        assert matching.match_forms(f, n, 5, "text")[0].count() == 0
