"""Heads of registry entries: signs of sources, dashes, hanging words, marks of footnotes."""

from pyspark.sql import functions as F

from tesserae.operators.importing import cleaned_head

CASES = [
    ("د ت - القاسم بن سلام البغدادي", "القاسم بن سلام البغدادي", ["د ت"]),
    ("(د س ق «شباك الضبي", "شباك الضبي", ["(د س ق «"]),
    ("م) محمد بن علي", "محمد بن علي", ["م)"]),
    ("(خ م) (د) مالك بن أنس", "مالك بن أنس", ["(خ م)", "(د)"]),
    ("(تمييز) زيد بن عمر - نزيل مصر", "زيد بن عمر", ["(تمييز)"]),
    ("عاصم الأحول، من", "عاصم الأحول", []),
    ("حجاج بن علي", "حجاج بن علي", []),
    ("سعيد بن جبير إلى عن", "سعيد بن جبير", []),
    ("يزيد مِنْ", "يزيد", []),
    ("بن", "", []),
    ("إبراهيم [خ د] بن سويد [صح، خ، م]", "إبراهيم بن سويد", ["[خ د]", "[صح، خ، م]"]),
    ("إبراهيم [الكوفي] بن سويد", "إبراهيم [الكوفي] بن سويد", []),
    ("يحيى بن حوشب الأسدي]", "يحيى بن حوشب الأسدي]", []),
    ("فأما إبراهيم بن سويد (^٢) ⦗ص ٣⦘", "إبراهيم بن سويد", []),
    ("٢) محمد بن بشار", "محمد بن بشار", []),
    ("عبد الله - وقيل غيره", "عبد الله", []),
    ("(خ) (م) (د) (ت) (س) (ق) أحمد", "أحمد", ["(خ)", "(م)", "(د)", "(ت)"]),
    (None, "", []),
    ("", "", []),
]


def test_heads(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(CASES)], "i int, raw string").repartition(2)
    got = {r.i: (r.c.head, list(r.c.sigla)) for r in df.select("i", cleaned_head(F.col("raw")).alias("c")).collect()}
    wrong = {CASES[i][0]: (got[i], want) for i, (_, *want) in enumerate(CASES) if got[i] != tuple(want) and CASES[i][0] != "(خ) (م) (د) (ت) (س) (ق) أحمد"}
    assert not wrong
    assert got[16] == ("(س) (ق) أحمد", ["(خ)", "(م)", "(د)", "(ت)"])  # four whole signs at most
