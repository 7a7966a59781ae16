"""Fill-in-middle against plain Python, its exact round trip, and its edges."""

import hashlib
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tesserae.llm import fim


def plain(key, text, percent=100, spm=50):
    """Lines by a pattern, cut by lists."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= percent:
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:i], lines[i:j], lines[j:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@given(st.integers(0, 10**6), st.text(alphabet="a\n\r é😀<PSM>", max_size=40))
def test_transform_is_the_plain_one(key, text):
    for percent, spm in ((100, 50), (60, 0), (100, 100)):
        n, form, p, m, raw = fim.transform(str(key), text.encode(), 7, percent, spm)
        assert (n, form, p, m, raw.decode()) == plain(key, text, percent, spm)


@given(st.integers(1, 10**9), st.data())
def test_select(bits, data):
    rank = data.draw(st.integers(0, bits.bit_count() - 1))
    assert fim.select(bits, rank, bits.bit_length()) == [i for i in range(bits.bit_length()) if bits >> i & 1][rank]


def test_columns_nulls_repeats_long_texts_and_restoring(spark):
    long_ = "\n".join("é" * int(k) for k in np.random.default_rng(1).integers(0, 60, 40_000))
    rows = [(1, "a\nb\nc", 1, "x"), (1, "a\nb\nc", 2, "y"), (2, None, 3, None), (3, "", 4, "z"), (None, "q\nr", 5, "z"), (4, "see <S> here\n", 6, "z"), (5, long_, 7, "z"), (6, "\n\n", 8, "z"), (7, "no line feed", 9, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _ts_n long, form string")
    out = fim.fill_in_middle(d)
    got = out.select("*", fim.restore(out._ts_output, out._ts_form).alias("back")).collect()
    assert out.columns == ["doc_id", "text", "form", *fim.OUTPUTS] and len(got) == len(rows)
    for r in got:
        key = "" if r.doc_id is None else r.doc_id
        assert (r._ts_n, r._ts_form, r._ts_prefix_chars, r._ts_middle_chars, r._ts_output) == plain(key, r.text or "")
        assert r.back == (r.text or "")
    assert fim.fill_in_middle(d.limit(0)).count() == 0
    assert {r._ts_form for r in fim.fill_in_middle(d, fim_percent=0).collect()} == {"plain"}
