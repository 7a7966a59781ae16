"""Two-level scans, numbering, the sparse seeded shuffle, the interval join, and the layout of trees, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import editorial, gold, profiles, scans


@pytest.mark.parametrize("block", [3, 10, 10**6])
def test_running_sums_and_last_values(spark, block):
    r = np.random.default_rng(1)
    rows = [(str(g) if g else None, int(o), None if v < 3 else int(v)) for g, o, v in zip(r.integers(0, 3, 60), r.permutation(60), r.integers(0, 9, 60), strict=True)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(x.g, x.o): (x.total, x.last) for x in scans.two_level(df, "g", ["o"], {"total": F.col("v")}, {"last": F.when(F.col("v") % 2 == 0, F.col("v"))}, block).collect()}
    for g in {x[0] for x in rows}:
        total, last = 0, None
        for _, o, v in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            total, last = total + (v or 0), v if v is not None and v % 2 == 0 else last
            assert got[g, o] == (total, last)
    assert scans.two_level(df.limit(0), "g", ["o"], {"total": F.col("v")}).count() == 0


def test_one_large_group_is_many_blocks(spark):
    df = spark.range(100_000).select(F.lit("w").alias("work"), "id")
    out = scans.two_level(df, "work", ["id"], {"n": F.lit(1)}, block=5000)
    assert out.where(F.col("n") != F.col("id") + 1).count() == 0
    d = scans._blocks(df, ["work"], ["id"], 5000)
    sizes = [r["count"] for r in d.groupBy("_block").count().collect()]
    assert len(sizes) >= 16 and max(sizes) < 12_000


def test_ordinals(spark):
    vals = [5, 3, None, 3, 9, 1, 7]
    got = scans.ordinals(spark.createDataFrame([(v,) for v in vals], "v long"), ["v"], "n", 2).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == [None, 1, 3, 3, 5, 7, 9] and sorted(r.n for r in got) == list(range(7))


def generator(text):
    """Numbers of the seeded generator, one after the other."""
    h = 0x811C9DC5
    for c in text:
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    while True:
        h = (h + 0x6D2B79F5) & 0xFFFFFFFF
        v = ((h ^ (h >> 15)) * (h | 1)) & 0xFFFFFFFF
        v ^= (v + (((v ^ (v >> 7)) * (v | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((v ^ (v >> 14)) & 0xFFFFFFFF) / 4294967296


def fisher_yates(items, seed):
    u, items = generator(seed), list(items)
    for k in range(len(items) - 1, 0, -1):
        j = int(next(u) * (k + 1))
        items[k], items[j] = items[j], items[k]
    return items


@pytest.mark.parametrize(("size", "n"), [(100_000, 250), (37, 40), (2, 1), (1, 1), (0, 5)])
def test_frames_are_the_first_of_a_seeded_shuffle(spark, size, n):
    df = spark.range(size).select((F.col("id") * 3 + 1).alias("k"))
    got = sorted((r.place, r.k, r.weight) for r in gold.seeded_frame(df, "k", n, "gold|forms").collect())
    want = fisher_yates([3 * i + 1 for i in range(size)], "gold|forms")[:n]
    assert [k for _, k, _ in got] == want and [p for p, _, _ in got] == list(range(len(want)))
    assert all(w == size / min(n, size) for _, _, w in got)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_lives_that_overlap(spark, width):
    r = np.random.default_rng(5)
    lives = [(int(k), int(b), int(b + d)) for k, b, d in zip(r.integers(0, 40, 70), r.integers(-50, 200, 70), r.integers(0, 60, 70), strict=True)]
    df = spark.createDataFrame([*lives, (None, 0, 500), (90, 10, 5), (91, None, 7)], "k long, birth int, death int")
    want = {}
    for a, b1, d1 in lives:
        for b, b2, d2 in lives:
            if a < b and (o := min(d1, d2) - max(b1, b2)) > 0:
                want[a, b] = max(want.get((a, b), 0), o)
    got = editorial.meeting_lives(df, "k", width)
    assert {(r.a, r.b): r.overlap_years for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_of_single_lives_are_not_shuffled(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("birth"), (F.col("id") % 3 + 1 + F.col("id") % 2).cast("int").alias("death"))
    df = df.unionByName(spark.createDataFrame([(0, 0, 1), (1, 7, 8), (400, 7, 9), (400, 7, 9)], "k long, birth int, death int"))
    want = {}
    rows = [tuple(r) for r in df.collect()]
    for a, b1, d1 in rows:
        for b, b2, d2 in rows:
            if a < b and (o := min(d1, d2) - max(b1, b2)) > 0:
                want[a, b] = max(want.get((a, b), 0), o)
    for crowd in (7, 100_000):  # with few, each bin is dealt out
        got = editorial.meeting_lives(df, "k", 1, crowd)
        assert sorted(tuple(r) for r in got.collect()) == sorted((*k, v) for k, v in want.items())
    metrics, todo = 0, [got._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName() or node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan())
        if node.nodeName() == "Exchange":
            metrics = max(metrics, node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < metrics < len(want) / 5


def test_tree_layout(spark):
    tree = {"a": ["b", "c"], "b": ["d", "e", "f"], "c": [], "d": ["g"], "e": [], "f": [], "g": [], "z": ["y"], "y": []}
    parent = {c: p for p, cs in tree.items() for c in cs}
    depth = lambda k: 1 if k not in parent else 1 + depth(parent[k])
    nodes = spark.createDataFrame([(k, parent.get(k), depth(k)) for k in tree], "k string, p string, d int")
    got = {r.key: (r.leaves, r.slot, r.place) for r in profiles.tree_layout(nodes, "k", "p", "d", "k").collect()}
    slots, want = [0], {}

    def visit(k):
        first = slots[0]
        if not tree[k]:
            slots[0] += 1
            want[k] = (1, first, float(first))
            return want[k]
        below = [visit(c) for c in sorted(tree[k])]
        want[k] = (sum(x[0] for x in below), first, sum(x[2] for x in below) / len(below))
        return want[k]

    for root in sorted(k for k in tree if k not in parent):
        visit(root)
    assert got == want
    assert profiles.tree_layout(nodes.limit(0), "k", "p", "d", "k").count() == 0
