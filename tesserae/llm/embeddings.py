"""Near-duplicate embeddings by navigable small-world graphs, one a shard.

Equal vectors of a label collapse into one class first. Classes are dealt into shards of about `SHARD_ROWS` of one
label; each shard gets a hierarchical graph: levels fall off geometrically by a hash of the id, a level is built from
the top down in batches, and a node keeps neighbours that are nearer to it than to each other. Every class queries
every shard of its label: each two shards of a label are one group of their own, which searches either's graph with the
other's vectors, so a label of any size is dealt over all tasks. A link counts for both ends if either search found it.
A beam that ends full of matches widens fourfold, and a query whose beam ends full again is scanned. Then a sample of the queries is compared with a
scan, links of a vector with itself left out, and the sample grows until it has seen `AUDIT_LINKS` true links or every
query; all beams widen until the recall passes, and what no beam mends is scanned. recall() reports these audits by
label. Cosines are in double precision throughout, of vectors that are first scaled by their largest part.

A task returns, for each query, the number of vectors it found, and a forest that joins what it found: at most one
edge for each class it saw, however many links a group of near copies has. Components come from these forests.

Nulls and edges: null labels, null or zero vectors and those with null or non-finite parts link with nothing and
stand alone; vectors of different lengths never link; every row counts as a vector of its own, so a repeated row is
linked with its twin; rows that share a vec_id have one component; an empty table gives no row. Only the three named
columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import connected_components, materialize, table

THRESHOLD, SHARD_ROWS, M, BEAM, BATCH, RECALL = 0.98, 4096, 16, 48, 512, 0.999
#: Queries that an audit compares at once, and the true links that it sees at least if there are any.
AUDIT, AUDIT_LINKS = 256, 50
#: Tasks that pairs of shards are dealt over at most.
PAIR_TASKS = 20_000
FOUND = "label string, u long, v long, n long, seen long, hit long"


def _pick(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """For each row of own up to m of its candidates (-1: none), by falling similarity, that are nearer to it than to those picked."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    out, n = np.full((len(own), m), -1, np.int32), np.zeros(len(own), np.int64)
    spare = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        c = cand[:, j]
        ok = (c >= 0) & (n < m)
        if not ok.any():
            continue
        to = np.einsum("nmd,nd->nm", x[out], x[c])
        near = np.where(out >= 0, to, -2).max(1) > sim[:, j]
        spare[:, j] = ok & near
        ok &= ~near
        out[ok, n[ok]] = c[ok]
        n[ok] += 1
    for j in range(cand.shape[1]):  # room that is left goes to the nearest of the others
        ok = spare[:, j] & (n < m)
        out[ok, n[ok]] = cand[ok, j]
        n[ok] += 1
    return out


class Graph:
    """layers: from the top down, (nodes, neighbours of each among all nodes); the last has all."""

    def __init__(self, x: np.ndarray, ids: np.ndarray | None = None, layers: list | None = None):
        self.x = x
        if layers is not None:
            self.layers = layers
            return
        h = np.array([xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True)) for i in ids], np.float64) / 2.0**64
        level = np.minimum((-np.log(np.maximum(h, 1e-18)) / np.log(M)).astype(int), 6)
        self.layers = []
        for k in range(int(level.max()), -1, -1):
            nodes = np.flatnonzero(level >= k)
            nodes = nodes[np.argsort(h[nodes], kind="stable")]
            self.layers.append(self._layer(nodes, M if k else 2 * M))

    def _layer(self, nodes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        x, table = self.x, np.full((len(self.x), m), -1, np.int32)
        at = 0
        while at < len(nodes):
            new = nodes[at : at + (min(BATCH, max(64, at)))]
            sim = x[new] @ x[new].T
            np.fill_diagonal(sim, -2)
            k = min(len(new), BEAM)
            own = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            cand, s = new[own].astype(np.int32), np.take_along_axis(sim, own, 1)
            cand[s <= -2] = -1
            if at:
                start = self._descend(x[new]) if self.layers else np.repeat(nodes[:1, None], len(new), 0)
                start = np.where(np.isin(start, nodes[:at]), start, nodes[0])
                c2, s2 = self._beam(x[new], table, start, BEAM)
                cand, s = np.concatenate([cand, c2], 1), np.concatenate([s, s2], 1)
            table[new] = _pick(x, new, cand, s, m)
            # edges back, one for each target at a time
            src, dst = np.repeat(new, m), table[new].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
            for r in range(0, int(rank.max(initial=-1)) + 1, m):
                sel = (rank >= r) & (rank < r + m)
                to = np.unique(dst[sel])
                add = np.full((len(to), m), -1, np.int32)
                add[np.searchsorted(to, dst[sel]), rank[sel] - r] = src[sel]
                both = np.concatenate([table[to], add], 1)
                dup = (both[:, :, None] == both[:, None, :]) & (np.arange(2 * m)[None, None, :] < np.arange(2 * m)[None, :, None])
                both[dup.any(2)] = -1
                simb = np.where(both >= 0, np.einsum("nmd,nd->nm", x[both], x[to]), -2)
                table[to] = _pick(x, to, both, simb, m)
            at += len(new)
        return nodes, table

    def _beam(self, q: np.ndarray, table: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        x, rows = self.x, np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(x) + 1), bool)
        ids = np.full((len(q), beam), -1, np.int32)
        sim, open_ = np.full((len(q), beam), -2.0), np.zeros((len(q), beam), bool)
        k = min(start.shape[1], beam)
        ids[:, :k], open_[:, :k] = start[:, :k], start[:, :k] >= 0
        sim[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("nmd,nd->nm", x[ids[:, :k]], q), -2)
        seen[rows, ids] = True
        wide = 4
        live = np.arange(len(q))
        while len(live):
            s = np.where(open_[live], sim[live], -3)
            best = np.argpartition(-s, min(wide, beam - 1), axis=1)[:, :wide]
            ok = np.take_along_axis(s, best, 1) > -3
            live, best, ok = live[ok.any(1)], best[ok.any(1)], ok[ok.any(1)]
            if not len(live):
                break
            lr = live[:, None]
            go = np.where(ok, ids[lr, best], -1)
            open_[lr, best] = False
            nb = np.where(go[:, :, None] >= 0, table[go], -1).reshape(len(live), -1)
            nb[seen[lr, nb]] = -1
            seen[lr, nb] = True
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            ns = np.where(nb >= 0, np.einsum("nmd,nd->nm", x[nb], q[live]), -2)
            ai, as_, ao = np.concatenate([ids[live], nb], 1), np.concatenate([sim[live], ns], 1), np.concatenate([open_[live], nb >= 0], 1)
            top = np.argpartition(-as_, beam - 1, axis=1)[:, :beam]
            ids[live], sim[live], open_[live] = np.take_along_axis(ai, top, 1), np.take_along_axis(as_, top, 1), np.take_along_axis(ao, top, 1)
        return ids, sim

    def _descend(self, q: np.ndarray) -> np.ndarray:
        start = np.repeat(self.layers[0][0][:1, None].astype(np.int32), len(q), 0)
        for _, table in self.layers:
            ids, sim = self._beam(q, table, start, 8)
            start = ids
        return start

    def within(self, q: np.ndarray, threshold: float, beam: int = BEAM) -> np.ndarray:
        """For each query and node whether the search found a cosine of at least the threshold. A query whose beam ends full
        of matches gets one four times as wide; one that ends full again lies in a crowd, and is compared with all nodes."""
        out = np.zeros((len(q), len(self.x)), bool)
        todo = np.arange(len(q))
        for width in (beam, 4 * beam):
            width, more = min(width, len(self.x)), []
            for lo in range(0, len(todo), BATCH):
                part = todo[lo : lo + BATCH]
                start = np.repeat(self.layers[0][0][:1, None].astype(np.int32), len(part), 0)
                for _, table in self.layers[:-1]:
                    start = self._beam(q[part], table, start, 8)[0]
                ids, sim = self._beam(q[part], self.layers[-1][1], start, width)
                hit = (sim >= threshold) & (ids >= 0)
                out[np.repeat(part, hit.sum(1)), ids[hit]] = True
                more.append(part[hit.all(1)])
            todo = np.concatenate(more) if more else todo
        for lo in range(0, len(todo), BATCH):
            part = todo[lo : lo + BATCH]
            out[part] = q[part] @ self.x.T >= threshold
        return out


def linked(g: Graph, h: Graph | None, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, int, int]:
    """Links of g's nodes with h's (None: among g's own), and how many true ones the last audit saw and had found."""
    other = g if h is None else h
    order = np.random.default_rng(0).permutation(len(g.x))
    while True:
        hit = other.within(g.x, threshold, beam)
        hit |= hit.T if h is None else g.within(h.x, threshold, beam).T
        seen = found = 0
        for lo in range(0, len(order), AUDIT):
            some = order[lo : lo + AUDIT]
            true = g.x[some] @ other.x.T >= threshold
            if h is None:
                true[np.arange(len(some)), some] = False
            seen, found = seen + int(true.sum()), found + int((true & hit[some]).sum())
            if seen >= AUDIT_LINKS:
                break
        if found >= RECALL * seen:
            break
        if beam >= max(len(g.x), len(other.x)):
            for lo in range(0, len(g.x), BATCH):
                hit[lo : lo + BATCH] |= g.x[lo : lo + BATCH] @ other.x.T >= threshold
            break
        beam *= 4
    if h is None:
        np.fill_diagonal(hit, False)
    return hit, seen, found


def forest(hit: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges (row, column) that join all that the links join; same: rows and columns are the same nodes."""
    rows, cols = np.zeros(hit.shape[0], bool), np.zeros(hit.shape[1], bool)
    if same:
        cols = rows
    out = []
    for start in np.flatnonzero(hit.any(1)):
        if rows[start]:
            continue
        rows[start], todo = True, [(start, True)]
        while todo:
            k, row = todo.pop()
            near = np.flatnonzero((hit[k] & ~cols) if row else (hit[:, k] & ~rows))
            (cols if row else rows)[near] = True
            out += [(k, j) if row else (j, k) for j in near]
            todo += [(j, same or not row) for j in near]
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node", kind="stable")
    ids, m = pdf["node"].to_numpy(np.int64), pdf["m"].to_numpy(np.int64)
    x = np.stack(pdf["v"].to_list()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x, ids)
    layers = b"".join(np.int64([len(n), t.shape[1]]).tobytes() + n.astype(np.int64).tobytes() + t.tobytes() for n, t in g.layers)
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dim": [int(x.shape[1])], "shard": [int(pdf["shard"].iloc[0])], "ids": [ids.tobytes()], "hs": [pdf["a"].to_numpy(np.int64).tobytes()], "ms": [m.tobytes()], "xs": [x.tobytes()], "graph": [layers]})


def _load(x: np.ndarray, raw: bytes) -> Graph:
    layers, at = [], 0
    while at < len(raw):
        n, m = np.frombuffer(raw, np.int64, 2, at)
        nodes = np.frombuffer(raw, np.int64, n, at + 16)
        at += 16 + 8 * int(n)
        layers.append((nodes, np.frombuffer(raw, np.int32, len(x) * int(m), at).reshape(len(x), int(m))))
        at += 4 * len(x) * int(m)
    return Graph(x, layers=layers)


def _query(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            sides = [(r.a_ids, r.a_hs, r.a_ms, r.a_xs, r.a_graph)] + ([(r.b_ids, r.b_hs, r.b_ms, r.b_xs, r.b_graph)] if r.a != r.b else [])
            (ids, hs, ms, g), *rest = [(*(np.frombuffer(x, np.int64) for x in (i, h, m)), _load(np.frombuffer(x, np.float64).reshape(-1, r.dim), y)) for i, h, m, x, y in sides]
            oids, ohs, oms, other = rest[0] if rest else (ids, hs, ms, None)
            hit, seen, found = linked(g, other, threshold)
            u, n = (np.concatenate([hs, ohs]), np.concatenate([hit @ oms, ms @ hit])) if rest else (hs, hit @ ms)
            edges = np.array(forest(hit, not rest), np.int64).reshape(-1, 2)
            whole = lambda x: pd.array(x, "Int64")
            out.append(pd.DataFrame({"label": r.label, "u": whole(u[n > 0]), "v": whole([None] * int((n > 0).sum())), "n": n[n > 0], "seen": 0, "hit": 0}))
            out.append(pd.DataFrame({"label": r.label, "u": whole(ids[edges[:, 0]]), "v": whole(oids[edges[:, 1]]), "n": 0, "seen": 0, "hit": 0}))
            out.append(pd.DataFrame({"label": [r.label], "u": whole([None]), "v": whole([None]), "n": 0, "seen": seen, "hit": found}))
        return pd.concat(out)

    return run


def search(classes: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """classes: label, dim, node, a (hash of the vector), m, v -> rows FOUND: links of the class of hash u (v null), edges
    (u, v) that join nodes, audits (u null)."""
    counts = classes.groupBy("label", "dim").count().select("label", "dim", F.ceil(F.col("count") / shard_rows).cast("int").alias("k"))
    dealt = classes.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    tasks = min(counts.agg(F.coalesce(F.sum("k"), F.lit(1)).alias("n")).first().n, PAIR_TASKS)
    graphs = materialize(dealt.repartition(tasks, "label", "dim", "shard").groupBy("label", "dim", "shard").applyInPandas(_build, "label string, dim int, shard int, ids binary, hs binary, ms binary, xs binary, graph binary"))
    shards = graphs.select("label", "dim", "shard")
    # the shards of a label once with each other and themselves
    pairs = materialize(shards.withColumnRenamed("shard", "a").join(shards.withColumnRenamed("shard", "b"), ["label", "dim"]).where("a <= b"))
    side = lambda s: graphs.select("label", "dim", F.col("shard").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "hs", "ms", "xs", "graph")])
    met = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
    n = min(max(1, pairs.count()), PAIR_TASKS)
    keys = ["label", "dim", "a", "b"]
    return met.repartition(n, *keys).groupBy(*keys).applyInPandas(_query(threshold), FOUND)


def recall(found: DataFrame) -> DataFrame:
    """label, seen, hit: the true links that the audits saw and those that the searches had found."""
    return found.where("u is null").groupBy("label").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("a", F.xxhash64("label", "v")).withColumn("b", F.xxhash64(F.lit(7), "label", "v"))
    classes = materialize(rows.where("fine").groupBy("label", "a", "b").agg(F.min("id").alias("node"), F.count("*").alias("m"), F.first("v").alias("v")).withColumn("dim", F.size("v")))
    found = materialize(search(classes, threshold, shard_rows))
    links = found.where("u is not null and v is null").groupBy("label", F.col("u").alias("a")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("v is not null").select("u", "v"))
    known = classes.select("label", "a", "b", "node", "m").join(links, ["label", "a"], "left").join(comp, "node", "left")
    known = materialize(known.selectExpr("a", "b", "m - 1 + coalesce(n, 0) n_links", "coalesce(component, node) component_id"))
    out = rows.where("fine").select("id", "a", "b").join(known, ["a", "b"]).select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def op6_hnsw_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_hnsw_embedding_dedup": op6_hnsw_embedding_dedup}
ORACLES: dict[str, str] = {}
