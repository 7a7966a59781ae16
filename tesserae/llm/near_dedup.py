"""Near-duplicate documents by b-bit MinHash.

Per document: the distinct shingles of five words, 384 minima, 24 band keys of four of them each, and a packed
signature of the low four bits of every minimum. Documents with the same set collapse into one class first.
Classes that share a band key are candidates; the packed signatures give a collision-corrected estimate by bit
counts, and what passes a wide margin is confirmed on full sets.

Groups never meet as pairs. Each bucket first links its members to its smallest one (a star), a few bands at a
time; the components of the confirmed links make most pairs needless. Documents whose buckets still hold several
components are then paired where they share a band and a rare shingle: two sets of this similarity have a shingle in
common among the first of each in any one order, and how many are the first follows from the sizes (prefix filtering, in
classes of sizes `STEP` apart, for each two classes that the threshold allows). The order is by how many of these
documents have a shingle, rarest first, so what copies of a template have in common seldom is among the first. Of two sets that
meet, the parities of the numbers of shingles at each of 1024 places bound from below how many shingles differ, and a pair that
this puts under the threshold is never made. That loses no pair: there is no cap.

Chance of missing a pair at the threshold 0.85: (1 - 0.85^4)^24 = 2e-8 by the bands, and 3e-7 by the margin of
five standard deviations on the estimate.

Nulls and edges: null or empty text and text of white space have an empty set, link with nothing and stay. Rows
that share a doc_id count as one document. A row without doc_id takes no part: component_id null, kept true. An empty
table gives no row. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import connected_components, give_back, materialize, small, table

WORDS, BANDS, ROWS, BITS = 5, 24, 4, 4
#: Minima in all; the first BANDS * ROWS make the bands, all make the signature.
MINIMA, MARGIN = 384, 5
#: Ratio of the sizes where one class of sizes ends and the next begins.
STEP = 1.05
#: Bands whose stars are linked together; later rounds see only what earlier ones left apart.
ROUNDS = ((0, 4), (4, BANDS))
#: Bytes of text that are worked on at once.
CHUNK = 2 << 20
#: Bits of a set's parities: each of its shingles turns one. What differs in two of them is at most the sets' difference.
PARITIES = 1024
_M = (1 << 64) - 1


def _seeds(n: int, salt: int) -> list[int]:
    return [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=salt) for i in range(n)]


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], known: WordHashes) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes; ASCII letters lower-cased, words between ASCII white space."""
    words, sizes = [], []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split() if t else ()
        words.extend(w)
        sizes.append(len(w))
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        s = h[: max(0, len(h) - WORDS + 1)].copy()
        for k in range(1, WORDS):
            s = s * _BASE + h[k : len(s) + k]
        s, out, at = _mix(s), [], 0
        for n in sizes:
            if n >= WORDS:
                out.append(np.unique(s[at : at + n - WORDS + 1]))
            elif n:
                x = np.uint64(n)
                for v in h[at : at + n]:
                    x = x * _BASE + v
                out.append(_mix(np.array([x], np.uint64) ^ np.uint64(0x5BD1E995)))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = CHUNK, strings: bool = True) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches whose texts have about `size` bytes, and those texts, if strings are wanted."""
    for b in batches:
        col = b.column(text)
        lens = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), np.int64)
        ends, at = np.cumsum(lens), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            part = b.slice(at, to - at)
            yield part, part.column(text).to_pylist() if strings else []
            at = to
    give_back()


def _lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * width + 1, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    xor, mul = (np.array(_seeds(MINIMA, k), np.uint64) for k in (1, 2))
    mul |= np.uint64(1)
    for part, texts in chunks(batches):
        sets = shingle_sets(texts, known)
        n = np.array([len(x) for x in sets], np.int64)
        full = np.flatnonzero(n)
        k0, k1 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for i in full:
            d = xxhash.xxh3_128_intdigest(sets[i].tobytes())
            k0[i], k1[i] = np.uint64(d & _M).astype(np.int64), np.uint64(d >> 64).astype(np.int64)
        bands, sig = np.zeros((len(n), BANDS), np.int64), np.zeros((len(n), MINIMA * BITS // 64), np.int64)
        if len(full):
            s = np.concatenate([sets[i] for i in full])
            at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            low = np.empty((len(full), MINIMA), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(MINIMA):
                    low[:, k] = np.minimum.reduceat((s ^ xor[k]) * mul[k], at)
                low = _mix(low)
                for b in range(BANDS):
                    x = np.full(len(full), b + 1, np.uint64)
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        x = _mix(x * _BASE + low[:, k])
                    bands[full, b] = x.view(np.int64)
                per = 64 // BITS
                for k in range(sig.shape[1]):
                    x = np.zeros(len(full), np.uint64)
                    for j in range(per):
                        x |= (low[:, k * per + j] & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * j)
                    sig[full, k] = x.view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(k0), pa.array(k1), _lists(bands, BANDS), _lists(sig, sig.shape[1])], ["id", "n", "k0", "k1", "bands", "sig"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for part, texts in chunks(batches):
        sets = shingle_sets(texts, known)
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        turned = np.stack([np.bincount((x >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1 for x in sets]).astype(np.uint8)
        parities = np.packbits(turned, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))), _lists(parities, PARITIES // 64)], ["node", "hs", "parities"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for part, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingle_sets(texts, known)], pa.binary())], ["id", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            b = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"])
        give_back()

    return run


def _estimate(x: str, y: str):
    """Collision-corrected similarity of two packed signatures: equal groups of BITS bits, less those equal by chance."""
    differ = None
    mask = int("1" * (64 // BITS), 1 << BITS)
    for k in range(MINIMA * BITS // 64):
        d = F.expr(f"{x}[{k}] ^ {y}[{k}]")
        for s in (1, 2)[: BITS.bit_length() - 1]:
            d = d.bitwiseOR(F.shiftrightunsigned(d, s))
        n = F.bit_count(d.bitwiseAND(F.lit(mask)))
        differ = n if differ is None else differ + n
    chance = 2.0**-BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def _least(percent: int, minima: int, bits: int) -> float:
    """The estimate that a pair at the threshold exceeds but by MARGIN standard deviations."""
    chance, p = 2.0**-bits, percent / 100
    q = p + (1 - p) * chance
    return p - MARGIN * (q * (1 - q) / minima) ** 0.5 / (1 - chance)


def _classes(percent: int) -> int:
    """How many classes of sizes apart two sets of this similarity are at most."""
    return int(np.ceil(np.log(100 / percent) / np.log(STEP) + 1e-9))


def _prefixed(nodes: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """nodes: node, n (of each of its texts, if it has several); tokens: node, h (every shingle of each) -> node, h, lo, hi, small: the shingles by which a node meets
    those of the classes of sizes lo and hi, as the smaller or the larger of both (either, in its own class)."""
    # a shingle of one node only stands before all others, and meets none
    often = tokens.groupBy("h").count().where("count > 1")
    ranked = tokens.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("hs"))
    ranked = ranked.join(nodes.select("node", "n"), "node").select("node", "n", (F.col("n") - F.size("hs")).alias("alone"), F.posexplode("hs").alias("p", "x"))
    own, share = F.floor(F.log("n") / np.log(STEP)).cast("int"), percent / (100 + percent)
    k = F.explode(F.expr(f"sequence(-{_classes(percent)}, {_classes(percent)})"))
    at = ranked.select("node", "n", (F.col("alone") + F.col("p")).alias("before"), F.col("x.h").alias("h"), own.alias("c"), k.alias("k"))
    # the overlap that the least size of the other's class calls for, with a hair for rounding
    need = F.ceil(share * (F.col("n") + F.pow(F.lit(STEP), F.col("c") + F.col("k"))) - 1e-6)
    at = at.where(F.col("before") < F.col("n") - need + 1)
    return at.select("node", "h", (F.col("n") - F.col("before")).alias("left"), "n", F.least("c", F.col("c") + F.col("k")).alias("lo"), F.greatest("c", F.col("c") + F.col("k")).alias("hi"), (F.col("k") >= 0).alias("small"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of docs; links where 100 * intersection >= percent * union."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    s = materialize(docs.mapInArrow(_sign, "id long, n long, k0 long, k1 long, bands array<long>, sig array<long>"))
    least = _least(percent, MINIMA, BITS)
    # one node for each set: its smallest id
    nodes = materialize(s.where("n > 0 and id is not null").groupBy("k0", "k1").agg(F.min("id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    buckets = nodes.select("node", F.posexplode("bands").alias("i", "b"))
    shared = materialize(buckets.groupBy("b").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p < q").select("b", "p"))
    members = materialize(buckets.join(shared, "b").distinct())

    sigs = nodes.select("node", "sig")

    def estimated(pairs: DataFrame) -> DataFrame:
        x, y = sigs.selectExpr("node u", "sig su"), sigs.selectExpr("node v", "sig sv")
        return pairs.join(x, "u").join(y, "v").where(_estimate("su", "sv") >= least).select("u", "v").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs)
        ids = pairs.selectExpr("explode(array(u, v)) id").distinct()
        sets = materialize(docs.join(small(materialize(ids)), "id", "left_semi").mapInArrow(_sets, "id long, shingles binary"))
        both = pairs.join(sets.selectExpr("id u", "shingles a"), "u").join(sets.selectExpr("id v", "shingles b"), "v").select("u", "v", "a", "b")
        return both.mapInArrow(_confirm(percent), "u long, v long")

    # rows that share an id are one document, whatever their texts
    repeated = s.where("n > 0 and id is not null").groupBy("id").agg(F.min("k0").alias("x"), F.max("k0").alias("y")).where("x <> y").select("id")
    same = s.join(repeated, "id").join(nodes.select("k0", "k1", "node"), ["k0", "k1"]).selectExpr("id u", "node v")
    # stars, a few bands at a time: a member that is in its centre's component already needs no pair
    links, comp = same, None
    for lo, hi in ROUNDS:
        apart = members.where(F.col("i").between(lo, hi - 1) & (F.col("node") != F.col("p"))).select("p", "node")
        if comp is not None:
            apart = apart.join(comp, "node", "left").withColumnRenamed("component", "c").join(comp.selectExpr("node p", "component pc"), "p", "left").where("coalesce(c, node) <> coalesce(pc, p)")
        links = materialize(confirmed(estimated(apart.selectExpr("p u", "node v").distinct())).unionByName(links).distinct())
        comp = connected_components(links)
    # members of buckets that still hold several components
    placed = members.join(comp, "node", "left").selectExpr("b", "i", "node", "coalesce(component, node) c")
    open_ = placed.groupBy("b").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("b")
    rest = materialize(placed.join(open_, "b").select("node", "c").distinct().join(s.where("n > 0 and id is not null").selectExpr("id node", "n").distinct(), "node"))
    ids = small(materialize(rest.select(F.col("node").alias("id")).distinct()))
    found = materialize(docs.join(ids, "id", "left_semi").mapInArrow(_shingles, "node long, hs array<long>, parities array<long>"))
    tokens = found.select("node", F.explode("hs").alias("h")).distinct()
    # those of an id with several texts say nothing
    parities = found.groupBy("node").agg(F.when(F.min("parities") == F.max("parities"), F.min("parities")).alias("parities"))
    met = materialize(_prefixed(rest, tokens, percent).join(rest.select("node", "c").distinct(), "node"))
    # the largest component of a place never meets itself
    place = ["h", "lo", "hi"]
    main = met.groupBy(*place, "c").count().groupBy(*place).agg(F.max_by("c", F.struct("count", "c")).alias("m"), F.count("*").alias("components")).where("components > 1")
    met = materialize(met.join(main.select(*place, "m"), place).join(parities, "node"))
    l = met.selectExpr(*place, "node u", "c cu", "small su", "m", "n nu", "left lu", "parities pu")
    r = met.where("c <> m").selectExpr(*place, "node v", "c cv", "small sv", "n nv", "left lv", "parities pv")
    # from the first shingle that both have on, enough must be left of either, and no more parities differ than shingles may
    both = F.ceil(percent / (100 + percent) * (F.col("nu") + F.col("nv")) - 1e-6)
    differ = sum((F.bit_count(F.expr(f"pu[{k}] ^ pv[{k}]")) for k in range(PARITIES // 64)), F.lit(0))
    enough = (F.least("lu", "lv") >= both) & F.coalesce(differ <= F.col("nu") + F.col("nv") - 2 * both, F.lit(True))
    pairs = l.join(r, place).where("cu <> cv and (lo = hi or su <> sv) and (cu = m or u < v)").where(enough).selectExpr("least(u, v) u", "greatest(u, v) v").distinct()
    bands = nodes.select("node", "bands")
    pairs = pairs.join(bands.selectExpr("node u", "bands bu"), "u").join(bands.selectExpr("node v", "bands bv"), "v").where("exists(zip_with(bu, bv, (x, y) -> x = y), z -> z)").select("u", "v")
    more = confirmed(estimated(pairs))
    comp = connected_components(links.unionByName(more))
    classes = materialize(nodes.join(comp, "node", "left").selectExpr("k0", "k1", "coalesce(component, node) component"))
    alone = s.where("n = 0 or id is null").selectExpr("id", "n n_shingles", "id component_id", "true kept")
    linked = s.where("n > 0 and id is not null").select("id", "n", "k0", "k1").join(classes, ["k0", "k1"])
    out = linked.selectExpr("id", "n n_shingles", "component component_id", "id = component kept").unionByName(alone)
    return out.withColumnRenamed("id", id_col)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
ORACLES: dict[str, str] = {}
