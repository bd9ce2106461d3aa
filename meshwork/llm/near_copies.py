"""Near copies by their word shingles: SimHash groups, then banded MinHash; every link is an exact Jaccard.

Texts with the same set of shingles are one node, however many documents carry it.

1. SimHash. The nodes' fingerprints are grouped by the operator of ``simhash``; each
   node is compared with the least of its group. Sets of similarity 0.8 differ in
   10 of 64 bits on average, so most near copies with several edits are in no group.
2. MinHash. Every node has BANDS keys, each from ROWS minima of its set under hash
   functions of their own; two nodes meet where a key is equal. Sets of similarity s
   miss each other with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8, less above.
   Pairs whose sizes exclude the similarity, or that differ in more than APART of the
   128 lowest bits of the minima (13 expected at 0.8, deviation 3.4), are let go.
3. Links only matter between components. In each round a node is compared with one
   member of the largest component of each of its keys, PICKS at most, the likest
   first. In the first round that is the member that meets most others, which in a
   family of copies is what they were copied from; afterwards a random one. This goes
   on while a quarter of them are links, and joins a family of near copies without
   ever forming its pairs. At last all pairs of a key that are still in different
   components and weren't compared are, so no link is lost.

A comparison reads both whole sets. A node's set travels once to each node that it
is compared with; those compared with many are split over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import NUMBER_ROWS, broadcast_if_small, drop_table, files_for, materialize
from .simhash import SEED, group_prints, shingle_hashes, simhash_of
from .text import ROWS as TEXTS
from .text import map_texts, words

#: Words of a shingle, least Jaccard similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8

#: Keys of a node, minima of a key, bits that may differ.
BANDS, ROWS, APART = 32, 4, 32

#: Comparisons of a node in a round, share of links that makes another round worth it.
PICKS, WORTH = 3, 0.25

#: Nodes compared with another in one task; ids (a long each) that may be broadcast.
MEMBERS, IDS = 2_000, 1_000_000

_rng = np.random.default_rng(SEED)
_TIMES, _PLUS = (_rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_MIX = _rng.integers(0, 1 << 63, (ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(ws: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles in ascending order; none without words."""
    return np.unique(shingle_hashes(ws, shingle))


def minima(h: np.ndarray) -> np.ndarray:
    """Least value of a set that isn't empty under each hash function."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(h), 4096):
        least = np.minimum(least, (h[None, i : i + 4096] * _TIMES + _PLUS).min(1))
    return least ^ (least >> np.uint64(29))


def band_keys(least: np.ndarray) -> np.ndarray:
    """BANDS keys of minima."""
    return (least.reshape(BANDS, ROWS, 1) * _MIX).sum((1, 2), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _TIMES[0, 0]


def low_bits(least: np.ndarray) -> np.ndarray:
    """A mixed bit of each minimum, in two signed longs."""
    return np.packbits((least >> np.uint64(17) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key of the shingle set, its size, band keys and low bits, and the SimHash of every row."""

    def make():
        def run(ids, texts):
            out = {k: [] for k in ("key", "n", "bands", "low0", "low1", "simhash")}
            for t in texts:
                every = shingle_hashes(words(t), shingle)
                h = np.unique(every)
                least = minima(h) if len(h) else None
                low = low_bits(least) if len(h) else (0, 0)
                values = xxhash.xxh3_128_digest(h.tobytes()), len(h), band_keys(least).view(np.int64) if len(h) else [], low[0], low[1], np.uint64(simhash_of(every)).view(np.int64)
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            return {"doc_id": ids, **out}

        return run

    return map_texts(docs, make, "doc_id long, key binary, n long, bands array<long>, low0 long, low1 long, simhash long")


def alike(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (a, b) of materialised ``pairs`` whose texts' shingle sets have at least ``similarity``; ids are distinct."""
    files = files_for(pairs.count(), NUMBER_ROWS)
    many = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "many", files)
    members = pairs.join(many, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("role"))
    heads = many.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    asked = materialize(members.unionByName(heads).groupBy("doc_id").agg(F.collect_list(F.struct("a", "part", "role")).alias("groups")), "asked", files)
    some = docs.join(broadcast_if_small(asked.select("doc_id"), IDS), "doc_id", "left_semi").join(asked, "doc_id")
    kinds = pa.schema([("a", pa.int64()), ("part", pa.int32()), ("role", pa.int32()), ("b", pa.int64()), ("hashes", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1) for b in batches for i in range(len(b))):
            doc, text, groups = (b.column(c)[0].as_py() for c in ("doc_id", "text", "groups"))
            raw = shingle_set(words(text), shingle).tobytes()
            for i in range(0, len(groups), 100):
                g = groups[i : i + 100]
                yield pa.RecordBatch.from_arrays([pa.array([x["a"] for x in g], pa.int64()), pa.array([x["part"] for x in g], pa.int32()), pa.array([x["role"] for x in g], pa.int32()), pa.array([doc] * len(g), pa.int64()), pa.array([raw] * len(g), pa.binary())], schema=kinds)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for b in (b.slice(i, TEXTS) for b in batches for i in range(0, len(b), TEXTS)):
            found = []
            for i, (a, role, other) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "role", "b")), strict=True)):
                h = np.frombuffer(b.column("hashes")[i].as_buffer(), np.uint64)
                if not role:
                    head = h.copy()
                elif len(head) and len(h):
                    at = np.minimum(np.searchsorted(head, h), len(head) - 1)
                    same = int((head[at] == h).sum())
                    if same / (len(head) + len(h) - same) >= similarity:
                        found.append((a, other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    dealt = some.select("doc_id", "text", "groups").mapInArrow(sets, "a long, part int, role int, b long, hashes binary")
    dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return dealt.mapInArrow(compared, "a long, b long")


class _Components:
    """Components of the nodes so far, and the pairs that were compared."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float):
        self.docs, self.shingle, self.similarity = docs, shingle, similarity
        self.files = files_for(nodes.count(), NUMBER_ROWS)
        self.named = nodes.select("node", F.col("node").alias("component"))
        self.tested = None

    def compare(self, pairs: DataFrame) -> float:
        """Compare (a, b), join what is linked; the share of pairs that are."""
        pairs = materialize(pairs, "compared", 8 * self.files)
        both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        self.tested = both if self.tested is None else self.tested.unionByName(both)
        links = materialize(alike(self.docs, pairs, self.shingle, self.similarity), "links", self.files)
        linked = links.count()
        if not linked:
            return 0.0
        of = self.named
        ends = links.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select("ca", "cb")
        joined = materialize(connected_components(ends, "ca", "cb", self.files), "joined", self.files)
        after = of.join(joined.toDF("component", "least"), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
        self.named = materialize(after, "components", self.files)
        return linked / pairs.count()

    def untested(self, pairs: DataFrame) -> DataFrame:
        """(a, b, ...) without those that were compared."""
        if self.tested is None:
            return pairs
        t = self.tested.toDF("ta", "tb")
        return pairs.join(t, (F.least("a", "b") == F.col("ta")) & (F.greatest("a", "b") == F.col("tb")), "left_anti")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id, the least doc_id reachable over links of at least ``similarity``, of every row.

    doc_ids are distinct and not null. Texts without words are alike; one of fewer
    words than a shingle has is a shingle as a whole. Ties and repeated texts are one
    node; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.count()
    files = files_for(rows)
    signed = materialize(_signatures(docs, shingle), "signatures", files)
    nodes = materialize(signed.groupBy("key").agg(F.min("doc_id").alias("node")), "nodes", files_for(rows, NUMBER_ROWS))
    own = materialize(signed.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").where("n > 0").drop("key"), "own", files)
    state = _Components(docs, nodes, shingle, similarity)
    groups = group_prints(own.select("doc_id", "simhash")).select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    state.compare(groups)

    keys = own.select(F.col("doc_id").alias("node"), "n", "low0", "low1", F.explode("bands").alias("band"))
    crowded = keys.groupBy("band").agg(F.count("*").alias("met")).where("met > 1")
    shared = materialize(keys.join(crowded, "band"), "shared", files)
    degrees = materialize(shared.groupBy("node").agg(F.sum("met").alias("degree")), "degrees", files_for(rows, NUMBER_ROWS))
    bits = F.bit_count(F.col("low0").bitwiseXOR(F.col("r_low0"))) + F.bit_count(F.col("low1").bitwiseXOR(F.col("r_low1")))
    possible = (F.least("n", "r_n") / F.greatest("n", "r_n") >= similarity) & (bits <= APART)

    def mixed() -> DataFrame:
        """Nodes by key, with their components, where a key has several."""
        now = shared.drop("met").join(state.named, "node").join(degrees, "node")
        several = now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
        return materialize(now.join(several, "band"), "mixed", files)

    def first(turn: int):
        """The least is the hub of its component in a key."""
        return F.struct(-F.col("degree"), F.col("node")) if turn == 1 else F.struct(F.xxhash64("node", "band", F.lit(turn)), F.col("node"))

    turn, share = 0, 1.0
    while share >= WORTH:
        now, turn = mixed(), turn + 1
        sizes = now.groupBy("band", "component").agg(F.count("*").alias("c"), F.min_by(F.struct("node", "n", "low0", "low1"), first(turn)).alias("x"))
        hubs = sizes.groupBy("band").agg(F.max_by(F.struct("component", "x"), F.struct("c", -F.col("component"))).alias("hub"))
        hubs = hubs.select("band", F.col("hub.component").alias("r_component"), F.col("hub.x.node").alias("a"), *[F.col(f"hub.x.{c}").alias(f"r_{c}") for c in ("n", "low0", "low1")])
        met = now.join(hubs, "band").where((F.col("component") != F.col("r_component")) & possible).select("a", F.col("node").alias("b"), bits.alias("bits")).distinct()
        picked = state.untested(met).groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("bits", "a"))), 1, PICKS).alias("p"))  # BANDS at most
        share = state.compare(picked.select("b", F.explode("p").alias("p")).select("p.a", "b"))
        drop_table(now)
    now = mixed()
    of = now.select("band", "component").distinct()
    across = of.join(of.withColumnRenamed("component", "r_component"), "band").where(F.col("component") < F.col("r_component"))
    left = now.withColumnRenamed("node", "a")
    right = now.select("band", F.col("component").alias("r_component"), F.col("node").alias("b"), *[F.col(c).alias(f"r_{c}") for c in ("n", "low0", "low1")])
    pairs = across.join(left, ["band", "component"]).join(right, ["band", "r_component"]).where(possible).select("a", "b").distinct()
    state.compare(state.untested(pairs))
    named = nodes.join(state.named, "node").select("key", F.col("component").alias("component_id"))
    return signed.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")
