"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check.

A fingerprint of 64 bits is cut into 32 segments of two bits; the embedding is the
number of set bits in each segment. A differing bit changes one count by at most
one, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints. Counts of 0, 1 or 2 are held in unary (00, 01, 11),
which makes the Manhattan distance the popcount of an exclusive or, and a step to
a neighbouring grid cell the flip of one bit.

Of fingerprints within three bits one half differs by one bit at most, so its
embedding lies in the same or in an adjacent cell of that half's grid. Of two
adjacent cells one has an even sum of counts: only the fingerprints there visit
neighbours. Pairs that meet pass the bound over both halves, then the exact
Hamming test. Equal fingerprints are one node, however many documents carry it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import NUMBER_ROWS, broadcast_if_small, files_for, materialize
from .text import free_name, map_texts, words

RADIUS, SEED = 3, 42
_LOW = 0x5555555555555555
_ROW = "__row"


def shingle_hashes(ws: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the shingles in their order, repeats included; fewer words are one shingle, none have none."""
    line, k = b" ".join(ws), min(shingle, len(ws))
    starts = list(accumulate([0, *(len(w) + 1 for w in ws)]))
    return np.array([xxhash.xxh64_intdigest(line[s : e - 1], SEED) for s, e in zip(starts, starts[k:])] if ws else [], np.uint64)


def fingerprint(ws: list[bytes], shingle: int = 3) -> int:
    """SimHash of the shingles, repeats included, as an unsigned 64-bit number; 0 without words."""
    return simhash_of(shingle_hashes(ws, shingle))


def simhash_of(h: np.ndarray) -> int:
    """SimHash of hashes; 0 of none."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and simhash (the fingerprint's bits as a signed long) of every row; a null text is empty."""

    def make():
        def run(ids, texts):
            f = np.array([fingerprint(words(t), shingle) for t in texts], np.uint64)
            return {"doc_id": ids, "simhash": f.view(np.int64)}

        return run

    return map_texts(docs, make, "doc_id long, simhash long")


def embedding(x: Column) -> Column:
    """Set bits of each two-bit segment, in unary."""
    y = F.shiftrightunsigned(x, 1)
    low, high = x.bitwiseOR(y).bitwiseAND(F.lit(_LOW)), x.bitwiseAND(y).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(high, 1))


def _steps(half: Column) -> list[Column]:
    """The cells one step away in the grid of 16 counts; null where a count would leave 0..2."""
    out = []
    for j in range(0, 32, 2):
        low, high = 1 << j, 2 << j
        out.append(F.when(half.bitwiseAND(F.lit(high)) == 0, half.bitwiseXOR(F.lit(low))))
        out.append(F.when(half.bitwiseAND(F.lit(low)) != 0, half.bitwiseXOR(F.lit(high))))
    return out


def near_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct ``simhash`` values within RADIUS bits."""
    sides = []
    for k in (0, 1):
        u = embedding(F.col("simhash"))
        half = F.shiftrightunsigned(u, 32) if k else u.bitwiseAND(F.lit(0xFFFFFFFF))
        sides.append(nodes.select("simhash", F.lit(k).alias("k"), half.alias("cell")))
    cells = sides[0].unionByName(sides[1])
    even = F.bit_count("cell") % 2 == 0
    visits = F.when(even, F.array(F.col("cell"), *_steps(F.col("cell")))).otherwise(F.array("cell"))
    left = cells.select(F.col("simhash").alias("x"), "k", F.col("cell").alias("home"), F.explode(visits).alias("cell")).where("cell is not null")
    met = left.join(cells.withColumnRenamed("simhash", "y"), ["k", "cell"]).where((F.col("home") != F.col("cell")) | (F.col("x") < F.col("y")))
    bound = F.bit_count(embedding(F.col("x")).bitwiseXOR(embedding(F.col("y")))) <= RADIUS
    exact = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS
    return met.where(bound & exact).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id and links of every row.

    component_id is the least doc_id reachable over links of at most RADIUS bits,
    links the number of other fingerprints linked to the row's own. Texts without
    words, null ones among them, have fingerprint zero and are linked like any
    other. A null doc_id names a component only where it has no other; repeated
    rows come back repeated; an empty table gives an empty result; other columns
    are ignored.
    """
    return group_prints(materialize(fingerprints(docs, shingle), "simhash", files_for(docs.count()))).select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id", "links")


def group_prints(prints: DataFrame) -> DataFrame:
    """doc_id, simhash, component_id and links of materialised ``prints`` (doc_id, simhash): see :func:`near_groups`."""
    files = files_for(prints.count(), NUMBER_ROWS)
    nodes = materialize(prints.groupBy("simhash").agg(F.min("doc_id").alias("least")), "nodes", files)
    pairs = materialize(near_pairs(nodes.select("simhash")), "pairs", 8 * files)
    groups = connected_components(pairs, files=files)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    linked = materialize(groups.join(ends, "node").join(nodes.withColumnRenamed("simhash", "node"), "node"), "linked", files)
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "component").select(F.col("node").alias("simhash"), "component_id", "links")
    every = nodes.join(named, "simhash", "left").select("simhash", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return prints.join(every, "simhash").select("doc_id", "simhash", "component_id", "links")


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_groups) -> DataFrame:
    """One row of each component that ``groups`` finds, that of the least doc_id, as it is.

    Rows are told apart by a number of their own, so null and repeated ids lose
    nothing; a row with a null id stands for a component only where it has no other.
    """
    row = free_name(docs, _ROW)
    files = files_for(docs.count())
    rows = materialize(docs.coalesce(files).withColumn(row, F.monotonically_increasing_id()), "rows")
    found = groups(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(row).alias("row")).alias("order")
    named = materialize(found.join(rows.select(row, order), row), "named", files)
    kept = named.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.row").alias(row))
    dropped = materialize(named.select(row).join(kept, row, "left_anti"), "dropped", files)
    return rows.join(broadcast_if_small(dropped), row, "left_anti").drop(row)
