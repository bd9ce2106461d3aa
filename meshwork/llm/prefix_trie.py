"""The prefix trie of conversations, totalled from its leaves by messages to parents.

Turns. A turn counts as its role and text; of both only a digest of 120 bits and the
number of bytes travel on. Positions in a conversation come from a range partition of
all turns and the counts of its pieces, so a conversation may fill many tasks.

Nodes. A node is a sequence of first turns. Its key is the exclusive-or of two 64-bit
hashes of (place, turn), which is associative: prefixes are running values inside
blocks of BLOCK turns, plus the value of the blocks before. A key without its last
turn is the parent's key.

Runs. The smallest member of a node is also that of one of its children, unless it
ends there, so nodes fall into runs, one for each smallest member, of consecutive
depths. A run has one row in the message passing. It holds a counter of the children
of its nodes that lie in other runs and haven't reported, and the totals so far. Runs
with the counter at 0 send their totals to the run of their top's parent, messages to
one run are added up before the shuffle, and the receivers' counters fall; until only
the root's run finishes. Rounds grow with the number of runs between root and leaf,
not with the length of conversations. What the nodes of a run have under them are
then running sums from its bottom, again in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import NUMBER_ROWS, drop_table, files_for, materialize
from .text import small_batches

#: Turns of a block (a power of two), and its logarithm; ids that a chunk of a list holds at most.
BLOCK, BLOCK_BITS, CHUNK = 1024, 10, 20_000

_KEYS = ["k1", "k2"]


@dataclass(frozen=True)
class Trie:
    """nodes and ends of a trie.

    ``nodes``: k1, k2 (key), d1, d2 (digest of the last turn, null at the root),
    depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens. ``ends``: k1, k2, conv_id of each conversation, at its last node.
    """

    nodes: DataFrame
    ends: DataFrame

    def with_texts(self, conversations: DataFrame) -> DataFrame:
        """The nodes with role and text of their last turn."""
        t = turn_facts(conversations, ["role", "text"]).dropDuplicates(["d1", "d2"]).select("d1", "d2", "role", "text")
        return self.nodes.join(t, ["d1", "d2"], "left")


def _parts(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows: the session's number, more where they would be long."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), files_for(rows, NUMBER_ROWS))


def turn_facts(conversations: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(conv_id, turn, d1, d2, n_bytes) of each row: digest of role and text, bytes of the text; nulls there are empty.

    Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    hexed = rows.withColumn("_h", F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256))
    part = lambda at: F.conv(F.substring("_h", at, 15), 16, 10).cast("long")
    return hexed.select("conv_id", "turn", part(1).alias("d1"), part(16).alias("d2"), F.octet_length("text").cast("long").alias("n_bytes"), *(keep or []))


def positions(facts: DataFrame) -> DataFrame:
    """(conv_id, pos, d1, d2, n_bytes): places 0, 1 ... in each conversation by turn, nulls first; of one turn by digest.

    Counted by sorted partition; conversations that go on in another partition get
    the rows before, a row for each partition at most.
    """
    facts = materialize(facts, "facts")
    keys = ["conv_id", "turn", "d1", "d2"]
    small_batches(facts.sparkSession)
    schema = "conv_id long, d1 long, d2 long, n_bytes long, part int, at long"
    arrow = pa.schema([(c, pa.int32() if c == "part" else pa.int64()) for c in ("conv_id", "d1", "d2", "n_bytes", "part", "at")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not len(b):
                continue
            conv = b.column(0).to_numpy()
            begin = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            at = np.arange(len(conv)) - np.repeat(begin, np.diff(np.r_[begin, len(conv)]))
            if conv[0] == last:
                at[: begin[1] if len(begin) > 1 else len(conv)] += done
            last, done = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(np.full(len(conv), part, np.int32)), pa.array(at)], schema=arrow)

    ordered = facts.repartitionByRange(_parts(facts, facts.count()), *keys).sortWithinPartitions(*keys)
    counted = materialize(ordered.select("conv_id", "d1", "d2", "n_bytes").mapInArrow(run, schema), "counted")
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = counted.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(upto)).where("before is not null").select("conv_id", "part", "before")
    return counted.join(F.broadcast(spans), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "d1", "d2", "n_bytes")


def shared_starts(positioned: DataFrame, every: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of conversations rebuilt on another's start.

    With h = crc32(decimal c) % modulus, conversation c is the first h turns of
    c - c % every, none where that one is absent, then its own turns after the first
    h. turns: conv_id, i, d1, d2, n_bytes; members: conv_id, turnless ones too.
    """
    positioned = materialize(positioned, "positioned")
    own = positioned.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = own.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % modulus).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = materialize(convs.select("conv_id", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("lent")), "convs")
    rest = positioned.join(convs.drop("base"), "conv_id").where("pos >= h").select("conv_id", (F.col("lent") + F.col("pos") - F.col("h")).alias("i"), "d1", "d2", "n_bytes")
    heads = positioned.where((F.col("pos") < modulus - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    lent = heads.join(convs, "base").where("pos < h").select("conv_id", F.col("pos").alias("i"), "d1", "d2", "n_bytes")
    return rest.unionByName(lent), convs.select("conv_id")


def _along(rows: DataFrame, key: str, at: str, values: dict[str, Column], combine, down: bool) -> DataFrame:
    """``rows`` with running values along each key by ``at``, descending where not ``down``: in blocks, with what the blocks before have."""
    rows = rows.withColumn("_block", F.shiftright(at, BLOCK_BITS))
    order = (lambda c: F.col(c)) if down else (lambda c: F.col(c).desc())
    several = rows.groupBy(key).agg(F.min("_block").alias("_a"), F.max("_block").alias("_b")).where("_a < _b").select(key)
    whole = rows.join(several, key, "left_semi").groupBy(key, "_block").agg(*[combine(v).alias(f"_{n}") for n, v in values.items()])
    before = Window.partitionBy(key).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(key, "_block", *[combine(F.col(f"_{n}")).over(before).alias(f"_{n}") for n in values])
    inside = Window.partitionBy(key, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[combine(v).over(inside).alias(n) for n, v in values.items()])
    return rows.join(whole, [key, "_block"], "left").drop("_block")


def _peel(state: DataFrame) -> DataFrame:
    """(run, parent, at, n_leaves, saved) of all runs with their whole subtrees.

    ``state``: run, parent, at, waiting (children in other runs that haven't
    reported), n_leaves and saved of the run alone. Each round writes the completed
    runs and the others.
    """
    finished = []
    while not state.isEmpty():
        done = materialize(state.where("waiting = 0").drop("waiting"), "done")
        finished.append(done)
        sent = done.where("parent is not null").groupBy(F.col("parent").alias("run")).agg(F.count("*").alias("_n"), F.sum("n_leaves").alias("_l"), F.sum("saved").alias("_s"))
        rest = state.where("waiting > 0").join(sent, "run", "left")
        plus = lambda c, x: F.col(c) + F.coalesce(x, F.lit(0))
        after = rest.select("run", "parent", "at", (F.col("waiting") - F.coalesce("_n", F.lit(0))).alias("waiting"), plus("n_leaves", "_l").alias("n_leaves"), plus("saved", "_s").alias("saved"))
        after = materialize(after, "waiting")
        drop_table(state)
        state = after
    return reduce(lambda a, b: a.unionByName(b), finished) if finished else state.drop("waiting")


def build_trie(turns: DataFrame, members: DataFrame) -> Trie:
    """The trie of sequences: ``turns`` (conv_id, i, d1, d2, n_bytes), i from 0 without gaps, and ``members`` (conv_id), turnless ones too.

    No member, no node.
    """
    hashed = materialize(turns.select("conv_id", "i", "d1", "d2", "n_bytes", F.xxhash64("d1", "d2", "i").alias("h1"), F.xxhash64("i", "d2", F.lit("turn"), "d1").alias("h2")), "turns")
    along = _along(hashed, "conv_id", "i", {"x1": F.col("h1"), "x2": F.col("h2")}, F.bit_xor, True)
    key = lambda n: F.col(f"x{n}").bitwiseXOR(F.coalesce(F.col(f"_x{n}"), F.lit(0).cast("long")))
    paths = along.select("conv_id", (F.col("i") + 1).alias("depth"), key(1).alias("k1"), key(2).alias("k2"), "h1", "h2", "d1", "d2", "n_bytes")
    paths = materialize(paths, "paths")
    zero = F.lit(0).cast("long")

    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("x")).select("conv_id", "x.k1", "x.k2")
    bare = members.select("conv_id").distinct().join(last.select("conv_id"), "conv_id", "left_anti").select("conv_id", zero.alias("k1"), zero.alias("k2"))
    ends = materialize(last.unionByName(bare), "ends")

    same = ["depth", "d1", "d2", "h1", "h2", "n_bytes"]
    nodes = paths.groupBy(*_KEYS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in same])
    nodes = nodes.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("h1")), "p2": F.col("k2").bitwiseXOR(F.col("h2"))}).drop("h1", "h2")
    none = F.lit(None).cast("long")
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("conv_id is not null")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("depth"), none.alias("d1"), none.alias("d2"), zero.alias("n_bytes"), none.alias("p1"), none.alias("p2"))
    nodes = materialize(nodes.unionByName(root), "nodes")

    own = (F.col("n_convs") - 1) * F.col("n_bytes")
    runs = nodes.groupBy(F.col("conv_id").alias("run")).agg(F.min(F.struct("depth", "p1", "p2")).alias("x"), F.max("depth").alias("bottom"), F.sum(own).alias("saved"))
    runs = runs.select("run", F.col("x.depth").alias("top"), F.col("x.p1").alias("p1"), F.col("x.p2").alias("p2"), "bottom", "saved")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    under = runs.where("top > 0").join(above, ["p1", "p2"]).select("run", "parent", (F.col("top") - 1).alias("at"), "top", "bottom", "saved")
    runs = materialize(under.unionByName(runs.where("top = 0").select("run", none.alias("parent"), none.alias("at"), "top", "bottom", "saved")), "runs")

    sides = runs.where("parent is not null").groupBy(F.col("parent").alias("run"), F.col("at").alias("bottom")).agg(F.count("*").alias("_n"))
    counters = sides.groupBy("run").agg(F.sum("_n").alias("waiting"))
    state = runs.join(counters, "run", "left").join(sides, ["run", "bottom"], "left")
    state = state.select("run", "parent", "at", F.coalesce("waiting", F.lit(0)).alias("waiting"), F.when(F.col("_n").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_leaves"), "saved")
    finished = materialize(_peel(materialize(state, "waiting")), "finished")

    from_sides = finished.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("n_side"), F.sum("n_leaves").alias("l_side"), F.sum("saved").alias("s_side"))
    tops = runs.select(F.col("run").alias("conv_id"), F.col("top").alias("depth"), "parent", (F.col("top") == F.col("bottom")).alias("is_bottom"))
    bottoms = runs.where("top < bottom").select(F.col("run").alias("conv_id"), F.col("bottom").alias("depth"), none.alias("parent"), F.lit(True).alias("is_bottom"))
    full = nodes.join(tops.unionByName(bottoms), ["conv_id", "depth"], "left").join(from_sides, ["conv_id", "depth"], "left")
    side = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ending = F.coalesce("is_bottom", F.lit(False))
    full = full.select(
        "k1", "k2", "d1", "d2", "depth", "conv_id", "n_convs",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        (side("n_side") + F.when(ending, F.lit(0)).otherwise(F.lit(1))).cast("long").alias("n_children"),
        (side("l_side") + F.when(ending & (side("n_side") == 0), F.lit(1)).otherwise(F.lit(0))).cast("long").alias("l_here"),
        (side("s_side") + own).alias("s_here"),
    )
    full = _along(materialize(full, "full"), "conv_id", "depth", {"l": F.col("l_here"), "s": F.col("s_here")}, F.sum, False)
    total = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).cast("long")
    found = full.select(*_KEYS, "d1", "d2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", total("l").alias("n_leaves"), total("s").alias("saved_tokens"))
    return Trie(found, ends)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of each node's conv_ids, ascending, in decimal, joined by commas.

    Sorted partitions first turn ids into chunks of text; a digest is then taken over
    a node's chunks, read as a stream.
    """
    small_batches(ends.sparkSession)
    parts = _parts(ends, ends.count())
    pieces = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    digests = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, size = None, [], [], 0
        for b in batches:
            for k1, k2, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if ids and (key != (k1, k2) or len(ids) >= CHUNK):
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                    size, ids = size + len(ids), []
                key = (k1, k2)
                ids.append(c)
            if size >= CHUNK:
                yield batch(rows, pieces)
                rows, size = [], 0
        if ids:
            yield batch([*rows, (*key, ids[0], ",".join(map(str, ids)))], pieces)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed, rows = None, None, []

        for b in batches:
            for k1, k2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key == (k1, k2):
                    hashed.update(b"," + ids.encode())
                else:
                    if key is not None:
                        rows.append((*key, hashed.hexdigest()))
                    key, hashed = (k1, k2), hashlib.sha256(ids.encode())
            if len(rows) >= 1000:
                yield batch(rows, digests)
                rows = []
        if key is not None:
            yield batch([*rows, (*key, hashed.hexdigest())], digests)

    text = ends.select(*_KEYS, "conv_id").repartitionByRange(parts, *_KEYS, "conv_id").sortWithinPartitions(*_KEYS, "conv_id").mapInArrow(chunks, "k1 long, k2 long, first long, ids string")
    return text.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS, "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, every: int = 5, modulus: int = 9) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations (see :func:`shared_starts`).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Null turns come first, turns of one number in the order of their
    digests; a null role or text is empty; repeated rows are turns of their own; rows
    without a conv_id are left out; an empty table gives an empty result; other
    columns are ignored.
    """
    trie = build_trie(*shared_starts(positions(turn_facts(conversations)), every, modulus))
    none = hashlib.sha256(b"").hexdigest()
    found = trie.nodes.join(ends_digests(trie.ends), _KEYS, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
