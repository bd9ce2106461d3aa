"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document d of size x words is a unit of the base measure q (1, or its prior
rate). The mix chooses rates r that stay closest to it in entropy, sum over
documents of r log(r / q) - r + q, under one token constraint per source (sum of
r x equals the source's target) and 0 <= r <= cap. The convex dual has one
multiplier per source; its minimiser tilts every document's rate exponentially in
its size: r = min(cap, q exp(lambda_source x / mean size of the source)). So a
source that must grow takes more copies of its long documents than of its short
ones, and one that must shrink loses long ones first. Newton steps on the
logarithm of the constraint, kept inside a shrinking bracket, run over exact cells
of (source, prior, size), for all sources at once.

Rates become copies by sequential Poisson rounding: a document has floor(r)
copies, and one more in the order of hash / fraction for as long as the source's
target has room. The cut in that order is found digit by digit over histograms,
so no source is ever sorted or gathered. A few documents of each source, those whose
sizes come nearest to what is left, are taken once more or once less to close the gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, files_for, materialize
from .text import WORD, free_name

DIGIT = 12  # bits of a rounding key that one histogram resolves
DIGITS = 4
_ROW, _PART = "__row", "__part"


def numbered_rows(docs: DataFrame, row: str = _ROW, part: str = _PART) -> DataFrame:
    """``docs`` as written, with a number of its own for each row and its partition's, in columns of these names."""
    files = files_for(docs.count())
    return materialize(docs.coalesce(files).withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.spark_partition_id()), "rows")


def sized(docs: DataFrame, prior: str | None = None, row: str = _ROW, part: str = _PART) -> DataFrame:
    """row, part, doc_id, source, size (words; null text: 0), q and a hash of the text of every numbered row."""
    q = F.greatest(F.coalesce(F.col(prior).cast("double"), F.lit(1.0)), F.lit(0.0)) if prior else F.lit(1.0)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    ids = [F.col(row).alias("row"), F.col(part).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")]
    return docs.select(*ids, size.alias("size"), q.alias("q"), F.xxhash64("text").alias("body"))


def with_turns(base: DataFrame, files: int) -> DataFrame:
    """A materialised ``base`` with nth: 0, 1, 2 ... among the rows of one id and text, however they are spread.

    Repeats are numbered within their partitions, and partitions by their counts, so
    no key gathers its rows in one task.
    """
    keys = ["doc_id", "source", "size", "body"]
    some = base.where("size > 0")
    per = some.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    every = F.sum("n").over(Window.partitionBy(*keys))
    per = per.withColumn("ahead", F.coalesce(ahead, F.lit(0))).withColumn("every", every).where("every > 1")
    p = materialize(per.select(*[F.col(k).alias(f"r_{k}") for k in [*keys, "part"]], "ahead"), "repeats", files)
    same = F.col("part") == F.col("r_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    nth = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("row")) - 1 + F.col("ahead")
    turns = some.join(broadcast_if_small(p), same).select(F.col("row").alias("r"), nth.alias("nth")).where("nth > 0")
    turns = broadcast_if_small(materialize(turns, "turns", files))
    return materialize(base.join(turns, F.col("row") == F.col("r"), "left").drop("r", "part").withColumn("nth", F.coalesce("nth", F.lit(0))), "numbered", files)


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: weights in code point order of sources, null last, repeating.

    A target stops at cap times its source's size; what is above goes to the
    others by weight, until none is above: target = min(cap * size, level *
    weight), and the level is where the capped sources, those of the least
    cap * size / weight, leave the rest to the others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("ratio", F.when(F.col("weight") > 0, F.col("most") / F.col("weight")).otherwise(F.lit(float("inf"))))
    rows = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (whole - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.nullif(F.sum("weight").over(rest), F.lit(0.0))
    ranked = ranked.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("level").alias("v")))).over(Window.partitionBy())["v"]
    return ranked.withColumn("v", F.coalesce(level, F.lit(float("inf")))).select("source", "source_size", F.when(F.col("weight") > 0, F.least(F.col("most"), F.col("v") * F.col("weight"))).otherwise(F.lit(0.0)).alias("target"))


def multipliers(cells: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-10, rounds: int = 200) -> DataFrame:
    """source, source_size, target, mean and lam: the dual's minimiser, by safeguarded Newton steps for all sources at once.

    ``cells``: source, q, size and n (documents of that prior and size). A target at
    or above what the cap allows has every rate at the cap; one of 0 has none.
    Raises where ``rounds`` steps don't reach the tolerance.
    """
    top = F.lit(float(cap))
    cells = cells.where("size > 0 and q > 0").withColumnRenamed("source", "s")
    per = cells.groupBy("s").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"), F.max("q").alias("most"), F.sum(F.col("size") * F.col("n")).alias("mass"), F.max(F.log(top / F.col("q")) / F.col("size")).alias("high"))
    state = goals.join(per, F.col("s").eqNullSafe(F.col("source")), "left")
    low = F.log(F.col("target") / (F.col("mass") * F.col("most"))) * F.col("mean") / F.col("least")
    high = F.greatest(F.col("high") * F.col("mean"), F.lit(0.0)) + 1
    full, none = F.col("target") >= F.col("mass") * top * (1 - 1e-12), F.coalesce(F.col("target") <= 0, F.lit(True)) | F.col("mass").isNull()
    lam = F.when(none, F.lit(float("-inf"))).when(full, high).otherwise(F.lit(0.0))
    columns = ["source", "source_size", "target", "mean", "lam", "lo", "hi", "done"]
    state = state.select("source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), lam.alias("lam"), (F.least(F.coalesce(low, F.lit(0.0)), F.lit(0.0)) - 1).alias("lo"), F.coalesce(high, F.lit(1.0)).alias("hi"), (none | full).alias("done"))
    state = materialize(state, "dual")
    for _ in range(rounds):
        now = state.where("not done")
        if now.isEmpty():
            return state.select("source", "source_size", "target", "mean", "lam")
        at = cells.join(broadcast_if_small(now), F.col("s").eqNullSafe(F.col("source")))
        x = F.col("size") / F.col("mean")
        raw = F.col("q") * F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        weight = F.col("size") * F.col("n")
        exact = lambda v: F.sum(v.cast("decimal(28,10)")).cast("double")  # noqa: E731, the same in every order of adding
        slopes = at.groupBy(*columns).agg(exact(weight * F.least(top, raw)).alias("mass"), exact(F.when(raw < top, weight * x * raw).otherwise(F.lit(0.0))).alias("curve"))
        gap = F.log(F.col("mass") / F.col("target"))
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap * F.col("mass") / F.nullif("curve", F.lit(0.0))
        step = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        near = (F.abs(gap) <= tolerance) | (hi - lo <= F.abs(F.col("lam")) * 1e-15)
        moved = slopes.select("source", "source_size", "target", "mean", F.when(near, F.col("lam")).otherwise(step).alias("lam"), lo.alias("lo"), hi.alias("hi"), near.alias("done"))
        state = materialize(state.where("done").unionByName(moved), "dual")
    raise RuntimeError(f"the dual has not converged in {rounds} rounds")


def _with(docs: DataFrame, small: DataFrame) -> DataFrame:
    """``docs`` with the columns of one row per source."""
    s = small.withColumnRenamed("source", "of")
    return docs.join(broadcast_if_small(s), F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _cut(docs: DataFrame, room: DataFrame) -> DataFrame:
    """source, cut, left: documents with a key below cut fit into room, of which left remains.

    Each round resolves one digit of the keys: sums of sizes by digit, accumulated
    over at most 2**DIGIT bins of a source, name the bin in which the room ends.
    """
    now = room.select("source", F.lit(0).cast("long").alias("cut"), F.col("room").alias("left"))
    for d in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - d)
        inside = _with(docs.where("fraction > 0"), now).where(F.shiftright("key", shift + DIGIT) == F.shiftright("cut", shift + DIGIT))
        bins = inside.groupBy("source", "cut", "left", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        marks = bins.withColumn("upto", upto)
        # the first bin that doesn't fit; where all fit, the place after the last
        full = marks.where("upto > left").groupBy("source").agg(F.min(F.struct("bin", (F.col("left") - F.col("upto") + F.col("n")).alias("rest"))).alias("f"))
        last = bins.groupBy("source").agg(F.max("bin").alias("last"), (F.first("left") - F.sum("n")).alias("rest"))
        found = last.alias("l").join(full.alias("f"), F.col("l.source").eqNullSafe(F.col("f.source")), "left").select("l.source", F.coalesce(F.col("f.f.bin"), F.col("l.last") + 1).alias("bin"), F.coalesce(F.col("f.f.rest"), F.col("l.rest")).alias("rest"))
        found = found.withColumnRenamed("source", "of")
        now = now.join(broadcast_if_small(materialize(found, "bins")), F.col("source").eqNullSafe(F.col("of")), "left").select("source", F.coalesce(F.shiftleft("bin", shift), "cut").alias("cut"), F.coalesce("rest", "left").alias("left"))
        now = materialize(now, "cut")
    return now


def _rated(base: DataFrame, tilts: DataFrame, cap: int, seed: int) -> DataFrame:
    """``base`` with its sources' target and each document's rate, whole copies, fraction and rounding key."""
    rate = F.least(F.lit(float(cap)), F.col("q") * F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0))))
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "body", "nth", F.lit(seed)), 11).cast("double") + 1) / F.lit(2.0**53)
    rated = _with(base, tilts).withColumn("rate", F.when((F.col("size") > 0) & (F.col("q") > 0), rate).otherwise(F.lit(0.0))).withColumn("whole", F.floor("rate"))
    rated = rated.withColumn("fraction", F.col("rate") - F.col("whole"))
    place = u / F.nullif("fraction", F.lit(0.0))
    return rated.withColumn("key", F.floor(place / (place + 1) * F.lit(2.0 ** (DIGIT * DIGITS))).cast("long"))


def copies(base: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3, seed: int = 7, fills: int = 6) -> DataFrame:
    """row, doc_id, size, source_size, target, rate and copies of every row of a ``base`` (see :func:`with_turns`)."""
    files = files_for(base.count())
    cells = materialize(base.groupBy("source", "q", "size").agg(F.count("*").alias("n")), "cells", files)
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    tilts = materialize(multipliers(cells, materialize(goals, "goals"), cap), "tilts")
    rated = materialize(_rated(base, tilts, cap, seed).drop("body", "nth", "q", "lam", "mean"), "rated", files)
    room = rated.groupBy("source", "target").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("room")).drop("target")
    cut = _cut(rated, materialize(room, "room"))
    more = (F.col("fraction") > 0) & (F.col("key") < F.col("cut"))
    out = _with(rated, cut.select("source", "cut")).withColumn("copies", (F.col("whole") + more.cast("int")).cast("long")).withColumn("step", F.lit(0))
    gaps, moved = cut.select("source", F.col("left").alias("gap")), None
    for _ in range(fills):
        free = _with(out.where("size > 0 and rate > 0"), gaps)
        if moved is not None:
            free = free.join(broadcast_if_small(moved.select(F.col("row").alias("r"))), F.col("row") == F.col("r"), "left_anti")
        steps = F.array(F.when(F.col("copies") < cap, F.lit(1)), F.when(F.col("copies") > 0, F.lit(-1)))
        free = free.select("source", "gap", "row", "doc_id", "key", "size", F.explode(steps).alias("step")).where("step is not null")
        off = F.abs(F.col("gap") - F.col("size") * F.col("step"))
        nearest = F.min(F.struct(off.alias("off"), "key", "doc_id", "step", "size", "row")).alias("x")
        best = materialize(free.where(off < F.abs("gap")).groupBy("source").agg(nearest).select("source", "x.row", "x.step", "x.size"), "fill")
        if best.isEmpty():
            break
        moved = materialize(best if moved is None else moved.unionByName(best), "moved")
        b = best.select(F.col("source").alias("of"), (F.col("size") * F.col("step")).alias("got"))
        gaps = materialize(gaps.join(broadcast_if_small(b), F.col("source").eqNullSafe(F.col("of")), "left").select("source", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap")), "gaps")
    if moved is not None:
        m = moved.select(F.col("row").alias("r"), F.col("step").alias("moved"))
        out = out.join(broadcast_if_small(m), F.col("row") == F.col("r"), "left").withColumn("copies", F.col("copies") + F.coalesce("moved", F.lit(0)))
    return out.select("row", "doc_id", "size", "source_size", "target", "rate", "copies")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3, prior: str | None = None, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate and copies of every row.

    ``taken`` is size times copies; no document is taken more than ``cap`` times.
    ``prior`` names a column of prior rates (null: 1, below 0: 0). Deterministic in
    the rows and ``seed``, however they are spread. Null texts and texts without
    words have size 0 and take nothing; a null source is a source of its own; a null
    doc_id is an id like any other. Repeated rows are rounded each on its own. An
    empty table gives an empty result; other columns are ignored.
    """
    files = files_for(docs.count())
    some = docs.select("doc_id", "text", "source", *([prior] if prior else [])).coalesce(files)
    some = some.withColumn(_ROW, F.monotonically_increasing_id()).withColumn(_PART, F.spark_partition_id())
    base = with_turns(materialize(sized(some, prior), "sized"), files)
    out = copies(base, weights, share, cap, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3, prior: str | None = None, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns; documents without words go.

    Null and repeated ids, null texts and sources and empty tables are as in :func:`mix_sources`.
    """
    row, part, times = (free_name(docs, n) for n in (_ROW, _PART, "__copies"))
    rows = numbered_rows(docs, row, part)
    files = files_for(rows.count())
    taken = copies(with_turns(materialize(sized(rows, prior, row, part), "sized", files), files), weights, share, cap, seed).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    out = rows.join(broadcast_if_small(materialize(taken, "taken", files)), row)
    return out.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)
