"""Cores by bounds: pairs are verified only while they can still settle a vertex.

Every vertex has a least and a greatest number of similar vertices. The least begins
with the vertices of the very same neighbourhoods, which are similar without a look at
them, itself included. The greatest begins with the entries that its set shares in the
prefix join, counted and not formed; of what is left, pairs with an unsettled end are
formed, and thinned by sizes and by how many members they can have in common at most,
which the sets' signatures tell before a pair is formed, and the shared entries and what comes after them then. Rounds then verify for each unsettled vertex its
most promising pairs, four times as many each time; a verified pair moves the bounds of
both ends, and a pair whose ends are both settled is never verified.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import MEASURES
from ..session import materialize, settle
from .local import verified
from .similarity import BOUNDS, LISTED, WORDS, _entered, most_common, type_costs


@dataclass(frozen=True)
class Cores:
    """Cores (u), and the numbers of pairs that were formed and verified, each counted once."""

    cores: DataFrame
    formed: int
    verified: int


def _twins(nbr: DataFrame) -> DataFrame:
    """(u, sig, lb): the least vertex of those with the neighbourhoods of u, by a digest of 192 bits, and how many these are."""
    each = nbr.groupBy("u").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("type", "v")).alias("h1"), F.bit_xor(F.xxhash64("v", "type", F.lit(1))).alias("h2"), F.sum(F.xxhash64(F.lit(2), "v", "type").cast("decimal(38,0)")).alias("h3"))
    signed = each.select("u", F.struct("n", "h1", "h2", "h3").alias("sig"))
    return signed.join(signed.groupBy("sig").agg(F.count("*").alias("lb"), F.min("u").alias("least")), "sig").select("u", F.col("least").alias("sig"), "lb")


def _ends(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """(u, a, b, promise) for each end of the pairs that is in ``state``."""
    return pairs.select("a", "b", "promise", F.explode(F.array("a", "b")).alias("u")).join(state.select("u"), "u", "left_semi")


def _settled(pairs: DataFrame, state: DataFrame, nbr: DataFrame, eps: dict[int, float], measure: str, mu: int) -> tuple[DataFrame, int]:
    """(cores, verified) of the unsettled vertices ``state`` (u, lb), by rounds over their ``pairs`` (a, b, promise)."""
    found, done, k = [], 0, mu
    left = _ends(pairs, state).groupBy("u").agg(F.count("*").alias("left"))
    while True:
        now = state.join(left, "u", "left").select("u", "lb", (F.col("lb") + F.coalesce("left", F.lit(0))).alias("ub"))
        now, n = settle(now, "bounds")
        found.append(now.where(F.col("lb") >= mu).select("u"))
        open_, n = settle(now.where((F.col("lb") < mu) & (F.col("ub") >= mu)).select("u", "lb"), "open", n)
        if not n:
            return reduce(lambda x, y: x.unionByName(y), found), done
        ends = _ends(pairs, open_)
        place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("promise"), "a", "b"))
        chosen, more = settle(ends.withColumn("place", place).where(F.col("place") <= k).select("a", "b").distinct(), "chosen", k * n)
        done += more
        touched = chosen.select(F.explode(F.array("a", "b")).alias("u")).distinct()
        good = verified(chosen.select(F.col("a").alias("u"), F.col("b").alias("w")), settle(nbr.join(touched, "u", "left_semi"), "touched", 10 * more)[0], eps, measure)
        gained = good.select(F.explode(F.array("u", "w")).alias("u")).groupBy("u").agg(F.count("*").alias("more"))
        state, _ = settle(open_.join(gained, "u", "left").select("u", (F.col("lb") + F.coalesce("more", F.lit(0))).alias("lb")), "state", n)
        # pairs with an end that is open, but for those just verified
        pairs, _ = settle(ends.select("a", "b", "promise").distinct().join(chosen, ["a", "b"], "left_anti"), "pairs", k * n)
        left = _ends(pairs, state).groupBy("u").agg(F.count("*").alias("left"))
        k *= 4


def bounded_cores(nbr: DataFrame, eps: dict[int, float], mu: int, measure: str = "jaccard") -> Cores:
    """The cores of ``similarity.similar_edges``: vertices with mu similar ones at least, themselves counted."""
    eps = {t: e for t, e in eps.items() if e > 0}
    if not eps or measure not in MEASURES:
        raise ValueError("thresholds above 0 and a known measure are needed")
    own = materialize(nbr.where(F.col("type").isin(*eps)), "own")
    costs = type_costs(own)
    fused = [t for t in eps if t not in costs or costs[t][0] <= 1]
    rest = sorted((t for t in eps if t not in fused), key=lambda t: costs[t][1])
    if any(costs[t][0] > LISTED for t in rest):
        raise ValueError(f"vertices of more than {LISTED} neighbours in a type need similar_edges")
    keys = [f"f{t}" for t in fused]
    twins = materialize(_twins(own), "twins")
    found, formed, done = [twins.where(F.col("lb") >= mu).select("u")], 0, 0
    few = twins.where(F.col("lb") < mu)
    left = materialize(own.groupBy("u").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("type") == t, F.col("v"))).alias(f"f{t}") for t in fused]).drop("n"), "left")
    for t in rest:
        rows = left.join(own.where(F.col("type") == t).select("u", "v"), "u")
        share, ratio = BOUNDS[measure](float(eps[t]))
        entries = _entered(rows, keys, share)[0]
        here = entries.groupBy("v").agg(F.count("*").alias("here"))
        most = entries.select("u", "v").join(here, "v").groupBy("u").agg((F.sum(F.col("here") - 1) + 1).alias("ub"))
        state, n_open = settle(few.join(most, "u").where(F.col("ub") + F.col("lb") - 1 >= mu).select("u", "lb", "sig"), "state")
        ends = entries.groupBy("u").agg(F.count("*").alias("p"), F.max("v").alias("last"))
        ours = entries.join(state.select("u", "sig"), "u").join(ends, "u")
        others = entries.join(twins.select("u", F.col("sig").alias("s2")), "u").join(ends, "u")
        others = others.select(*[F.col(c).alias(f"r_{c}") for c in others.columns])
        enough = lambda c: MEASURES[measure](c, F.col("n"), F.col("r_n")) >= F.lit(float(eps[t]))  # noqa: B023, E731
        apart = [F.col("v") == F.col("r_v"), F.col("u") != F.col("r_u"), F.col("sig") != F.col("r_s2"), F.least("n", "r_n") >= F.greatest("n", "r_n") * F.lit(ratio - 1e-9), enough(most_common(WORDS))]
        met = ours.join(others, reduce(lambda x, y: x & y, apart)).groupBy("u", "r_u", "n", "r_n", "p", "r_p", "last", "r_last").agg(F.count("*").alias("shared"))
        # a common member that isn't shared by the entries comes after those of the set whose entries end first
        after = F.when(F.col("last") < F.col("r_last"), F.col("n") - F.col("p")).otherwise(F.col("r_n") - F.col("r_p"))
        most = F.least(F.col("shared") + after, "n", "r_n")
        pairs = met.where(enough(most))
        pairs = pairs.select(F.least("u", "r_u").alias("a"), F.greatest("u", "r_u").alias("b"), (F.col("shared") / (F.col("n") + F.col("r_n"))).alias("promise"))
        pairs, more = settle(pairs.groupBy("a", "b").agg(F.max("promise").alias("promise")), "pairs", n_open * mu)
        formed += more
        cores, n = _settled(pairs, state.select("u", "lb"), own, eps, measure, mu)
        found.append(cores)
        done += n
        left = materialize(left.join(own.where(F.col("type") == t).select("u"), "u", "left_anti"), "left")
    # vertices with nothing but keys are similar to their twins alone
    return Cores(reduce(lambda x, y: x.unionByName(y), found).distinct(), formed, done)
