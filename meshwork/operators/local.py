"""Community search from the query vertices outwards: what it reads grows with the answers, not with the network.

Round by round, for all query vertices at once, the vertices of the frontier are
evaluated: their neighbourhoods, the candidates that share a neighbour with them, the
candidates' neighbourhoods and the similarities are computed for these alone. The next
frontier is what new cores are similar to. A vertex is evaluated once and its
neighbourhood computed once; a pair is compared once, from the end that is evaluated
first, and serves both.

Hops follow only those pairs of types that can still lead to a compared type, so the
stored network is read by the partitions of these. Tables of a round that have few rows
are local relations, which are broadcast, so that the edges stay where they are;
larger ones are written and shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import MEASURES
from ..session import settle
from ..sources.hin import Hin
from .similarity import BOUNDS

Links = set[tuple[int, int]]


def type_links(hin: Hin) -> Links:
    """Pairs of types that edges join, in their stored direction."""
    return {(r.src_type, r.dst_type) for r in hin.schema().select("src_type", "dst_type").collect()}


def _within(links: Links, types: set[int], hops: int, forward: bool) -> list[set[int]]:
    """For 0 ... hops: types that lead to ``types`` in so many hops at most, or that these lead to (``forward``)."""
    out = [set(types)]
    for _ in range(hops):
        near = {b for a, b in links if a in out[-1]} if forward else {a for a, b in links if b in out[-1]}
        out.append(out[-1] | near)
    return out


def _edges(hin: Hin, pairs: Links) -> DataFrame:
    tests = [(F.col("src_type") == a) & (F.col("dst_type") == b) for a, b in sorted(pairs)]
    return hin.edges.where(reduce(lambda x, y: x | y, tests, F.lit(False)))


def neighbourhoods(hin: Hin, links: Links, seeds: DataFrame, kind: int, hops: int, types: list[int]) -> DataFrame:
    """nbr (u, type, v), of ``types`` within the hops of each seed (u), which is of type ``kind``."""
    useful = _within(links, set(types), hops, False)
    now, at, found = seeds.select("u", F.col("u").alias("v")), {kind}, []
    for h in range(hops):
        pairs = {(a, b) for a, b in links if a in at and b in useful[hops - h - 1]}
        step = _edges(hin, pairs).select(F.col("src").alias("v"), F.col("dst").alias("next"), F.col("dst_type").alias("type"))
        if not pairs:
            break
        now = settle(step.join(now, "v").select("u", "type", F.col("next").alias("v")).distinct(), "hop")[0]
        found.append(now.where(F.col("type").isin(*types)))
        now, at = now.select("u", "v"), {b for _, b in pairs}
    return reduce(lambda a, b: a.unionByName(b), found).distinct() if found else now.select("u", F.lit(0).alias("type"), "v").limit(0)


def reached_by(hin: Hin, links: Links, targets: DataFrame, of: int, kind: int, hops: int) -> DataFrame:
    """(v, w): vertices w of type ``kind`` that have a target (v, of type ``of``) within the hops."""
    useful = _within(links, {kind}, hops, True)
    now, at, found = targets.select("v", F.col("v").alias("x")), {of}, []
    for h in range(hops):
        pairs = {(a, b) for a, b in links if b in at and a in useful[hops - h - 1]}
        step = _edges(hin, pairs).select(F.col("dst").alias("x"), F.col("src").alias("before"), F.col("src_type").alias("type"))
        if not pairs:
            break
        now = settle(step.join(now, "x").select("v", "type", F.col("before").alias("x")).distinct(), "hop")[0]
        found.append(now.where(F.col("type") == kind).select("v", F.col("x").alias("w")))
        now, at = now.select("v", "x"), {a for a, _ in pairs}
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


def verified(pairs: DataFrame, nbr: DataFrame, eps: dict[int, float], measure: str) -> DataFrame:
    """The pairs (u, w) that reach the threshold in every type, by their neighbourhoods; sizes decide first."""
    n, _ = settle(nbr.groupBy("u").agg(*[F.count_if(F.col("type") == t).alias(f"n{t}") for t in eps]), "sizes")
    other = n.select(F.col("u").alias("w"), *[F.col(f"n{t}").alias(f"m{t}") for t in eps])
    sized = pairs.join(n, "u").join(other, "w")

    def possible(t: int):
        a, b, ratio = F.col(f"n{t}"), F.col(f"m{t}"), BOUNDS[measure](float(eps[t]))[1]
        return ((a == 0) == (b == 0)) & (F.least(a, b) >= F.greatest(a, b) * F.lit(ratio - 1e-9))

    sized, _ = settle(sized.where(reduce(lambda x, y: x & y, [possible(t) for t in eps])), "sized")
    common = sized.select("u", "w").join(nbr, "u").join(nbr.withColumnRenamed("u", "w"), ["w", "type", "v"]).groupBy("u", "w").agg(*[F.count_if(F.col("type") == t).alias(f"c{t}") for t in eps])
    tests = [MEASURES[measure](F.coalesce(f"c{t}", F.lit(0)), F.col(f"n{t}"), F.col(f"m{t}")) >= F.lit(float(e)) for t, e in eps.items()]
    return sized.join(common, ["u", "w"], "left").where(reduce(lambda x, y: x & y, tests)).select("u", "w")


@dataclass(frozen=True)
class Found:
    """Directed similar pairs (u, w) of all evaluated vertices, themselves included, and how much was done for them."""

    edges: DataFrame
    rounds: int
    evaluated: int
    neighbourhoods: int
    compared: int


def local_edges(hin: Hin, queries: DataFrame, kind: int, hops: int, eps: dict[int, float], distance: dict[int, int], mu: int, measure: str = "jaccard") -> Found:
    """Similar pairs of the query vertices (id, of type ``kind``) and of all that lies in the communities of those that are cores.

    Candidates come from the compared type at the least schema distance in which a
    vertex has neighbours; a pair must have a share of these in common before the
    candidate's own neighbourhood is read.
    """
    if not eps or any(e <= 0 for e in eps.values()) or measure not in MEASURES:
        raise ValueError("thresholds above 0 and a known measure are needed")
    spark, links = hin.vertices.sparkSession, type_links(hin)
    order = sorted(eps, key=lambda t: (distance.get(t, 1 << 30), -t))
    # what each round adds, written once and never again
    parts = {k: [spark.createDataFrame([], schema)] for k, schema in (("nbr", "u long, type int, v long"), ("have", "u long"), ("evaluated", "u long"), ("edges", "u long, w long"))}
    every = lambda k: reduce(lambda a, b: a.unionByName(b), parts[k])
    frontier, n = settle(queries.select(F.col("id").alias("u")).distinct(), "frontier")
    rounds = compared = n_evaluated = n_known = 0

    def known(vertices: DataFrame) -> None:
        nonlocal n_known
        new, more = settle(vertices.select("u").distinct().join(every("have"), "u", "left_anti"), "new")
        if more:
            parts["nbr"].append(settle(neighbourhoods(hin, links, new, kind, hops, list(eps)), "nbr")[0])
            parts["have"].append(new)
            n_known += more

    while n:
        rounds += 1
        n_evaluated += n
        if rounds == 1:  # later ones were candidates before
            known(frontier)
        own, _ = settle(every("nbr").join(frontier, "u", "left_semi"), "own")
        first = own.groupBy("u").agg(*[F.count_if(F.col("type") == t).alias(f"n{t}") for t in order])
        first = first.select("u", F.coalesce(*[F.when(F.col(f"n{t}") > 0, F.lit(t)) for t in order]).alias("type"), F.coalesce(*[F.when(F.col(f"n{t}") > 0, F.col(f"n{t}")) for t in order]).alias("n"))
        first, _ = settle(first, "first")
        met = []
        for t in sorted(r.type for r in first.select("type").distinct().collect()):
            rows = own.join(first, ["u", "type"]).where(F.col("type") == t).select("u", "v", "n")
            back = reached_by(hin, links, settle(rows.select("v").distinct(), "targets")[0], t, kind, hops).join(every("evaluated").withColumnRenamed("u", "w"), "w", "left_anti")
            share = BOUNDS[measure](float(eps[t]))[0]
            shared = rows.join(back, "v").where("u <> w").groupBy("u", "w", "n").agg(F.count("*").alias("c"))
            met.append(shared.where(F.col("c") >= F.col("n") * F.lit(share - 1e-9)).select("u", "w"))
        parts["evaluated"].append(frontier)
        if not met:
            break
        pairs = reduce(lambda a, b: a.unionByName(b), met)
        inside = frontier.select(F.col("u").alias("w"), F.lit(True).alias("also"))
        pairs, more = settle(pairs.join(inside, "w", "left").where("also is null or u < w").select("u", "w"), "pairs")
        compared += more
        known(pairs.select(F.col("w").alias("u")))
        ends = pairs.select("u").unionByName(pairs.select(F.col("w").alias("u"))).distinct()
        hit, _ = settle(verified(pairs, settle(every("nbr").join(ends, "u", "left_semi"), "ends")[0], eps, measure), "hit")
        back = hit.select(F.col("w").alias("u"), F.col("u").alias("w")).join(frontier, "u", "left_semi")
        before = every("edges").select(F.col("w").alias("u"), F.col("u").alias("w")).join(frontier, "u", "left_semi")
        loops = first.select("u", F.col("u").alias("w"))
        new, _ = settle(reduce(lambda a, b: a.unionByName(b), [hit, back, before, loops]), "edges")
        parts["edges"].append(new)
        cores = new.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= mu).select("u")
        frontier, n = settle(new.join(cores, "u", "left_semi").select(F.col("w").alias("u")).distinct().join(every("evaluated"), "u", "left_anti"), "frontier")
    return Found(every("edges"), rounds, n_evaluated, n_known, compared)
