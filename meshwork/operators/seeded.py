"""Path similarity of given vertices: candidates from each one's cheapest path, the other paths met in the middle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, settle
from ..sources.hin import Hin
from ..sources.spec import MetaPath
from .metapath import path_counts

Paths = list[tuple[MetaPath, float]]


def _part(path: MetaPath, low: int, high: int) -> MetaPath:
    return MetaPath(path.vertices[low : high + 1], path.edges[low:high])


def _steps(hin: Hin, path: MetaPath, i: int) -> DataFrame:
    """(src, dst): edges of the path's place ``i``, parallel ones kept."""
    e = hin.edges.where((F.col("src_type") == path.vertices[i]) & (F.col("dst_type") == path.vertices[i + 1]))
    return (e if path.edges[i] == -1 else e.where(F.col("edge_type") == path.edges[i])).select("src", "dst")


def _start(vertices: DataFrame) -> DataFrame:
    return vertices.select("id").distinct()


def towards(hin: Hin, path: MetaPath, vertices: DataFrame) -> DataFrame:
    """(u, m, cnt): instances of the path's first half from each vertex (id) to where its halves meet."""
    half = len(path.edges) // 2
    if not half:
        return _start(vertices).select(F.col("id").alias("u"), F.col("id").alias("m"), F.lit(1).cast("long").alias("cnt"))
    return path_counts(hin, _part(path, 0, half), _start(vertices)).withColumnRenamed("w", "m")


def backwards(hin: Hin, path: MetaPath, vertices: DataFrame) -> DataFrame:
    """(w, m, cnt): instances of the second half from the middle to each vertex (id), found from that vertex."""
    now = _start(vertices).select(F.col("id").alias("w"), F.col("id").alias("m"), F.lit(1).cast("long").alias("cnt"))
    for i in range(len(path.edges) - 1, len(path.edges) // 2 - 1, -1):
        step = _steps(hin, path, i).groupBy("src", "dst").agg(F.count("*").alias("k"))
        now = now.join(step, now.m == step.dst).groupBy("w", F.col("src").alias("m")).agg(F.sum(F.col("cnt") * F.col("k")).alias("cnt"))
    return now


def path_costs(hin: Hin, path: MetaPath, seeds: DataFrame) -> DataFrame:
    """(u, cost): instances of the path from each seed (id), 0 where there is none; no pair of ends is formed.

    The second half is counted from its end, a row for each vertex on it.
    """
    rest = None
    for i in range(len(path.edges) - 1, len(path.edges) // 2 - 1, -1):
        e = _steps(hin, path, i)
        e = e.withColumn("n", F.lit(1).cast("double")) if rest is None else e.join(rest, e.dst == rest.m).select("src", "n")
        rest = e.groupBy(F.col("src").alias("m")).agg(F.sum("n").alias("n"))
    found = towards(hin, path, seeds).join(rest, "m").groupBy("u").agg(F.sum(F.col("cnt") * F.col("n")).alias("cost"))
    return _start(seeds).select(F.col("id").alias("u")).join(found, "u", "left").select("u", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def cheapest_path(hin: Hin, paths: list[MetaPath], seeds: DataFrame) -> DataFrame:
    """(u, at): for each seed the place of the path with fewest instances from it; of several the first."""
    every = [path_costs(hin, p, seeds).select("u", F.struct("cost", F.lit(i).alias("at")).alias("c")) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b), every).groupBy("u").agg(F.min("c").getField("at").alias("at"))


def own_counts(hin: Hin, path: MetaPath, vertices: DataFrame) -> DataFrame:
    """(u, own): instances from each vertex (id) back to itself, from its two halves where they meet; none: no row."""
    there, back = towards(hin, path, vertices), backwards(hin, path, vertices)
    return there.join(back.select(F.col("w").alias("u"), "m", F.col("cnt").alias("k")), ["u", "m"]).groupBy("u").agg(F.sum(F.col("cnt") * F.col("k")).alias("own"))


def pair_counts(hin: Hin, path: MetaPath, pairs: DataFrame) -> DataFrame:
    """(u, w, cnt) of the pairs with an instance: from the u forwards, from the w backwards, met in the middle."""
    there = towards(hin, path, pairs.select(F.col("u").alias("id")))
    back = backwards(hin, path, pairs.select(F.col("w").alias("id"))).withColumnRenamed("cnt", "k")
    met = there.join(back, "m").groupBy("u", "w").agg(F.sum(F.col("cnt") * F.col("k")).alias("cnt"))
    return met.join(pairs.select("u", "w").distinct(), ["u", "w"], "left_semi")


def _pathsim(hin: Hin, path: MetaPath, counts: DataFrame) -> DataFrame:
    """(u, w, s) of counted pairs (u, w, cnt); a pair of which neither end has an instance to itself has s null."""
    ends = counts.select(F.col("u").alias("id")).unionByName(counts.select(F.col("w").alias("id"))).distinct()
    own = materialize(own_counts(hin, path, ends), "own")
    x = counts.join(own.withColumnRenamed("own", "pa"), "u", "left").join(own.select(F.col("u").alias("w"), F.col("own").alias("pb")), "w", "left")
    both = F.coalesce("pa", F.lit(0)) + F.coalesce("pb", F.lit(0))
    return x.select("u", "w", (2.0 * F.col("cnt") / F.nullif(both, F.lit(0))).alias("s"))


def _reaching(s: DataFrame, eps: float) -> DataFrame:
    return s.where(F.col("s").isNull() | (F.col("s") >= F.lit(float(eps)))).select("u", "w")


def seeded_pathsim(hin: Hin, paths: Paths, seeds: DataFrame) -> DataFrame:
    """Directed (u, w) of the seeds u (id): those of :func:`metapath.pathsim_edges`, which begins from every vertex.

    A seed's candidates are what its cheapest path reaches. Those that reach that path's
    threshold are tested on the others, which are counted for these pairs alone.
    """
    chosen, _ = settle(cheapest_path(hin, [p for p, _ in paths], seeds), "chosen")
    out = []
    for i, (path, eps) in enumerate(paths):
        own = chosen.where(F.col("at") == i).select(F.col("u").alias("id"))
        if own.isEmpty():
            continue
        counts, _ = settle(path_counts(hin, path, own), "counts")
        now, n = settle(_reaching(_pathsim(hin, path, counts), eps), "candidates")
        for j, (other, least) in enumerate(paths):
            if j != i and n:
                counts, _ = settle(pair_counts(hin, other, now), "counts")
                now, n = settle(_reaching(_pathsim(hin, other, counts), least), "candidates")
        out.append(now)
    return reduce(lambda a, b: a.unionByName(b), out) if out else hin.vertices.sparkSession.createDataFrame([], "u long, w long")


def seeded_hetesim(hin: Hin, path: MetaPath, lefts: DataFrame, rights: DataFrame | None = None) -> DataFrame:
    """(a, b, s) of :func:`metapath.hetesim` for the a of ``lefts`` (id), and the b of ``rights`` where given.

    The vertices that the first half reaches from the lefts, hop by hop, and those of
    the second half from the rights, are found first; from the middle outwards only
    pairs of these are formed.
    """
    n, half = len(path.vertices), len(path.vertices) // 2
    typed = path.edges[0] != -1

    def arcs(kind: int, edge: int) -> DataFrame:
        e = hin.edges.where(F.col("dst_type") == kind)
        return (e.where(F.col("edge_type") == edge) if typed else e).select("src", "dst")

    def rings(ids: DataFrame, places: list[tuple[int, int]]) -> list[DataFrame]:
        out = [settle(_start(ids), "ring")[0]]
        for place in places:
            step = arcs(*place)
            out.append(settle(step.join(out[-1], step.src == out[-1].id, "left_semi").select(F.col("dst").alias("id")).distinct(), "ring")[0])
        return out

    def same(ids: DataFrame, others: DataFrame | None) -> DataFrame:
        both = ids if others is None else ids.join(others, "id", "left_semi")
        return both.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("s"))

    lefts = _start(lefts).join(hin.of_type(path.vertices[0]), "id", "left_semi")
    if n % 2 == 0:  # doesn't meet in the middle: a vertex is like itself alone
        return same(lefts, None if rights is None else _start(rights))
    rights = None if rights is None else _start(rights).join(hin.of_type(path.vertices[-1]), "id", "left_semi")
    outwards = [(path.vertices[i + 1], path.edges[i]) for i in range(half)]
    inwards = [(path.vertices[n - i - 2], path.edges[n - 2 - i]) for i in range(half)]
    left = rings(lefts, outwards)
    right = [None] * (half + 1) if rights is None else rings(rights, inwards)
    now = same(left[half], right[half])
    for i in range(half - 1, -1, -1):
        sides = []
        for ring, place, end, to in ((left[i], outwards[i], "a", "x"), (right[i], inwards[i], "b", "y")):
            e = arcs(*place)
            e = e if ring is None else e.join(ring, e.src == ring.id, "left_semi")
            sizes = e.groupBy("src").agg(F.count("*").alias(f"n{end}"))
            counted = e.groupBy("src", "dst").agg(F.count("*").alias(f"k{end}")).join(sizes, "src")
            sides.append(counted.select(F.col("src").alias(end), F.col("dst").alias(to), f"n{end}", f"k{end}"))
        met = sides[0].join(now.select(F.col("a").alias("x"), F.col("b").alias("y"), "s"), "x").join(sides[1], "y").where("a <> b")
        far = met.groupBy("a", "b").agg((F.sum(F.col("s") * F.col("ka") * F.col("kb")) / F.sqrt(F.first("na").cast("double") * F.first("nb").cast("double"))).alias("s"))
        for end, kind in (("a", path.vertices[i]), ("b", path.vertices[n - 1 - i])):
            far = far.join(hin.of_type(kind).select(F.col("id").alias(end)), end, "left_semi")
        far = far.select("a", "b", "s")
        now, _ = settle(far.unionByName(same(left[i], right[i])) if path.vertices[i] == path.vertices[n - 1 - i] else far, "met")
    return now


def seeded_hetesim_edges(hin: Hin, paths: Paths, seeds: DataFrame) -> DataFrame:
    """Directed (u, w) of the seeds u (id): those of :func:`metapath.hetesim_edges`; the path of least cost over all seeds goes first."""
    costs = [path_costs(hin, p, seeds).agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0] for p, _ in paths]
    now = None
    for i in sorted(range(len(paths)), key=lambda i: (costs[i], i)):
        path, eps = paths[i]
        lefts = seeds if now is None else now.select(F.col("u").alias("id"))
        rights = None if now is None else now.select(F.col("w").alias("id"))
        hit = seeded_hetesim(hin, path, lefts, rights).where(F.col("s") >= F.lit(float(eps))).select(F.col("a").alias("u"), F.col("b").alias("w"))
        now, _ = settle(hit if now is None else hit.join(now, ["u", "w"], "left_semi"), "candidates")
    return now


SEEDED = {"pathsim": seeded_pathsim, "hetesim": seeded_hetesim_edges}


def walked_edges(hin: Hin, paths: Paths, queries: DataFrame, mu: int, measure: str) -> DataFrame:
    """Directed similar pairs (u, w) of the query vertices (id) and of all in the communities of those that are cores."""
    frontier, n = settle(_start(queries), "frontier")
    edges, done = [], frontier.limit(0)
    while n:
        new, _ = settle(SEEDED[measure](hin, paths, frontier), "edges")
        edges.append(new)
        done, _ = settle(done.unionByName(frontier), "done")
        cores = new.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= mu).select("u")
        frontier, n = settle(new.join(cores, "u", "left_semi").select(F.col("w").alias("id")).distinct().join(done, "id", "left_anti"), "frontier")
    return reduce(lambda a, b: a.unionByName(b), edges) if edges else hin.vertices.sparkSession.createDataFrame([], "u long, w long")
