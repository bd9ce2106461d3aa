"""Meta-paths: instance counts, PathSim, HeteSim, projection and discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import pathsim
from ..session import broadcast_if_small, materialize
from ..sources.hin import Hin
from ..sources.spec import MetaPath


#: Pairs that a task forms, about.
FORMED = 20_000_000


def path_counts(hin: Hin, path: MetaPath, seeds: DataFrame | None = None) -> DataFrame:
    """(u, w, cnt): instances of the path from u to w; parallel edges count each.

    Counts are added up after every step, before the next join.
    """
    now = None if seeds is None and path.edges else (seeds if seeds is not None else hin.of_type(path.vertices[0])).select(F.col("id").alias("u"), F.col("id").alias("w"), F.lit(1).cast("long").alias("cnt"))
    for i, (kind, edge) in enumerate(zip(path.vertices[1:], path.edges, strict=True)):
        step = hin.edges.where(F.col("dst_type") == kind)
        if i or seeds is None:  # seeds may be of any type
            step = step.where(F.col("src_type") == path.vertices[i])
        if edge != -1:
            step = step.where(F.col("edge_type") == edge)
        step = step.groupBy("src", "dst").agg(F.count("*").alias("k"))
        if now is None:
            now = step.select(F.col("src").alias("u"), F.col("dst").alias("w"), F.col("k").alias("cnt"))
        else:
            now = now.join(step, now.w == step.src).groupBy("u", F.col("dst").alias("w")).agg(F.sum(F.col("cnt") * F.col("k")).alias("cnt"))
    return now


def _halves(hin: Hin, path: MetaPath, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(u, m, k, pu) and (w, m, l, pw): instances of both halves of the path to where they meet, and of the whole one from the vertex to itself; or (u, m) and (w, m)."""
    half = len(path.edges) // 2
    first, last = MetaPath(path.vertices[: half + 1], path.edges[:half]), MetaPath(path.vertices[half:], path.edges[half:])
    a = materialize(path_counts(hin, first).select("u", F.col("w").alias("m"), F.col("cnt").alias("k")), "half")
    b = materialize(path_counts(hin, last).select("w", F.col("u").alias("m"), F.col("cnt").alias("l")), "half")
    if not counted:
        return a.select("u", "m"), b.select("w", "m")
    own = a.join(b, (a.u == b.w) & (a.m == b.m)).groupBy("u").agg(F.sum(F.col("k") * F.col("l")).alias("pu"))
    own = broadcast_if_small(materialize(own, "own"))
    a = a.join(own, "u", "left").select("u", "m", "k", F.coalesce("pu", F.lit(0)).alias("pu"))
    b = b.join(own.select(F.col("u").alias("w"), F.col("pu").alias("pw")), "w", "left").select("w", "m", "l", F.coalesce("pw", F.lit(0)).alias("pw"))
    return a, b


def _single(halves: tuple[DataFrame, DataFrame]) -> bool:
    """No vertex comes to more than one place where the halves meet, so that a pair meets once."""
    return all(x.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").isEmpty() for x, c in zip(halves, "uw", strict=True))


def _beside(halves: list[tuple[DataFrame, DataFrame]], singles: list[int], at: int) -> tuple[DataFrame, DataFrame]:
    """The halves of path ``at``, and beside them what single paths have for the vertex: m, k and pu, or n, l and pw, and the path's number."""
    a, b = halves[at]
    for i in singles:
        x, y = halves[i]
        x, y = (h.select(c, *[F.col(f).alias(f"{g}{i}") for f, g in names if f in h.columns]) for h, c, names in ((x, "u", (("m", "m"), ("k", "k"), ("pu", "pu"))), (y, "w", (("m", "n"), ("l", "l"), ("pw", "pw")))))
        a, b = a.join(broadcast_if_small(x), "u", "left"), b.join(broadcast_if_small(y), "w", "left")
    return a, b.withColumnRenamed("m", "mid")


def _formed(a: DataFrame, b: DataFrame) -> int:
    """Pairs that meet; a number comes to the driver."""
    n = a.groupBy("m").agg(F.count("*").alias("x")).join(b.groupBy("m").agg(F.count("*").alias("y")), "m")
    return int(n.agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0))).first()[0])


def _dealt(a: DataFrame, rows: int) -> DataFrame:
    """``a`` in so many parts that each forms some FORMED of ``rows`` pairs."""
    return a.repartition(max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, -(-rows // FORMED))), "u")


def pathsim_pairs(hin: Hin, paths: list[MetaPath], seeds: DataFrame | None = None) -> DataFrame:
    """(u, w, s): PathSim averaged over the paths, for pairs with an instance on any; u = w gives 1.

    A pair without instances on one path adds 0 there, or 1 if neither vertex has
    an instance to itself on it.
    """
    every = [path_counts(hin, p, seeds) for p in paths]
    pairs = reduce(lambda a, b: a.union(b), [c.select("u", "w") for c in every]).distinct()
    for i, c in enumerate(every):
        own = c.where("u = w").select("u", F.col("cnt").alias("own"))
        pairs = pairs.join(c.withColumnRenamed("cnt", f"c{i}"), ["u", "w"], "left")
        pairs = pairs.join(own.withColumnRenamed("own", f"a{i}"), "u", "left").join(own.select(F.col("u").alias("w"), F.col("own").alias(f"b{i}")), "w", "left")
    s = [pathsim(*(F.coalesce(F.col(f"{k}{i}"), F.lit(0)) for k in "cab")) for i in range(len(every))]
    mean = reduce(lambda a, b: a + b, s) / len(s)
    return pairs.select("u", "w", F.when(F.col("u") == F.col("w"), F.lit(1.0)).otherwise(mean).alias("s"))


def pathsim_edges(hin: Hin, paths: list[tuple[MetaPath, float]]) -> DataFrame:
    """Directed (u, w): PathSim reaches its threshold on every path; a path on which neither has an instance to itself is skipped.

    A path on which no vertex has more than one place to meet at is tested where
    pairs of another one are formed.
    """
    halves = [_halves(hin, p) for p, _ in paths]
    singles = [i for i, h in enumerate(halves) if _single(h)]
    reached = lambda cnt, own, eps: (own == 0) | (2.0 * cnt / F.nullif(own, F.lit(0)) >= F.lit(float(eps)))
    out = None
    for at in [i for i in range(len(paths)) if i not in singles] or singles[:1]:
        beside = [i for i in singles if i != at] if out is None else []
        a, b = _beside(halves, beside, at)
        on = F.col("m") == F.col("mid")
        for i in beside:
            on = on & (F.col(f"m{i}") == F.col(f"n{i}")) & reached(F.col(f"k{i}") * F.col(f"l{i}"), F.col(f"pu{i}") + F.col(f"pw{i}"), paths[i][1])
        counts = a.join(b, on).groupBy("u", "w", "pu", "pw").agg(F.sum(F.col("k") * F.col("l")).alias("cnt"))
        x = counts.where(reached(F.col("cnt"), F.col("pu") + F.col("pw"), paths[at][1])).select("u", "w")
        out = x if out is None else out.join(x, ["u", "w"], "left_semi")
    return out


def induced_neighbours(hin: Hin, paths: list[MetaPath]) -> DataFrame:
    """(u, w): vertices that any of the paths reaches, u itself where a path returns.

    Pairs of a path on which no vertex has more than one place to meet at are formed
    once and not compared with each other; of later paths, pairs that such a one has already are not formed.
    """
    halves = [_halves(hin, p, False) for p in paths]
    singles = [i for i, h in enumerate(halves) if _single(h)]
    out, several = [], []
    for at in [*singles, *[i for i in range(len(paths)) if i not in singles]]:
        beside = [i for i in singles if i < at] if at in singles else singles
        a, b = _beside(halves, beside, at)
        on = reduce(lambda x, y: x & y, [~F.col(f"m{i}").eqNullSafe(F.col(f"n{i}")) | F.col(f"m{i}").isNull() for i in beside], F.col("m") == F.col("mid"))
        pairs = _dealt(a, _formed(*halves[at])) if at in singles else a
        (out if at in singles else several).append(pairs.join(b, on).select("u", "w"))
    if several:
        out.append(reduce(lambda x, y: x.unionByName(y), several).distinct())
    return reduce(lambda x, y: x.unionByName(y), out)


def hetesim(hin: Hin, path: MetaPath) -> DataFrame:
    """(a, b, s): HeteSim along a path, for pairs with s > 0.

    From the middle outwards: s(a, b) is 1 for a = b, else the sum of s over pairs
    of neighbours over the root of the numbers of neighbours (parallel ones each).
    Paths with an even number of vertices don't meet in the middle. Both halves
    expand along outgoing edges; where the first edge type is -1, none is asked for.
    """
    n = len(path.vertices)
    half, typed = n // 2, path.edges[0] != -1

    def step(own: int, kind: int, edge: int, a: str, x: str, size: str) -> DataFrame:
        e = hin.edges.where((F.col("src_type") == own) & (F.col("dst_type") == kind))
        if typed:
            e = e.where(F.col("edge_type") == edge)
        k = e.groupBy("src", "dst").agg(F.count("*").alias(f"k_{a}"))
        sizes = broadcast_if_small(materialize(e.groupBy("src").agg(F.count("*").alias(size)), "sizes"))
        return k.join(sizes, "src").select(F.col("src").alias(a), F.col("dst").alias(x), size, f"k_{a}")

    if n % 2 == 0:
        return hin.of_type(path.vertices[0]).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("s"))
    now, mirrored = None, True
    for i in range(half - 1, -1, -1):
        left = step(path.vertices[i], path.vertices[i + 1], path.edges[i], "a", "x", "na")
        right = step(path.vertices[n - 1 - i], path.vertices[n - i - 2], path.edges[n - 2 - i], "b", "y", "nb")
        # both sides are the same as far as here, so s(a, b) is s(b, a)
        mirrored = mirrored and path.vertices[i] == path.vertices[n - 1 - i] and (not typed or path.edges[i] == path.edges[n - 2 - i])
        if now is None:
            far = left.join(right, (F.col("x") == F.col("y")) & (F.col("a") < F.col("b") if mirrored else F.col("a") != F.col("b"))).withColumn("s", F.lit(1.0))
        else:
            far = left.join(now.select(F.col("a").alias("x"), F.col("b").alias("y"), "s"), "x").join(right, "y").where("a < b" if mirrored else "a <> b")
        far = far.groupBy("a", "b", "na", "nb").agg(F.sum(F.col("s") * F.col("k_a") * F.col("k_b")).alias("s"))
        far = far.select("a", "b", (F.col("s") / F.sqrt(F.col("na").cast("double") * F.col("nb").cast("double"))).alias("s"))
        if mirrored:
            ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
            far = far.select(ends.alias("e"), "s").select("e.a", "e.b", "s")
        own = hin.of_type(path.vertices[i]).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("s"))
        now = far.unionByName(own) if path.vertices[i] == path.vertices[n - 1 - i] else far
    return now


def hetesim_edges(hin: Hin, paths: list[tuple[MetaPath, float]]) -> DataFrame:
    """Directed (u, w): HeteSim reaches its threshold on every path."""
    found = [hetesim(hin, p).where(F.col("s") >= F.lit(float(e))).select(F.col("a").alias("u"), F.col("b").alias("w")) for p, e in paths]
    return reduce(lambda a, b: a.join(b, ["u", "w"], "left_semi"), found)


def project(hin: Hin, path: MetaPath) -> DataFrame:
    """(u, w), distinct: the homogeneous graph of a meta-path, without self."""
    return path_counts(hin, path).where("u <> w").select("u", "w")


def projected_degrees(hin: Hin, path: MetaPath) -> DataFrame:
    """(u, degree) in the projection, 0 for vertices without neighbours."""
    d = project(hin, path).groupBy("u").agg(F.count("*").alias("degree"))
    return hin.of_type(path.vertices[0]).select(F.col("id").alias("u")).join(d, "u", "left").select("u", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_distribution(degrees: DataFrame) -> DataFrame:
    """(degree, n): how many vertices have each degree, of :func:`projected_degrees`."""
    return degrees.groupBy("degree").agg(F.count("*").alias("n"))


def mean_pathsim(hin: Hin, paths: list[MetaPath], members: DataFrame) -> DataFrame:
    """(cid, avg_pathsim): mean PathSim over all pairs of members (v) of a community (cid), themselves included.

    A pair without an instance on any path adds 0.
    """
    m = materialize(members.select("cid", "v").distinct(), "m")
    size = m.groupBy("cid").agg(F.count("*").alias("n"))
    halves, parts, missing = [_halves(hin, p) for p in paths], [], []
    for a, b in halves:
        # members alike in what they have where the halves meet are one row, so pairs that meet at a hub aren't formed
        x = a.join(m, F.col("u") == F.col("v")).repartition("cid", "m").groupBy("cid", "m", "k", "pu").agg(F.count("*").alias("nu"))
        y = b.join(m, F.col("w") == F.col("v")).repartition("cid", "m").groupBy("cid", "m", "l", "pw").agg(F.count("*").alias("nw"))
        met = x.join(y, ["cid", "m"]).where("pu + pw > 0")
        parts.append(met.groupBy("cid").agg(F.sum(F.col("nu") * F.col("nw") * (2.0 * F.col("k") * F.col("l") / (F.col("pu") + F.col("pw")))).alias("s")))
        own = a.where("pu > 0").select(F.col("u").alias("v")).distinct()
        parts.append(m.join(own, "v").groupBy("cid").agg((-F.count("*").cast("double")).alias("s")))  # of a member and itself
        missing.append(materialize(m.join(own, "v", "left_anti"), "missing"))
    for bare in missing:
        if bare.isEmpty():
            continue
        # neither has an instance to itself on this path, which counts as 1 for pairs that another path has
        pairs = [a.join(bare.select("cid", F.col("v").alias("u")), "u").select("cid", "u", "m").join(b.join(bare.select("cid", F.col("v").alias("w")), "w").select("cid", "w", "m"), ["cid", "m"]).where("u <> w").select("cid", "u", "w") for a, b in halves]
        parts.append(reduce(lambda p, q: p.unionByName(q), pairs).distinct().groupBy("cid").agg(F.count("*").cast("double").alias("s")))
    inside = reduce(lambda p, q: p.unionByName(q), parts).groupBy("cid").agg((F.sum("s") / len(paths)).alias("s"))
    return size.join(inside, "cid", "left").select("cid", ((F.coalesce("s", F.lit(0.0)) + F.col("n")) / (F.col("n") * F.col("n"))).alias("avg_pathsim"))


def discover(hin: Hin, kind: int, top: int = 1001, sample: int | None = None, seed: int = 1) -> DataFrame:
    """(e1, t1, e2, t2, e3, t3, e4, cnt): the ``top`` most frequent paths kind - t1 - t2 - t1 - kind, t2 neither t1 nor kind.

    Counted exactly by meeting in the middle: half paths are summed by the vertex
    where they meet, so no instance is ever enumerated. With ``sample`` about that
    many start vertices are taken.
    """
    starts = hin.of_type(kind).select("id")
    if sample is not None:
        n = starts.count()
        starts = starts.sample(min(1.0, sample / max(n, 1)), seed)
    e = hin.edges
    first = e.where(F.col("src_type") == kind)  # every vertex of the kind starts, but for a sample
    first = first if sample is None else first.join(starts, e.src == starts.id)
    first = materialize(first.groupBy(F.col("dst").alias("m"), F.col("dst_type").alias("t1"), F.col("edge_type").alias("e1")).agg(F.count("*").alias("k")), "first")
    middle = [r[0] for r in first.select("t1").distinct().collect()]  # a row per type
    inner = e.where(F.col("src_type").isin(middle) & (F.col("dst_type") != F.col("src_type")) & (F.col("dst_type") != kind))
    there = first.join(inner.select("src", "dst", "dst_type", "edge_type"), F.col("m") == F.col("src"))
    there = there.groupBy(F.col("dst").alias("mid"), F.col("dst_type").alias("t2"), "e1", "t1", F.col("edge_type").alias("e2")).agg(F.sum("k").alias("k"))
    last = e.where(F.col("src_type").isin(middle) & (F.col("dst_type") == kind)).groupBy(F.col("src").alias("m"), F.col("edge_type").alias("e4")).agg(F.count("*").alias("k4"))
    outer = e.where(F.col("dst_type").isin(middle) & (F.col("src_type") != F.col("dst_type")) & (F.col("src_type") != kind))
    back = outer.select("src", "dst", "dst_type", "edge_type").join(last, F.col("dst") == F.col("m")).groupBy(F.col("src").alias("mid"), F.col("edge_type").alias("e3"), F.col("dst_type").alias("t3"), "e4").agg(F.sum("k4").alias("k4"))
    met = there.join(back, "mid").where("t1 = t3").groupBy("e1", "t1", "e2", "t2", "e3", "t3", "e4").agg(F.sum(F.col("k") * F.col("k4")).alias("cnt"))
    return met.orderBy(F.desc("cnt"), "e1", "t1", "e2", "t2", "e3", "t3", "e4").limit(top)
