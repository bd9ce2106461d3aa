"""Structural similarity over typed neighbourhoods nbr (u, type, v).

Pairs come from self-joins on shared neighbours, most selective type first; other
types are verified on the survivors. A threshold reaches into the join: a set is
entered under its rarest neighbours only, as many as it must have one of in common
with any set alike enough (prefix filter), sets whose sizes exclude the threshold
don't meet, and a pair is tested where it meets, by signatures that tell how many members
it can have in common at most; only what passes is deduplicated and verified on the sets.
Vertices with more than LISTED neighbours of the type are joined row by row instead. A type in which every vertex has one
neighbour at most is no join of its own: similarity there is 0 or 1, so its
neighbour becomes a further equality key of the candidate join. Pairs of two empty
sets are never listed on their own: they are alike in that type, but a vertex
without any neighbour is no vertex of the similarity graph, so each pair shares
one in another type.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import MEASURES, mean_similarity
from ..session import BROADCAST_ROWS, broadcast_if_small, materialize
from ..sources.hin import dense_index

Test = Callable[[int, Column, Column, Column], Column]

#: Neighbours of a vertex that are entered as a set; longs of 64 bits of a set's signature.
LISTED, WORDS = 1_000, 4

#: Rows of a candidate join that a task forms of the lists it is sent, about.
FORMED = 2_000_000

#: Vertices of a list in :func:`spread`; all pairs of two lists are held at once.
SPREAD = 100

#: Least common members over own size, and least smaller over larger size, of sets whose similarity is t.
BOUNDS: dict[str, Callable[[float], tuple[float, float]]] = {"jaccard": lambda t: (t, t), "cosine": lambda t: (t * t, t * t), "overlap": lambda t: (0.0, 0.0)}

#: Common members over the sum of both sizes from which on a similarity is surely t.
SURE: dict[str, Callable[[float], float]] = {"jaccard": lambda t: t / (1 + t), "cosine": lambda t: t / 2, "overlap": lambda t: t / 2}


def type_costs(nbr: DataFrame) -> dict[int, tuple[int, int]]:
    """type: (most neighbours of a vertex, rows of its candidate join); a row per type comes to the driver."""
    own = nbr.groupBy("type", "u").agg(F.count("*").alias("n")).groupBy("type").agg(F.max("n").alias("most"))
    met = nbr.groupBy("type", "v").agg(F.count("*").alias("n")).groupBy("type").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
    return {r.type: (r.most, r.cost) for r in own.join(met, "type").collect()}


def _sizes(nbr: DataFrame, kind: int, name: str) -> DataFrame:
    return nbr.where(F.col("type") == kind).groupBy("u").agg(F.count("*").alias(name))


def _entered(rows: DataFrame, keys: list[str], share: float) -> tuple[DataFrame, DataFrame]:
    """(entries, sets) of rows (u, v, keys), for joins of sets that agree in ``keys``.

    Sets (u, vs, n) hold the ranks of the members, rarest first; a rank stands for a
    neighbour together with the keys. Entries (u, n, v, m0, m1 ...) are a row for each rank v
    that a set is entered under, with a signature of the set: a bit for each member, by
    its hash, in WORDS longs. They stay as wide however many neighbours there are.
    """
    ranks = dense_index(rows.groupBy(*keys, "v").agg(F.count("*").alias("_c")), ["_c", "v", *keys], "rank").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("v").alias("_v"), "rank")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("v") == F.col("_v"))
    # rows come of lists, so Spark takes them for far fewer than they are, and would broadcast them
    rows = rows.hint("merge").join(broadcast_if_small(ranks), same)
    sets = materialize(rows.groupBy("u").agg(F.array_sort(F.collect_list("rank")).alias("vs")).withColumn("n", F.size("vs")), "sets")
    at = "cast(pmod(xxhash64(x), {}) as int)".format(64 * WORDS)
    bits = [F.expr(f"aggregate(vs, 0L, (s, x) -> s | if({at} div 64 = {i}, shiftleft(1L, {at} % 64), 0L))").alias(f"m{i}") for i in range(WORDS)]
    need = F.greatest(F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)), F.lit(1)).cast("int")
    signed = sets.select("u", "n", F.slice("vs", 1, F.col("n") - need + 1).alias("under"), *bits)
    return signed.select("u", "n", F.explode("under").alias("v"), *[f"m{i}" for i in range(WORDS)]), sets


def most_common(words: int, left: str = "") -> Column:
    """How many common members a set, whose columns begin with ``left``, and another one, whose begin with r_, have at most by their signatures.

    A bit that only one of them has stands for a member at least that the other lacks.
    """
    least = F.least(F.col(f"{left}n"), F.col("r_n"))
    if not words:
        return least
    lacked = lambda a, b: reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}m{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}m{i}")))) for i in range(words)])
    return F.least(F.col(f"{left}n") - lacked(left, "r_"), F.col("r_n") - lacked("r_", left))


def conjunctive_pairs(left: DataFrame, right: DataFrame, types: list[int], test: Test, symmetric: bool, bounds: Callable[[int], tuple[float, float]] = lambda t: (0.0, 0.0)) -> DataFrame:
    """(u, w), u from left and w from right, that pass ``test(type, common, size_u, size_w)`` in every type.

    ``symmetric``: left and right are the same and each pair comes once, u < w.
    ``bounds`` gives for a type what share of its own members a set at least has in
    common with one that passes, and the least ratio of their sizes.
    """
    left, right = (x.where(F.col("type").isin(*types)) for x in (left, right))
    costs = type_costs(left if symmetric else left.unionByName(right))
    fused = [t for t in types if t not in costs or costs[t][0] <= 1] if symmetric else []
    rest = sorted((t for t in types if t not in fused), key=lambda t: costs.get(t, (0, 0))[1])
    keys = [f"f{t}" for t in fused]

    def universe(nbr: DataFrame) -> DataFrame:
        return nbr.groupBy("u").agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("type") == t, F.col("v"))).alias(f"f{t}") for t in fused]).drop("_n")

    def near(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns])
        same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) if k in keys else F.col(k) == F.col(f"r_{k}") for k in [*on, *keys]]
        apart = F.col("u") < F.col("r_u") if symmetric else F.col("u") != F.col("r_u")
        return a.join(b, reduce(lambda x, y: x & y, [*same, apart]))

    def verified(pairs: DataFrame, kind: int) -> DataFrame:
        a, b = (x.where(F.col("type") == kind).select("u", "v") for x in (left, right))
        common = pairs.join(a, "u").join(b.withColumnRenamed("u", "w"), ["w", "v"]).groupBy("u", "w").agg(F.count("*").alias("c"))
        sized = pairs.join(common, ["u", "w"], "left").join(_sizes(left, kind, "na"), "u", "left").join(_sizes(right, kind, "nb").withColumnRenamed("u", "w"), "w", "left")
        c, na, nb = (F.coalesce(x, F.lit(0)) for x in ("c", "na", "nb"))
        return sized.where(test(kind, c, na, nb)).select("u", "w")

    def found(a: DataFrame, b: DataFrame, todo: list[int]) -> DataFrame | None:
        if not todo:
            return near(a, b, []).select("u", F.col("r_u").alias("w")) if keys else None
        kind, *more = todo
        ka, kb = (x.where(F.col("type") == kind).select("u", "v") for x in (left, right))
        met = near(a.join(ka, "u"), b.join(kb, "u"), ["v"]).groupBy("u", F.col("r_u").alias("w")).agg(F.count("*").alias("c"))
        sized = met.join(_sizes(left, kind, "na"), "u").join(_sizes(right, kind, "nb").withColumnRenamed("u", "w"), "w")
        pairs = sized.where(test(kind, F.col("c"), F.col("na"), F.col("nb"))).select("u", "w")
        return finished(pairs, a, b, ka, kb, more)

    def finished(pairs: DataFrame, a: DataFrame, b: DataFrame, ka: DataFrame, kb: DataFrame, more: list[int]) -> DataFrame:
        for t in more:
            pairs = verified(pairs, t)
        empty = found(a.join(ka, "u", "left_anti"), b.join(kb, "u", "left_anti"), more)
        return pairs if empty is None else pairs.unionByName(empty)

    got = found(universe(left), universe(right), rest)
    return got if got is not None else left.select("u", F.col("u").alias("w")).limit(0)


def _threshold(eps: dict[int, float], measure: str) -> Test:
    f = MEASURES[measure]
    return lambda t, c, na, nb: f(c, na, nb) >= F.lit(float(eps[t]))


def both_ways(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Directed edges of undirected ``pairs``, and an edge of every vertex (u) to itself."""
    back = pairs.select(F.col("w").alias("u"), F.col("u").alias("w"))
    return pairs.unionByName(back).unionByName(vertices.select("u", F.col("u").alias("w")))


def similar_edges(nbr: DataFrame, eps: dict[int, float], measure: str = "jaccard", enough: int | None = None) -> DataFrame:
    """Directed (u, w), self included: similarity reaches the threshold in every type with one above 0.

    ``enough``: pairs may be left out whose ends have so many similar vertices without
    each other, all of them cores of one community. Cores, communities, members and k-cores
    for ``enough`` and less are the same, from fewer pairs (see :func:`_sure_pairs`).
    """
    eps = {t: e for t, e in eps.items() if e > 0}
    if not eps:
        raise ValueError("no type is compared")
    if measure not in MEASURES:
        raise ValueError(f"no measure {measure}")
    sets = [F.collect_set(F.when(F.col("type") == t, F.col("v"))).alias(f"l{t}") for t in eps]
    own = materialize(nbr.where(F.col("type").isin(*eps)).groupBy("u").agg(*sets), "own")
    pairs = _alike_pairs(own, list(eps), _threshold(eps, measure), lambda t: BOUNDS[measure](float(eps[t])), enough, lambda t: SURE[measure](float(eps[t])))
    return both_ways(pairs, own.select("u"))


def _slack(base: DataFrame, keys: list[str], kind: int | None, share: float) -> DataFrame:
    """(u, g, z): two vertices of one group g, whose z add up to 0 or more, are surely similar.

    A group has the same keys and, of ``kind``, sets that are all empty or all filled.
    With b members that half of a group's sets hold, of which x are in a set of n, two
    sets have x + x' - b in common at least; that is surely enough from ``share`` of n + n' on.
    """
    name = F.to_json(F.struct(*keys)) if keys else F.lit("")
    if kind is None:
        return base.select("u", name.alias("g"), F.lit(0.0).alias("z"))
    vs = base.select("u", F.concat((F.size(f"l{kind}") > 0).cast("string"), name).alias("g"), F.col(f"l{kind}").alias("vs"))
    size = vs.groupBy("g").agg(F.count("*").alias("size"))
    often = vs.select("g", F.explode("vs").alias("v")).groupBy("g", "v").agg(F.count("*").alias("c")).join(size, "g").where(2 * F.col("c") >= F.col("size"))
    often = broadcast_if_small(materialize(often.groupBy("g").agg(F.collect_list("v").alias("often")), "often"), 100)
    z = F.size(F.array_intersect("vs", "often")) - F.size("vs") * F.lit(share) - F.size("often") / 2 - F.lit(1e-6)
    return vs.join(often, "g", "left").select("u", "g", F.when(F.size("vs") == 0, F.lit(0.0)).when(F.col("often").isNull(), -F.size("vs") * F.lit(share) - F.lit(1e-6)).otherwise(z).alias("z"))


def _sure_pairs(slack: DataFrame, enough: int) -> DataFrame:
    """(u, w), u < w: the surely similar pairs of rows :func:`_slack` that have an end among the ``enough`` of greatest z in their group.

    Where a pair u, w is left out, these are all surely similar to each other, to u and to w,
    so all of them are cores, of one community and one k-core, without that pair.
    """
    at = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("z"), "u"))
    top = slack.withColumn("at", at).where(F.col("at") <= enough).select("g", F.col("u").alias("t"), F.col("z").alias("tz"))
    met = slack.join(top, "g").where((F.col("u") != F.col("t")) & (F.col("z") + F.col("tz") >= 0))
    return met.select(F.least("u", "t").alias("u"), F.greatest("u", "t").alias("w")).distinct()


def _alike_pairs(own: DataFrame, types: list[int], test: Test, bounds: Callable[[int], tuple[float, float]], enough: int | None = None, sure: Callable[[int], float] | None = None) -> DataFrame:
    """(u, w), u < w, that pass ``test`` in every type (see :func:`conjunctive_pairs`), of rows ``own`` (u, l1, l2 ...): a vertex with its sets.

    ``enough`` as in :func:`similar_edges`; ``sure`` gives for a type what share of both sizes in common is surely enough.
    """
    most = dict(zip(types, own.agg(*[F.coalesce(F.max(F.size(f"l{t}")), F.lit(0)) for t in types]).first(), strict=True))
    fused = [t for t in types if most[t] <= 1]
    rest = [t for t in types if t not in fused]
    if len(rest) > 1:
        met = reduce(lambda x, y: x.unionByName(y), [own.select(F.lit(t).alias("type"), F.explode(f"l{t}").alias("v")) for t in rest]).groupBy("type", "v").agg(F.count("*").alias("n"))
        costs = {r.type: r.cost for r in met.groupBy("type").agg(F.sum(F.col("n") * F.col("n")).alias("cost")).collect()}  # a row per type
        rest.sort(key=lambda t: costs.get(t, 0))
    keys = [f"f{t}" for t in fused]
    base = own.select("u", *[F.get(f"l{t}", F.lit(0)).alias(f"f{t}") for t in fused], *[f"l{t}" for t in rest])
    other = base.select(*[F.col(c).alias(f"r_{c}") for c in base.columns])
    same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]

    def confirmed(likely: DataFrame, todo: list[int]) -> DataFrame:
        likely = materialize(likely.distinct(), "likely")
        ends = broadcast_if_small(materialize(likely.select(F.explode(F.array("u", "w")).alias("u")).distinct(), "ends"))
        a = base.join(ends, "u", "left_semi")
        met = likely.join(a, "u").join(a.select(*[F.col(c).alias(f"r_{c}") for c in base.columns]), F.col("w") == F.col("r_u"))
        met = met.where(reduce(lambda x, y: x & y, same, F.lit(True)))
        for t in todo:  # generated, so it is computed once
            met = met.withColumn("c", F.explode(F.array(F.size(F.array_intersect(f"l{t}", f"r_l{t}"))))).where(test(t, F.col("c"), F.size(f"l{t}"), F.size(f"r_l{t}"))).drop("c")
        return met.select("u", "w")

    out, empty, slack = [], F.lit(True), None
    if enough is not None and len(rest) <= 1:
        slack = materialize(_slack(base, keys, rest[0] if rest else None, sure(rest[0]) if rest else 0.0), "slack")
        sured = _sure_pairs(slack, enough)
        least = slack.groupBy("g").agg(F.min("z").alias("least"))
        slack = materialize(slack.join(least, "g").where(F.col("z") + F.col("least") < 0).select("u", "z"), "unsure")
        if slack.isEmpty():  # every pair of a group is surely similar
            return sured
        out.append(sured)
    for i, t in enumerate(rest):
        here = base.where(empty & (F.size(f"l{t}") > 0))
        rows = here.select("u", *keys, F.explode(f"l{t}").alias("v")) if slack is None else here.join(slack, "u").select("u", *keys, "z", F.explode(f"l{t}").alias("v"))
        if most[t] > LISTED:
            b = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
            unsure = F.lit(True) if slack is None else F.col("z") + F.col("r_z") < 0
            met = rows.join(b, reduce(lambda x, y: x & y, [F.col("v") == F.col("r_v"), F.col("u") < F.col("r_u"), unsure, *same])).groupBy("u", F.col("r_u").alias("w")).agg(F.count("*").alias("c"))
            n = here.select("u", F.size(f"l{t}").alias("n"))
            met = met.join(n.withColumnRenamed("n", "na"), "u").join(n.select(F.col("u").alias("w"), F.col("n").alias("nb")), "w")
            likely = met.where(test(t, F.col("c"), F.col("na"), F.col("nb"))).select("u", "w")
        else:
            likely = _prefix_pairs(rows.drop("z"), keys, t, test, bounds(t), slack)
        out.append(confirmed(likely, rest[i:]))
        empty = empty & (F.size(f"l{t}") == 0)
    if keys and slack is None:  # alike in all keys, with nothing else
        out.append(base.where(empty).join(other.where(reduce(lambda x, y: x & y, [F.size(f"r_l{t}") == 0 for t in rest], F.lit(True))), reduce(lambda x, y: x & y, [F.col("u") < F.col("r_u"), *same])).select("u", F.col("r_u").alias("w")))
    return reduce(lambda x, y: x.unionByName(y), out)


def _prefix_pairs(rows: DataFrame, keys: list[str], kind: int, test: Test, bound: tuple[float, float], slack: DataFrame | None = None) -> DataFrame:
    """(u, w), u < w, of rows (u, v, keys): pairs of sets that share an entry of their prefixes and that the signatures let through.

    With ``slack`` (u, z) only pairs whose z add up to less than 0: one of them has a z below 0, and begins the join.
    """
    share, ratio = bound
    entries, _ = _entered(rows, keys, share)
    if slack is not None:
        entries = entries.join(slack, "u")
    # both sides are renamed, so that they are one exchange
    a, b = (entries.select(*[F.col(c).alias(f"{x}{c}") for c in entries.columns]) for x in ("l_", "r_"))
    once = F.col("l_u") < F.col("r_u")
    if slack is not None:
        a, once = a.where("l_z < 0"), (F.col("l_z") + F.col("r_z") < 0) & (once | (F.col("r_z") >= 0))
    met = a.join(b, (F.col("l_v") == F.col("r_v")) & once & (F.least("l_n", "r_n") >= F.greatest("l_n", "r_n") * F.lit(ratio - 1e-9)) & test(kind, most_common(WORDS, "l_"), F.col("l_n"), F.col("r_n")))
    return met.select(F.least("l_u", "r_u").alias("u"), F.greatest("l_u", "r_u").alias("w")).distinct()


def positive_pairs(left: DataFrame, right: DataFrame, types: list[int]) -> DataFrame:
    """(u, w) with a similarity above 0 in every type."""
    return conjunctive_pairs(left, right, types, lambda t, c, na, nb: (c > 0) | ((na == 0) & (nb == 0)), False)


def repeated(nbr: DataFrame, types: list[int]) -> DataFrame:
    """(u, rep): vertices with the same neighbours in all ``types`` have the same rep, the least of them."""
    sets = nbr.where(F.col("type").isin(*types)).groupBy("u").agg(F.array_sort(F.collect_list(F.struct("type", "v"))).alias("vs"))
    return materialize(sets.join(sets.groupBy("vs").agg(F.min("u").alias("rep")), "vs").select("u", "rep"), "named")


def spread(pairs: DataFrame, named: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(u, w, and what ``pairs`` has besides), u < w: for each of ``pairs`` (a, b, on), a <= b, all pairs of vertices of a and of b in ``named`` (u, rep, on).

    A rep's vertices are lists of SPREAD at most, so a task forms pairs of two such lists at a time.
    """
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    part = F.floor((F.row_number().over(Window.partitionBy(*on, "rep").orderBy("u")) - 1) / SPREAD)
    lists = materialize(named.withColumn("part", part).groupBy(*on, "rep", "part").agg(F.array_sort(F.collect_list("u")).alias("us")), "lists")
    sizes = named.groupBy(*on, "rep").agg(F.count("*").alias("n"))
    side = lambda t, to: t.select(*on, *[F.col(c).alias(x) for c, x in to.items()])
    formed = pairs.join(side(sizes, {"rep": "a", "n": "na"}), [*on, "a"]).join(side(sizes, {"rep": "b", "n": "nb"}), [*on, "b"])
    rows = int(formed.agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0))).first()[0])
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, -(-rows // (10 * FORMED))))
    few = F.broadcast if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda t: t)
    met = pairs.repartition(parts).join(few(side(lists, {"rep": "a", "part": "_pa", "us": "_us"})), [*on, "a"]).join(few(side(lists, {"rep": "b", "part": "_pb", "us": "_ws"})), [*on, "b"])
    met = met.where((F.col("a") != F.col("b")) | (F.col("_pa") <= F.col("_pb")))
    every = met.select(*rest, "a", "b", "_ws", F.explode("_us").alias("_x")).select(*rest, "a", "b", "_x", F.explode("_ws").alias("_y"))
    return every.where((F.col("a") != F.col("b")) | (F.col("_x") < F.col("_y"))).select(F.least("_x", "_y").alias("u"), F.greatest("_x", "_y").alias("w"), *rest)


def _rounded(s: Column, digits: int | None) -> Column:
    return s if digits is None else F.round(s, digits)


def mean_similarities(nbr: DataFrame, types: list[int], measures: dict[str, str], digits: int | None = None) -> DataFrame:
    """(u, w, and a column for each of ``measures``, its name by the measure), u < w: mean similarity over ``types`` of pairs that share any neighbour.

    One vertex of each that have the same neighbours is compared, with the others and
    itself, and rounded to ``digits`` where given.
    """
    named = repeated(nbr, types)
    once = materialize(nbr.join(named.where("u = rep").select("u"), "u", "left_semi"), "once")
    found = None
    for measure, name in measures.items():
        v = similarity_vectors(once, typed_similarity(once, measure).where("u <= w"), types)
        v = v.select(F.col("u").alias("a"), F.col("w").alias("b"), _rounded(mean_similarity(F.col("vec")), digits).alias(name))
        found = v if found is None else found.join(v, ["a", "b"])
    return spread(materialize(found, "classes"), named)


def similar_pairs(nbr: DataFrame, measure: str = "jaccard", digits: int | None = None) -> DataFrame:
    """The rows of :func:`typed_similarity` with u < w: repeated sets are compared, and rounded to ``digits``, once, and pairs formed in lists of their vertices."""
    sets = nbr.groupBy("u", "type").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    named = materialize(sets.join(sets.groupBy("type", "vs").agg(F.min("u").alias("rep")), ["type", "vs"]).select("u", "type", "rep"), "named")
    s = _compared(nbr.join(named.where("u = rep").select("u", "type"), ["u", "type"], "left_semi"), measure).where("u <= w")
    return spread(materialize(s.select(F.col("u").alias("a"), F.col("w").alias("b"), "type", _rounded(F.col("s"), digits).alias("s")), "classes"), named, ("type",)).select("u", "w", "type", "s")


def typed_similarity(nbr: DataFrame, measure: str = "jaccard") -> DataFrame:
    """sim (u, w, type, s): directed, self included, for all pairs that share a neighbour of the type.

    Where half of the sets or more repeat another, one vertex of each set is compared,
    and every other one gets its similarities.
    """
    sets = nbr.groupBy("u", "type").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    named = materialize(sets.join(sets.groupBy("type", "vs").agg(F.min("u").alias("rep")), ["type", "vs"]).select("u", "type", "rep"), "named")
    every, apart = named.agg(F.count("*"), F.count_if(F.col("u") == F.col("rep"))).first()
    if 2 * apart > every:
        return _compared(nbr, measure)
    s = materialize(_compared(nbr.join(named.where("u = rep").select("u", "type"), ["u", "type"], "left_semi"), measure), "classes")
    left, right = named.withColumnRenamed("rep", "a"), named.select(F.col("u").alias("w"), "type", F.col("rep").alias("b"))
    s = s.select(F.col("u").alias("a"), F.col("w").alias("b"), "type", "s")
    return s.join(left, ["type", "a"]).join(right, ["type", "b"]).select("u", "w", "type", "s")


def _compared(nbr: DataFrame, measure: str) -> DataFrame:
    """:func:`typed_similarity` of all vertices, one by one."""
    n = nbr.groupBy("u", "type").agg(F.count("*").alias("n"))
    b = nbr.withColumnRenamed("u", "w")
    c = nbr.join(b, ["type", "v"]).where("u < w").groupBy("u", "w", "type").agg(F.count("*").alias("c"))
    sized = c.join(n.withColumnRenamed("n", "na"), ["u", "type"]).join(n.select(F.col("u").alias("w"), "type", F.col("n").alias("nb")), ["w", "type"])
    s = sized.select("u", "w", "type", MEASURES[measure](F.col("c"), F.col("na"), F.col("nb")).alias("s"))
    own = n.select("u", F.col("u").alias("w"), "type", F.lit(1.0).alias("s"))
    return s.unionByName(s.select(F.col("w").alias("u"), F.col("u").alias("w"), "type", "s")).unionByName(own)


def similarity_vectors(nbr: DataFrame, sim: DataFrame, types: list[int]) -> DataFrame:
    """(u, w, vec): similarities in the order of ``types``, 1 where both have none of the type, for pairs with any row."""
    wide = sim.where(F.col("type").isin(*types)).groupBy("u", "w").agg(*[F.max(F.when(F.col("type") == t, F.col("s"))).alias(f"s{t}") for t in types])
    has = nbr.where(F.col("type").isin(*types)).groupBy("u").agg(*[F.max(F.col("type") == t).alias(f"h{t}") for t in types])
    other = has.select(F.col("u").alias("w"), *[F.col(f"h{t}").alias(f"g{t}") for t in types])
    parts = [F.coalesce(F.col(f"s{t}"), F.when(~F.col(f"h{t}") & ~F.col(f"g{t}"), F.lit(1.0)).otherwise(F.lit(0.0))) for t in types]
    return wide.join(has, "u").join(other, "w").select("u", "w", F.array(*parts).alias("vec"))


def common_vectors(nbr: DataFrame, types: list[int], measure: str = "jaccard") -> DataFrame:
    """(u, w, vec), directed, self included: pairs similar, however little, in every type.

    The same rows as those of :func:`similarity_vectors` without a 0, from far
    fewer: types of one neighbour at most are join keys, so that pairs which differ
    there are never formed.
    """
    own = materialize(nbr.where(F.col("type").isin(*types)), "own")
    costs = type_costs(own)
    fused = [t for t in types if t not in costs or costs[t][0] <= 1]
    rest = [t for t in types if t not in fused]
    keys = [f"f{t}" for t in fused]
    base = own.groupBy("u").agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("type") == t, F.col("v"))).alias(f"f{t}") for t in fused], *[F.count_if(F.col("type") == t).cast("int").alias(f"n{t}") for t in rest]).drop("_n")
    base = materialize(base, "base")

    whole = [*keys, *[f"n{t}" for t in rest]]

    def met(a: DataFrame, on: list[str]) -> DataFrame:
        b = a.select(*[F.col(c).alias(f"r_{c}") for c in a.columns])
        same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in [*on, *keys]]
        return a.join(b, reduce(lambda x, y: x & y, [*same, F.col("u") < F.col("r_u")]))

    sizes = [x for t in rest for x in (f"n{t}", f"r_n{t}")]
    bare = base.where(reduce(lambda x, y: x & y, [F.col(f"n{t}") == 0 for t in rest], F.lit(True)))
    parts = [_met_often(base, own, keys, rest, t, costs[t][1]) for t in rest]
    if keys:  # alike in all keys, with nothing else
        parts.append(met(bare.select("u", *whole), []).select("u", F.col("r_u").alias("w"), *sizes, *[F.lit(0).cast("long").alias(f"c{t}") for t in rest]))
    pairs = reduce(lambda a, b: a.unionByName(b), parts)
    if len(rest) > 1:
        pairs = pairs.groupBy("u", "w", *sizes).agg(*[F.max(f"c{t}").alias(f"c{t}") for t in rest])
    vec = F.array(*[F.lit(1.0) if t in fused else MEASURES[measure](F.col(f"c{t}"), F.col(f"n{t}"), F.col(f"r_n{t}")) for t in types])
    found = pairs.select("u", "w", vec.alias("vec")).where(F.forall("vec", lambda x: x > 0))
    ends = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("w").alias("w")), F.struct(F.col("w").alias("u"), F.col("u").alias("w"))))
    alone = base.select("u", F.col("u").alias("w"), F.array(*[F.lit(1.0)] * len(types)).alias("vec"))
    return found.select(ends.alias("e"), "vec").select("e.u", "e.w", "vec").unionByName(alone)


def _met_often(base: DataFrame, own: DataFrame, keys: list[str], rest: list[int], kind: int, cost: int) -> DataFrame:
    """(u, w, n, r_n and c of each type of ``rest``), u < w: pairs with the same keys that share a neighbour of ``kind``, and how many.

    The vertices at a neighbour are listed, LISTED of them at most, and a list is sent
    to each vertex there as one row, so that what is shuffled are numbers in arrays;
    pairs are formed and counted where all lists of a vertex are.
    """
    sizes = [f"n{t}" for t in rest]
    rows = base.select("u", *keys, *sizes).join(own.where(F.col("type") == kind).select("u", "v"), "u")
    at = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in ["v", *keys]]
    part = F.floor((F.row_number().over(Window.partitionBy("v", *keys).orderBy("u")) - 1) / LISTED)
    lists = rows.withColumn("part", part).groupBy("v", *keys, "part").agg(F.array_sort(F.collect_list(F.struct("u", *sizes))).alias("x"))
    lists = lists.select(*[F.col(k).alias(f"r_{k}") for k in ["v", *keys]], "x", F.element_at("x", -1)["u"].alias("last"))
    sent = rows.join(lists, reduce(lambda x, y: x & y, [*at, F.col("u") < F.col("last")])).select("u", *sizes, F.filter("x", lambda e: e["u"] > F.col("u")).alias("x"))
    sent = sent.select("u", *sizes, F.col("x.u").alias("ws"), *[F.col(f"x.{n}").alias(f"l_{n}") for n in sizes])
    sent = sent.repartition(max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cost // FORMED)), "u")
    pairs = sent.select("u", *sizes, F.posexplode("ws").alias("i", "w"), *[f"l_{n}" for n in sizes])
    pairs = pairs.select("u", "w", *[x for n in sizes for x in (F.col(n), F.get(f"l_{n}", F.col("i")).alias(f"r_{n}"))])
    counted = pairs.groupBy("u", "w", *[x for n in sizes for x in (n, f"r_{n}")]).agg(F.count("*").alias("c"))
    return counted.select("u", "w", *[x for n in sizes for x in (n, f"r_{n}")], *[(F.col("c") if t == kind else F.lit(0).cast("long")).alias(f"c{t}") for t in rest])


def index_edges(vectors: DataFrame, types: list[int], eps: dict[int, float]) -> DataFrame:
    """Directed similar edges, answered from stored vectors; types without a threshold above 0 don't count."""
    tests = [F.col("vec")[i] >= F.lit(float(eps[t])) for i, t in enumerate(types) if eps.get(t, 0) > 0]
    if not tests:
        raise ValueError("no type is compared")
    return vectors.where(reduce(lambda a, b: a & b, tests)).select("u", "w")


def sum_edges(nbr: DataFrame, eps: dict[int, float], generating: int) -> DataFrame:
    """Directed (u, w), self included: the sum of similarities reaches that of the thresholds.

    Candidates share a neighbour of the ``generating`` type, as in the online search. Of
    vertices with the same neighbours one is compared; two such are alike in all types.
    """
    types = list(eps)
    every = nbr.where(F.col("type").isin(*types))
    named = repeated(every, types)
    own = materialize(every.join(named.where("u = rep").select("u"), "u", "left_semi"), "once")
    gen = own.where(F.col("type") == generating).select("u", "v")
    pairs = gen.join(gen.withColumnRenamed("u", "w"), "v").where("u < w").select("u", "w").distinct()
    total = None
    for t in types:
        a = own.where(F.col("type") == t).select("u", "v")
        common = pairs.join(a, "u").join(a.withColumnRenamed("u", "w"), ["w", "v"]).groupBy("u", "w").agg(F.count("*").alias("c"))
        x = pairs.join(common, ["u", "w"], "left").join(_sizes(own, t, "na"), "u", "left").join(_sizes(own, t, "nb").withColumnRenamed("u", "w"), "w", "left")
        c, na, nb = (F.coalesce(y, F.lit(0)) for y in ("c", "na", "nb"))
        x = x.select("u", "w", MEASURES["jaccard"](c, na, nb).alias("s"))
        total = x if total is None else total.unionByName(x)
    least = float(sum(eps.values())) - 1e-12
    kept = total.groupBy("u", "w").agg(F.sum("s").alias("s")).where(F.col("s") >= F.lit(least)).select(F.col("u").alias("a"), F.col("w").alias("b"))
    if len(types) >= least:
        kept = kept.unionByName(gen.select(F.col("u").alias("a"), F.col("u").alias("b")).distinct())
    return both_ways(spread(materialize(kept, "classes"), named), every.where(F.col("type") == generating).select("u").distinct())
