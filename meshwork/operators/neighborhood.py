"""Typed neighbourhoods, schema distances and query vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.hin import Hin
from ..sources.spec import QuerySpec


#: Edges of a vertex beyond which what it reaches is counted once, not for each vertex beside it.
HUB = 256


def d_hop(hin: Hin, seeds: DataFrame, hops: int, types: list[int] | None = None) -> DataFrame:
    """nbr (u, type, v): vertices within ``hops`` hops of every u in ``seeds`` (id), u itself at hop 0.

    The first step reads the edges of the seeds' types only and is deduplicated where
    it is joined. A later one is a shuffle join of the frontier with the edges,
    deduplicated before and after; what was seen is left out of the next frontier.
    With ``types`` only vertices of these come back, and the last step goes to no other.
    """
    if "type" not in seeds.columns:
        seeds = seeds.join(hin.vertices.select("id", "type"), "id")
    kinds = [r[0] for r in seeds.select("type").distinct().collect()]  # a row per type
    seen = frontier = seeds.select(F.col("id").alias("u"), F.col("id").alias("v"), "type")
    for i in range(hops):
        edges = hin.edges if types is None or i + 1 < hops else hin.edges.where(F.col("dst_type").isin(*types))
        step = edges.select(F.col("src").alias("v"), F.col("dst").alias("next"), F.col("dst_type").alias("kind"))
        if i == 0:
            first = edges.where(F.col("src_type").isin(*kinds)).join(seeds.select("id").distinct(), F.col("src") == F.col("id")).where("src <> dst")
            frontier = first.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("dst_type").alias("type")).distinct()
        else:
            reached = frontier.drop("type").join(step.distinct(), "v").select("u", F.col("next").alias("v"), F.col("kind").alias("type")).distinct()
            frontier = reached.join(seen, ["u", "v"], "left_anti")
        seen = seen.unionByName(frontier)
    seen = seen.select("u", "type", "v")
    return seen if types is None else seen.where(F.col("type").isin(*types))


def two_hop_sizes(hin: Hin, seeds: DataFrame) -> DataFrame:
    """(u, type, n): sizes of the neighbourhoods of :func:`d_hop` within two hops.

    What a vertex reaches through hubs, vertices of more than HUB edges, is the same
    for all with the same hubs: it is counted once for each set of hubs, by degrees
    where that is a single one. Of what it reaches otherwise, which is listed, only
    those are added that none of its hubs reaches.
    """
    step = materialize(hin.edges.select("src", "dst", "dst_type").distinct(), "step")
    hubs = materialize(step.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select(F.col("src").alias("h")), "hubs")
    seeds = seeds.select(F.col("id").alias("u")).distinct()
    own = seeds.join(hin.vertices.select(F.col("id").alias("u"), "type"), "u").select("u", F.col("u").alias("v"), "type")
    first = materialize(seeds.join(step, F.col("u") == F.col("src")).select("u", F.col("dst").alias("v"), F.col("dst_type").alias("type")), "first")
    plain, through = (first.join(hubs, F.col("v") == F.col("h"), how) for how in ("left_anti", "left_semi"))
    sets = materialize(through.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("hs")), "hub_sets")
    second = plain.select("u", F.col("v").alias("src")).join(step, "src").select("u", F.col("dst").alias("v"), F.col("dst_type").alias("type"))
    near = own.unionByName(first).unionByName(second).repartition("u").distinct()
    ways = step.join(hubs, F.col("src") == F.col("h"), "left_semi")
    asked = near.join(sets, "u", "left").select("u", "v", "type", F.explode_outer("hs").alias("h"))
    met = asked.join(ways.select(F.col("src").alias("h"), F.col("dst").alias("v"), F.lit(1).alias("met")), ["h", "v"], "left").groupBy("u", "v", "type").agg(F.max("met").alias("met"))
    listed = met.where("met is null").groupBy("u", "type").agg(F.count("*").alias("n"))
    one = ways.groupBy(F.array("src").alias("hs"), F.col("dst_type").alias("type")).agg(F.count("*").alias("n"))
    many = sets.select("hs").where(F.size("hs") > 1).distinct().select("hs", F.explode("hs").alias("h"))
    many = many.join(ways, F.col("h") == F.col("src")).select("hs", "dst", F.col("dst_type").alias("type")).distinct().groupBy("hs", "type").agg(F.count("*").alias("n"))
    far = sets.join(one.unionByName(many), "hs").select("u", "type", "n")
    return listed.unionByName(far).groupBy("u", "type").agg(F.sum("n").alias("n"))


def compared(nbr: DataFrame, types: list[int]) -> DataFrame:
    """The neighbourhoods of the compared types only."""
    return nbr.where(F.col("type").isin(*types))


def degree_stats(nbr: DataFrame) -> DataFrame:
    """type, least, most: neighbourhood sizes among vertices that have any of the type."""
    return size_stats(nbr.groupBy("u", "type").agg(F.count("*").alias("n")))


def size_stats(sizes: DataFrame) -> DataFrame:
    """type, least, most of sizes (u, type, n)."""
    return sizes.groupBy("type").agg(F.min("n").alias("least"), F.max("n").alias("most"))


def empty_sets(nbr: DataFrame, seeds: DataFrame, types: list[int]) -> DataFrame:
    """(u, type) pairs without neighbours."""
    kinds = F.explode(F.array(*[F.lit(t) for t in types]))
    return seeds.select(F.col("id").alias("u"), kinds.alias("type")).join(nbr.select("u", "type").distinct(), ["u", "type"], "left_anti")


def schema_distance(hin: Hin, query_type: int) -> dict[int, int]:
    """Hops from ``query_type`` to every type that it reaches; the type graph has a row per pair of types."""
    near: dict[int, set[int]] = {}
    for r in hin.type_graph().collect():
        near.setdefault(r.src_type, set()).add(r.dst_type)
    out, frontier = {query_type: 0}, {query_type}
    while frontier:
        frontier = {t for f in frontier for t in near.get(f, ())} - out.keys()
        out |= {t: max(out.values()) + 1 for t in frontier}
    return out


def generating_type(distance: dict[int, int], types: list[int]) -> int:
    """The compared type at the least schema distance; of several the largest number."""
    return min(types, key=lambda t: (distance.get(t, 1 << 30), -t))


def stride_sample(vertices: DataFrame, n: int, k: int, local: str = "local_id") -> DataFrame:
    """Vertices 1, 1 + s, 1 + 2s ... of n, s = n // k (1 at least), the first k."""
    step = max(1, n // k)
    at = F.col(local)
    return vertices.where((at >= 1) & ((at - 1) % step == 0) & (at < 1 + step * k))


def scaled(vertices: DataFrame, n: int, scale: int, local: str = "local_id") -> DataFrame:
    """The first n * scale / 100 vertices."""
    return vertices.where(F.col(local) < n * scale // 100)


def query_vertices(hin: Hin, spec: QuerySpec, selected: DataFrame | None = None) -> DataFrame:
    """(id) of the query vertices: given ids (global, or local from 0), selected ones, or a stride sample."""
    own = hin.of_type(spec.query_type)
    n, offset = own.agg(F.count("*"), F.coalesce(F.min("id"), F.lit(0))).first()
    local = own.withColumn("local_id", F.col("id") - offset)
    if spec.from_file:
        if selected is None:
            raise ValueError("the specification needs a list of selected ids")
        return local.join(selected.select("id"), "id", "left_semi").select("id")
    if spec.ids:
        wanted = [i - offset if i >= offset else i for i in spec.ids]
        return local.where(F.col("local_id").isin(wanted)).select("id")
    return stride_sample(local, n, spec.n_queries).select("id")
