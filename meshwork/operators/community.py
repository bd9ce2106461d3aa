"""Structural clustering: cores, communities, roles, searches and k-cores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import NUMBER_ROWS, drop_table, files_for, materialize
from .components import connected_components
from .similarity import positive_pairs


def similar_degree(edges: DataFrame) -> DataFrame:
    """(u, n_similar), self counted."""
    return edges.groupBy("u").agg(F.count("*").alias("n_similar"))


def core_vertices(edges: DataFrame, mu: int) -> DataFrame:
    """(u): vertices with mu similar ones at least, themselves counted."""
    return similar_degree(edges).where(F.col("n_similar") >= mu).select("u")


def clusters(edges: DataFrame, cores: DataFrame, components: Callable = connected_components) -> DataFrame:
    """(u, cid) of cores: components of the similar edges among them, named by the least; ``components`` finds them."""
    among = edges.join(cores, "u", "left_semi").join(cores.withColumnRenamed("u", "w"), "w", "left_semi")
    return components(among, "u", "w").select(F.col("node").alias("u"), F.col("component").alias("cid"))


def membership(edges: DataFrame, mu: int) -> DataFrame:
    """(v, cid, role): cores (c) and the non-cores similar to one (n); a non-core may have several communities."""
    cores = materialize(core_vertices(edges, mu), "cores")
    named = materialize(clusters(edges, cores), "clusters")
    border = edges.join(cores.select(F.col("u").alias("w")), "w", "left_anti").join(named, "u").select(F.col("w").alias("v"), "cid").distinct()
    return named.select(F.col("u").alias("v"), "cid", F.lit("c").alias("role")).unionByName(border.withColumn("role", F.lit("n")))


def roles(nbr: DataFrame, vertices: DataFrame, members: DataFrame, types: list[int]) -> DataFrame:
    """(v, role) of non-members: h where similar in every type, however little, to members of two communities, else o."""
    left = vertices.join(members.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
    a = nbr.join(left, "u", "left_semi")
    b = nbr.join(members.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    near = positive_pairs(a, b, types).join(members.select(F.col("v").alias("w"), "cid"), "w")
    found = near.groupBy("u").agg((F.countDistinct("cid") > 1).alias("hub"))
    return left.join(found, "u", "left").select(F.col("u").alias("v"), F.when(F.coalesce("hub", F.lit(False)), F.lit("h")).otherwise(F.lit("o")).alias("role"))


def detection_output(members: DataFrame, others: DataFrame) -> DataFrame:
    """(v, role, cid) of every vertex: members per community, hubs and outliers with cid -1."""
    return members.select("v", "role", "cid").unionByName(others.select("v", "role", F.lit(-1).cast("long").alias("cid")))


def detect(nbr: DataFrame, vertices: DataFrame, edges: DataFrame, mu: int, types: list[int]) -> DataFrame:
    """All communities, hubs and outliers: (v, role, cid)."""
    edges = materialize(edges, "similar")
    members = materialize(membership(edges, mu), "members")
    return detection_output(members, roles(nbr, vertices, members, types))


def summary(output: DataFrame) -> DataFrame:
    """One row: communities, members, cores, noncores, hubs, outliers (vertices each once)."""
    once = output.groupBy("v").agg(F.min("role").alias("role"))
    kinds = once.agg(*[F.count_if(c).alias(n) for n, c in (("members", F.col("role").isin("c", "n")), ("cores", F.col("role") == "c"), ("noncores", F.col("role") == "n"), ("hubs", F.col("role") == "h"), ("outliers", F.col("role") == "o"))])
    return output.where("cid >= 0").agg(F.countDistinct("cid").alias("communities")).crossJoin(kinds)


def search(members: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, v, role): the community of each query vertex (id) that is a core; another has none."""
    own = members.where("role = 'c'").join(queries.select(F.col("id").alias("v")), "v").select(F.col("v").alias("q"), "cid")
    return own.join(members, "cid").select("q", "v", "role")


def expand_search(edges: DataFrame, mu: int, queries: DataFrame) -> DataFrame:
    """The same from the queries outwards: cores of the frontier are expanded, round by round, for all queries at once.

    Worth it for few queries in a large graph: only what they reach is read.
    """
    cores = materialize(core_vertices(edges, mu), "cores")
    frontier = queries.select(F.col("id").alias("u")).join(cores, "u", "left_semi").select(F.col("u").alias("q"), F.col("u").alias("v"))
    seen = frontier = materialize(frontier, "frontier")
    while not frontier.isEmpty():
        from_cores = frontier.join(cores.withColumnRenamed("u", "v"), "v", "left_semi").withColumnRenamed("v", "u")
        new = from_cores.join(edges, "u").select("q", F.col("w").alias("v")).distinct().join(seen, ["q", "v"], "left_anti")
        frontier = materialize(new, "frontier")
        seen = materialize(seen.unionByName(frontier), "seen")
    return seen.join(cores.select(F.col("u").alias("v"), F.lit("c").alias("role")), "v", "left").select("q", "v", F.coalesce("role", F.lit("n")).alias("role"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """(u): what is left when vertices of fewer than k similar ones, themselves counted, go, again and again."""
    now = materialize(edges.select("u", "w"), "core")
    n = now.count()
    while True:
        alive = core_vertices(now, k)
        after = materialize(now.join(alive, "u", "left_semi").join(alive.withColumnRenamed("u", "w"), "w", "left_semi").select("u", "w"), "core")
        left = after.count()
        drop_table(now)
        now = after
        if left == n:
            return now.select("u").distinct()
        n = left


def k_core_search(edges: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """(q, v): the connected k-core of each query vertex that is in one."""
    alive = materialize(k_core(edges, k), "alive")
    inside = edges.join(alive, "u", "left_semi").join(alive.withColumnRenamed("u", "w"), "w", "left_semi")
    named = materialize(connected_components(inside, "u", "w"), "named")
    own = queries.select(F.col("id").alias("node")).join(named, "node").select(F.col("node").alias("q"), "component")
    return own.join(named, "component").select("q", F.col("node").alias("v"))


def similar_inside(edges: DataFrame, community: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(u, w): similar pairs inside a community (v), with names (id, name) where given."""
    c = community.select("v").distinct()
    out = edges.where("u < w").join(c.withColumnRenamed("v", "u"), "u", "left_semi").join(c.withColumnRenamed("v", "w"), "w", "left_semi")
    if names is not None:
        for side in ("u", "w"):
            out = out.join(names.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name")), side, "left")
    return out
