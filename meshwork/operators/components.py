"""Connected components by alternating large-star and small-star (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_bits, union_bits
from ..session import NUMBER_ROWS, drop_table, files_for, materialize, settle


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None, small: bool = False) -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its least node.

    Direction, repeats and self loops don't matter; edges with a null end are no
    edges. Every round is two grouped minima, which combine before the shuffle,
    and joins against one row per node; rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder, the first in ``files`` at most; with ``small`` a round of
    few rows is a local relation instead.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    loops = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    cut = (lambda df, rows: settle(df, "star", rows)[0]) if small else (lambda df, rows: materialize(df, "star", files_for(rows, NUMBER_ROWS) if rows else files))
    now = cut(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    before = None
    while (digest := _digest(now)) != before and digest[0]:
        before = digest
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(stars.unionByName(least.withColumnRenamed("m", "b")).distinct(), digest[0])
        drop_table(now)
        now = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def flagged_components(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(component, size, low, high, fixed): components that carry the union of their pairs' levels and a flag.

    ``pairs``: a, b, lv (level of the pair, 0 to 100); ``vertices``: v, fixed. A vertex
    without a pair is a component of its own without levels. Each vertex first gets
    the union of its own pairs' levels; sets are two longs throughout, so what is
    merged by component is a row for each vertex, combined before the shuffle.
    """
    low, high = level_bits(F.col("lv"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("v"), low.alias("low"), high.alias("high"))
    own = ends.groupBy("v").agg(*[x.alias(n) for x, n in zip(union_bits(F.col("low"), F.col("high")), ("low", "high"), strict=True)])
    named = connected_components(pairs, small=True).withColumnRenamed("node", "v")
    none = F.lit(0).cast("long")
    rows = vertices.groupBy("v").agg(F.bool_or("fixed").alias("fixed")).join(named, "v", "left").join(own, "v", "left")
    rows = rows.select(F.coalesce("component", "v").alias("component"), F.coalesce("low", none).alias("low"), F.coalesce("high", none).alias("high"), F.coalesce("fixed", F.lit(False)).alias("fixed"))
    union = [x.alias(n) for x, n in zip(union_bits(F.col("low"), F.col("high")), ("low", "high"), strict=True)]
    return rows.groupBy("component").agg(F.count("*").alias("size"), *union, F.bool_or("fixed").alias("fixed"))
