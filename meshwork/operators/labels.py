"""Ground-truth labels of a bibliographic network."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.hin import dense_index


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, c): all pairs over (a, b) and (b, c), repeats kept."""
    return first.join(second, "b").select("a", "c")


def bags_and_sets(venues: DataFrame, topics: DataFrame) -> DataFrame:
    """(a, venues, topics): sorted venues with repeats, sorted distinct topics of each author, from (a, c) pairs."""
    v = venues.groupBy("a").agg(F.array_sort(F.collect_list("c")).alias("venues"))
    t = topics.groupBy("a").agg(F.array_sort(F.collect_set("c")).alias("topics"))
    return v.join(t, "a", "full")


def mode_share(pairs: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, share): most frequent label of each key, the least of several, and its share rounded to 2."""
    n = pairs.groupBy(key, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    first = n.withColumn("share", F.round(F.col("n") / total, 2)).groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label"), "share")).alias("x"))
    return first.select(key, F.col("x.label").alias(label), F.col("x.share").alias("share"))


def author_table(modes: DataFrame, attributes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Attributes of each author (id, ...) that has a modal label (id, label, share), and its degree (id, degree), 0 without one."""
    return attributes.join(modes, "id").join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def outlier_labels(authors: DataFrame, share: float = 0.2, seed: int = 1) -> DataFrame:
    """``authors`` (id, degree, hindex) with outlier: degree at most 2, or in the sampled share of hindex at most 2 above that."""
    low, weak = F.col("degree") <= 2, (F.col("hindex") <= 2) & ~(F.col("degree") <= 2)
    picked = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return authors.withColumn("outlier", F.coalesce(low | (weak & picked), F.lit(False)))


def condition_counts(authors: DataFrame) -> DataFrame:
    """One row: authors of degree at most 2, of hindex at most 2, and of the second without the first."""
    low, weak = F.col("degree") <= 2, F.col("hindex") <= 2
    return authors.agg(F.count_if(low).alias("low_degree"), F.count_if(weak).alias("low_hindex"), F.count_if(weak & ~low).alias("only_hindex"))


def merge_topics(rows: DataFrame, key: str, topics: str) -> DataFrame:
    """(key, topics): sorted distinct topics over all lists of a key; a null key is one of its own."""
    each = rows.select(F.coalesce(F.col(key), F.lit("None")).alias(key), F.explode(topics).alias("t"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("t")).alias(topics))


def topic_clusters(embeddings: DataFrame, label: str | None = None, k: int = 10, seed: int = 1) -> DataFrame:
    """(id, cluster): k-means of embeddings (id, vec), within each ``label`` where given, numbered on over labels."""
    vec = materialize(embeddings.select("id", F.col("vec").cast("array<double>").alias("vec"), *([label] if label else [])), "embeddings")
    vec = vec.withColumn("features", array_to_vector("vec"))
    parts = [None] if label is None else sorted(r[0] for r in vec.select(label).distinct().collect())
    out, base = None, 0
    for p in parts:
        mine = vec if p is None else vec.where(F.col(label) == p)
        n = mine.count()
        model = KMeans(k=min(k, max(2, n)), seed=seed, featuresCol="features", predictionCol="c").fit(mine)
        got = model.transform(mine).select("id", (F.col("c") + base).alias("cluster"))
        base += len(model.clusterCenters())
        out = got if out is None else out.unionByName(got)
    return out


def renumber(clusters: DataFrame, *keys: str) -> DataFrame:
    """``clusters`` with global_id: 0, 1, 2 ... over the distinct keys in order."""
    numbered = dense_index(clusters.select(*keys).distinct(), list(keys), "global_id")
    return clusters.join(numbered, list(keys))


def modal_cluster(author_topics: DataFrame, topic_cluster: DataFrame) -> DataFrame:
    """(a, cluster, share) by an author's topics (a, topics); without a known topic one past the last cluster.

    The share's denominator is the number of all the author's topics.
    """
    each = author_topics.select("a", F.explode("topics").alias("id")).join(topic_cluster, "id")
    n = each.groupBy("a", "cluster").agg(F.count("*").alias("n"))
    best = n.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("m"), "cluster")).alias("x"))
    new = topic_cluster.agg((F.coalesce(F.max("cluster"), F.lit(-1)) + 1).alias("new"))
    share = F.round(-F.col("x.m") / F.nullif(F.size("topics"), F.lit(0)), 2)
    return author_topics.join(best, "a", "left").crossJoin(F.broadcast(new)).select("a", F.coalesce("x.cluster", "new").alias("cluster"), F.coalesce(share, F.lit(0.0)).alias("share"))
