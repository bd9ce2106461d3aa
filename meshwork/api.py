"""Searches, detection, index building, projection and discovery, each from a network and a query specification.

The text form of a specification (see ``sources.spec.parse_spec``):

    mu
    hops
    query type, number of query vertices
    ids of query vertices; -1: a stride sample; -2: selected ids are given apart
    thresholds: lines ``type eps``, or ``-1 eps`` for all types within the hops,
    ``-2 eps`` or ``-3 eps`` the same with meta-paths after it, ``-4 n`` and n lines
    then meta-paths after them: their number, and for each a line ``v e v ... v``
    (e = -1: any edge type) and a line with its threshold
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import community, forest, index, local, metapath, metrics, neighborhood, seeded, served, similarity, skyline
from .session import materialize
from .sources.buckets import buckets_for, read_bucketed, write_bucketed
from .sources.hin import Hin
from .sources.spec import QuerySpec

#: Measures over typed neighbourhoods, and over meta-paths.
TYPED, PATHS = ("jaccard", "cosine", "overlap"), ("pathsim", "hetesim")


@dataclass(frozen=True)
class Prepared:
    """A specification over a network: neighbourhoods of the compared types, query-type vertices (u), thresholds by type."""

    nbr: DataFrame
    vertices: DataFrame
    eps: dict[int, float]

    @property
    def types(self) -> list[int]:
        return sorted(self.eps)


def prepare(hin: Hin, spec: QuerySpec, scale: int = 100) -> Prepared:
    """Neighbourhoods within the hops of the first ``scale`` percent of the query type's vertices."""
    if not 0 < scale <= 100:
        raise ValueError("scale is a percentage")
    eps = spec.thresholds(neighborhood.schema_distance(hin, spec.query_type))
    own = hin.of_type(spec.query_type)
    if scale < 100:
        n, low = own.agg(F.count("*"), F.coalesce(F.min("id"), F.lit(0))).first()
        own = neighborhood.scaled(own.withColumn("local_id", F.col("id") - low), n, scale)
    nbr = neighborhood.d_hop(hin, own.select("id"), spec.hops, list(eps))
    return Prepared(materialize(nbr, "nbr"), own.select(F.col("id").alias("u")), eps)


@dataclass(frozen=True)
class Index:
    """Stored similarity vectors (u, w, vec) of ``types``, neighbourhoods, threshold vectors (v, thres) by k, and trees.

    Vectors and neighbourhoods are bucketed by u, thresholds by v, in the same number
    of buckets. ``forests`` and ``taus``, by the place of the type, are the merge
    forest (a, b, lv) and the levels (v, lv) of that type's threshold tree for the
    least k, where trees were asked for.
    """

    types: list[int]
    nbr: DataFrame
    vectors: DataFrame
    thresholds: dict[int, DataFrame]
    forests: dict[int, DataFrame]
    taus: dict[int, DataFrame]

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        """Read what :func:`build_index` wrote."""
        types = [r.type for r in spark.read.parquet(f"{folder}/types").orderBy("at").collect()]
        ks = [r.k for r in spark.read.parquet(f"{folder}/ks").collect()]
        trees = [r.at for r in spark.read.parquet(f"{folder}/trees").collect()]
        read = lambda part: read_bucketed(spark, f"{folder}/{part}")
        return cls(types, read("nbr"), read("vectors"), {k: read(f"k_thres_{k}") for k in ks}, {i: read(f"forest_{i}") for i in trees}, {i: read(f"tau_{i}") for i in trees})

    def edges(self, eps: dict[int, float]) -> DataFrame:
        """Directed similar pairs; every threshold's type must be indexed."""
        missing = [t for t, e in eps.items() if e > 0 and t not in self.types]
        if missing:
            raise ValueError(f"types {missing} are not indexed")
        return similarity.index_edges(self.vectors, self.types, eps)


def build_index(hin: Hin, spec: QuerySpec, folder: str, start_k: int = -1, scale: int = 100, subsets: bool = False, improved: bool = False, trees: bool = False) -> Index:
    """Similarity vectors of the compared types and thresholds for ``start_k``; -1 stands for 1, 2 and 3.

    Vectors are kept of pairs similar, however little, in all types, which answers
    thresholds above 0 in all; with ``subsets`` of pairs similar in any, which also
    answers thresholds in some of the types. Thresholds come from the grid of levels, or
    with ``improved``, and for four types and more, from halving the lattice. With
    ``trees`` each type's threshold tree is stored as a merge forest.
    """
    if start_k != -1 and start_k < 1:
        raise ValueError("start_k is -1 or at least 1")
    p, spark = prepare(hin, spec, scale), hin.vertices.sparkSession
    if subsets:
        vectors = similarity.similarity_vectors(p.nbr, materialize(similarity.typed_similarity(p.nbr), "sim"), p.types)
    else:
        vectors = similarity.common_vectors(p.nbr, p.types)
    vectors = materialize(vectors, "vectors")
    buckets = buckets_for(vectors.count())
    write_bucketed(vectors, f"{folder}/vectors", "u", buckets)
    write_bucketed(p.nbr, f"{folder}/nbr", "u", buckets)
    ks = [1, 2, 3] if start_k == -1 else [start_k]
    common, find = index.common_vectors(vectors), skyline.lattice_thresholds if improved or len(p.types) > 3 else index.k_thresholds
    for k in ks:
        write_bucketed(find(common, k, len(p.types)), f"{folder}/k_thres_{k}", "v", buckets)
    stored = list(range(len(p.types))) if trees else []
    for i in stored:
        pairs = materialize(common.select("u", "w", F.col("vec")[i].alias("s")), "s")
        tau = materialize(index.k_thresholds_1d(pairs, ks[0]), "tau")
        write_bucketed(tau, f"{folder}/tau_{i}", "v", buckets)
        write_bucketed(forest.spanning_forest(forest.weighted_pairs(pairs, tau)), f"{folder}/forest_{i}", "a", buckets)
    for name, rows, schema in (("types", list(enumerate(p.types)), "at int, type int"), ("ks", [(k,) for k in ks], "k int"), ("trees", [(i,) for i in stored], "at int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    return Index.load(spark, folder)


def similar(hin: Hin, spec: QuerySpec, measure: str = "jaccard", combine: str = "all", stored: Index | None = None, scale: int = 100, enough: int | None = None) -> DataFrame:
    """Directed similar pairs (u, w) of the query type, self included.

    ``combine``: ``all`` thresholds are reached, or the ``sum`` of the similarities
    reaches that of the thresholds. Path measures take the specification's meta-paths.
    ``enough`` (see :func:`similarity.similar_edges`) leaves out pairs that communities
    and k-cores of so many don't need, where all thresholds are asked for.
    """
    if measure in PATHS:
        if not spec.metapaths or stored or combine != "all":
            raise ValueError(f"{measure} takes meta-paths, no index and no sum")
        found = {"pathsim": metapath.pathsim_edges, "hetesim": metapath.hetesim_edges}[measure]
        return found(hin, list(spec.metapaths))
    if measure not in TYPED or combine not in ("all", "sum"):
        raise ValueError(f"no measure {measure} with {combine}")
    if stored is not None:
        if (measure, combine, scale) != ("jaccard", "all", 100):
            raise ValueError("an index answers Jaccard in all types, at its own scale")
        return stored.edges(spec.thresholds(neighborhood.schema_distance(hin, spec.query_type)))
    p = prepare(hin, spec, scale)
    if combine == "sum":
        if measure != "jaccard":
            raise ValueError("sums are of Jaccard")
        return similarity.sum_edges(p.nbr, p.eps, neighborhood.generating_type(neighborhood.schema_distance(hin, spec.query_type), p.types))
    return similarity.similar_edges(p.nbr, p.eps, measure, enough)


def community_search(hin: Hin, spec: QuerySpec, measure: str = "jaccard", combine: str = "all", stored: Index | None = None, selected: DataFrame | None = None, scale: int = 100) -> DataFrame:
    """(q, v, role): the community of each of the specification's query vertices that is a core."""
    edges = materialize(similar(hin, spec, measure, combine, stored, scale, spec.mu), "similar")
    members = materialize(community.membership(edges, spec.mu), "members")
    return community.search(members, neighborhood.query_vertices(hin, spec, selected))


def local_search(hin: Hin, spec: QuerySpec, measure: str = "jaccard", selected: DataFrame | None = None) -> DataFrame:
    """(q, v, role): the answers of :func:`community_search`, found from the query vertices outwards.

    Worth it where the communities asked for are a small part of the network.
    """
    if measure not in TYPED:
        raise ValueError(f"no measure {measure} over neighbourhoods")
    distance = neighborhood.schema_distance(hin, spec.query_type)
    queries = materialize(neighborhood.query_vertices(hin, spec, selected), "queries")
    found = local.local_edges(hin, queries, spec.query_type, spec.hops, spec.thresholds(distance), distance, spec.mu, measure)
    return community.search(materialize(community.membership(found.edges, spec.mu), "members"), queries)


def path_search(hin: Hin, spec: QuerySpec, measure: str = "pathsim", selected: DataFrame | None = None) -> DataFrame:
    """(q, v, role): the answers of :func:`community_search` with a path measure, walked from the query vertices along the meta-paths."""
    if measure not in PATHS or not spec.metapaths:
        raise ValueError(f"{measure} is no measure over the specification's meta-paths")
    queries = materialize(neighborhood.query_vertices(hin, spec, selected), "queries")
    edges = materialize(seeded.walked_edges(hin, list(spec.metapaths), queries, spec.mu, measure), "similar")
    return community.search(materialize(community.membership(edges, spec.mu), "members"), queries)


def index_search(hin: Hin, spec: QuerySpec, stored: Index, selected: DataFrame | None = None) -> DataFrame:
    """(q, v, role): the answers of :func:`community_search`, walked from the query vertices through the stored index."""
    queries = materialize(neighborhood.query_vertices(hin, spec, selected), "queries")
    edges = served.served_edges(stored.vectors, stored.types, _indexed(hin, spec, stored), spec.mu, queries)
    return community.search(materialize(community.membership(edges, spec.mu), "members"), queries)


def index_kcore_search(hin: Hin, spec: QuerySpec, stored: Index, selected: DataFrame | None = None) -> DataFrame:
    """(q, v): the answers of :func:`kcore_search` from stored thresholds for k = mu, in whole hundredths; nothing is peeled."""
    if spec.mu not in stored.thresholds:
        raise ValueError(f"the index has no thresholds for k = {spec.mu}")
    eps = _indexed(hin, spec, stored)
    queries = materialize(neighborhood.query_vertices(hin, spec, selected), "queries")
    return served.served_k_core(stored.vectors, stored.thresholds[spec.mu], stored.types, eps, queries)


def _indexed(hin: Hin, spec: QuerySpec, stored: Index) -> dict[int, float]:
    eps = spec.thresholds(neighborhood.schema_distance(hin, spec.query_type))
    missing = [t for t in eps if t not in stored.types]
    if missing:
        raise ValueError(f"types {missing} are not indexed")
    return eps


def community_detect(hin: Hin, spec: QuerySpec, stored: Index | None = None) -> DataFrame:
    """(v, role, cid): all communities, hubs and outliers among the vertices of the query type."""
    p = prepare(hin, spec)
    edges = stored.edges(p.eps) if stored is not None else similarity.similar_edges(p.nbr, p.eps, enough=spec.mu)
    return community.detect(p.nbr, p.vertices, edges, spec.mu, p.types)


def kcore_search(hin: Hin, spec: QuerySpec, scale: int = 100, stored: Index | None = None, selected: DataFrame | None = None) -> DataFrame:
    """(q, v): the connected k-core, k = mu, of each query vertex that is in one, among ``scale`` percent of the vertices."""
    edges = materialize(similar(hin, spec, stored=stored, scale=scale, enough=spec.mu), "similar")
    return community.k_core_search(edges, spec.mu, neighborhood.query_vertices(hin, spec, selected))


def discover_metapaths(hin: Hin, kind: int, top: int = 1001, sample: int | None = None) -> DataFrame:
    """The most frequent meta-paths from a type back to itself."""
    return metapath.discover(hin, kind, top, sample)


def project_metapath(hin: Hin, spec: QuerySpec) -> DataFrame:
    """(u, w): the homogeneous graph of the specification's first meta-path."""
    return metapath.project(hin, spec.metapaths[0][0])


def search_report(found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(q, size, cores, noncores) of a search's answers, with the query vertex's name where names (id, name) are given."""
    out = found.groupBy("q").agg(F.countDistinct("v").alias("size"), F.count_if(F.col("role") == "c").alias("cores"), F.count_if(F.col("role") == "n").alias("noncores"))
    return out if names is None else out.join(names.select(F.col("id").alias("q"), "name"), "q", "left")


def batch_report(found: DataFrame, queries: DataFrame, edges: DataFrame | None = None, nbr: DataFrame | None = None, types: list[int] | None = None) -> DataFrame:
    """One row for a batch: queries, answered, mean_size, mean_cores, over those that were answered.

    Where similar ``edges`` are given also mean_density and mean_cc, where
    neighbourhoods are also mean_jaccard and mean_cosine, of the answers as communities.
    """
    rows = search_report(found)
    parts = [F.count("*").alias("answered"), F.avg("size").alias("mean_size"), F.avg("cores").alias("mean_cores")]
    members = found.select("v", F.col("q").alias("cid"), "role")
    if edges is not None:
        d = metrics.density(edges, members).select(F.col("cid").alias("q"), "density")
        rows = rows.join(d, "q").join(metrics.clustering(edges, members).select(F.col("cid").alias("q"), "cc"), "q")
        parts += [F.avg("density").alias("mean_density"), F.avg("cc").alias("mean_cc")]
    if nbr is not None:
        rows = rows.join(metrics.pair_similarity(nbr, members, types or [], None).withColumnRenamed("cid", "q"), "q")
        parts += [F.avg("avg_jaccard").alias("mean_jaccard"), F.avg("avg_cosine").alias("mean_cosine")]
    return queries.agg(F.count("*").alias("queries")).crossJoin(rows.agg(*parts))


def example_pairs(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(q, v): of each answer the least other member similar to the query vertex, else the least other core, else none."""
    other = found.where("q <> v")
    near = other.join(edges.select(F.col("u").alias("q"), F.col("w").alias("v")).distinct(), ["q", "v"], "left_semi").groupBy("q").agg(F.min("v").alias("near"))
    core = other.where("role = 'c'").groupBy("q").agg(F.min("v").alias("core"))
    return found.select("q").distinct().join(near, "q", "left").join(core, "q", "left").select("q", F.coalesce("near", "core").alias("v"))
