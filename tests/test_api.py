"""Searches, detection and the index from a specification, over a small random network."""

import random

import pytest
from pyspark.sql import functions as F

from meshwork import api
from meshwork.operators import community, index, labels, metapath, neighborhood, similarity
from meshwork.sources import hin as sources
from meshwork.sources.hin import Hin
from meshwork.sources.spec import parse_spec

SPEC = "3\n2\n1 10\n-1\n-1 0.2\n"
PATHS = "2\n2\n1 10\n-1\n-2 0.2\n2\n1 -1 0 -1 1\n0.05\n1 -1 2 -1 1\n0.2\n"


def pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def hin(spark):
    """Types 0 (12), 1 (30), 2 (6) and 3 (5): 1 - 0, 1 - 2 and 0 - 3."""
    rng = random.Random(6)
    ids = {0: range(12), 1: range(100, 130), 2: range(200, 206), 3: range(300, 305)}
    links = [(u, rng.choice(ids[0]), 0) for u in ids[1] for _ in range(2)] + [(u, 200 + u % 6, 2) for u in ids[1]] + [(u, 300 + u % 5, 4) for u in ids[0]]
    edges = [(a, b, t) for a, b, t in links] + [(b, a, t + 1) for a, b, t in links]
    vertices = [(i, t) for t, own in ids.items() for i in own]
    return Hin.from_tables(spark.createDataFrame(vertices, "source_id long, type int"), spark.createDataFrame(edges, "src long, dst long, edge_type int"))


def test_shipped_specifications_are_read():
    for text, mu, hops, kind, n, eps in (("5\n2\n1 100\n-1\n-1 0.2", 5, 2, 1, 100, 0.2), ("5\n1\n0 1000\n-1\n-1 0.2", 5, 1, 0, 1000, 0.2), ("5\n2\n1 1000\n-1\n-1 0.4", 5, 2, 1, 1000, 0.4)):
        s = parse_spec(text, 4)
        assert (s.mu, s.hops, s.query_type, s.n_queries, s.unit_eps) == (mu, hops, kind, n, eps)


def test_search_and_detection_agree_with_the_index(spark, hin, tmp_path):
    spec = parse_spec(SPEC, 4)
    nbr = neighborhood.d_hop(hin, hin.of_type(1).select("id"), 2).where("type <> 1")
    edges = similarity.similar_edges(nbr, {0: 0.2, 2: 0.2, 3: 0.2})
    members = community.membership(edges, 3)
    queries = neighborhood.query_vertices(hin, spec)
    want = pairs(community.search(members, queries))
    assert want and pairs(api.community_search(hin, spec)) == want
    for subsets in (False, True):
        stored = api.build_index(hin, spec, str(tmp_path / f"i{subsets}"), 3, subsets=subsets)
        assert stored.types == [0, 2, 3] and list(stored.thresholds) == [3]
        assert pairs(api.community_search(hin, spec, stored=stored)) == want
        assert pairs(api.community_detect(hin, spec, stored)) == pairs(api.community_detect(hin, spec))
        assert pairs(api.kcore_search(hin, spec, stored=stored)) == pairs(api.kcore_search(hin, spec))
        again = api.Index.load(spark, str(tmp_path / f"i{subsets}"))
        assert pairs(again.edges({0: 0.2, 2: 0.2, 3: 0.2})) == pairs(edges)
        assert pairs(index.index_cores(again.thresholds[3], [0.2, 0.2, 0.2])) == pairs(community.k_core(edges, 3))
    assert pairs(again.edges({3: 0.4})) == pairs(similarity.similar_edges(nbr, {3: 0.4}))
    with pytest.raises(ValueError):
        again.edges({1: 0.5})


def test_thresholds_of_one_and_two(spark, hin, tmp_path):
    spec = parse_spec(SPEC.replace("-1 0.2", "0 0.2\n3 0.2"), 4)
    stored = api.build_index(hin, spec, str(tmp_path / "small"))
    assert sorted(stored.thresholds) == [1, 2, 3]
    for eps in ([0.2, 0.2], [0.6, 0.3], [0.34, 0.5], [1.0, 1.0]):
        edges = stored.edges(dict(zip(stored.types, eps)))
        for k in (1, 2, 3):
            assert pairs(index.index_cores(stored.thresholds[k], eps)) == pairs(community.k_core(edges, k))


def test_measures_sums_paths_and_scale(hin):
    spec, paths = parse_spec(SPEC, 4), parse_spec(PATHS, 4)
    nbr = neighborhood.d_hop(hin, hin.of_type(1).select("id"), 2).where("type <> 1")
    eps = {0: 0.2, 2: 0.2, 3: 0.2}
    for measure in ("cosine", "overlap"):
        assert pairs(api.similar(hin, spec, measure)) == pairs(similarity.similar_edges(nbr, eps, measure))
    assert pairs(api.similar(hin, spec, combine="sum")) == pairs(similarity.sum_edges(nbr, eps, 2))
    assert pairs(api.similar(hin, paths, "pathsim")) == pairs(metapath.pathsim_edges(hin, list(paths.metapaths)))
    assert pairs(api.similar(hin, paths, "hetesim")) == pairs(metapath.hetesim_edges(hin, list(paths.metapaths)))
    assert pairs(api.project_metapath(hin, paths)) == pairs(metapath.project(hin, paths.metapaths[0][0]))
    low = hin.of_type(1).agg(F.min("id")).first()[0]
    half = nbr.where(F.col("u") < low + 15)
    assert pairs(api.similar(hin, spec, scale=50)) == pairs(similarity.similar_edges(half, eps))
    assert {r.q for r in api.kcore_search(hin, spec, scale=50).collect()} <= set(range(low, low + 15))
    for wrong in ({"measure": "dice"}, {"combine": "most"}, {"measure": "pathsim"}, {"scale": 0}):
        with pytest.raises(ValueError):
            api.similar(hin, spec, **wrong)


def test_reports(spark, hin):
    spec = parse_spec(SPEC, 4)
    edges = api.similar(hin, spec).cache()
    found = api.community_search(hin, spec).cache()
    names = hin.vertices.select("id", F.concat(F.lit("n"), "id").alias("name"))
    report = api.search_report(found, names).collect()
    sizes = {}
    for r in found.collect():
        sizes.setdefault(r.q, set()).add(r.v)
    assert {r.q: r.size for r in report} == {q: len(v) for q, v in sizes.items()} and all(r.name == f"n{r.q}" and r.cores + r.noncores == r.size for r in report)
    p = api.prepare(hin, spec)
    one = api.batch_report(found, neighborhood.query_vertices(hin, spec), edges, p.nbr, p.types).first()
    assert one.queries == 10 and one.answered == len(sizes) and abs(one.mean_size - sum(map(len, sizes.values())) / len(sizes)) < 1e-9
    assert one.mean_density >= 1 and 0 <= one.mean_cc <= 1.5 and 0 < one.mean_jaccard <= one.mean_cosine <= 1
    linked = pairs(edges)
    for q, v in pairs(api.example_pairs(found, edges)):
        near = [x for x in sizes[q] if x != q and (q, x) in linked]
        assert v == min(near) if near else v != q


def test_sinks_and_sources(spark, tmp_path):
    out = spark.createDataFrame([(1, "c", 1), (2, "n", 1), (3, "h", -1), (4, "o", -1)], "v long, role string, cid long")
    sources.write_communities(out, str(tmp_path / "communities"))
    back = sources.read_communities(spark, str(tmp_path / "communities"))
    assert pairs(back) == pairs(out)
    assert pairs(sources.as_evaluation(back)) == {(1, "1"), (2, "1"), (3, "o"), (4, "o")}
    named = spark.createDataFrame([(1, "x"), (2, "y")], "id long, label string")
    sources.write_labels(named, str(tmp_path / "labels"))
    assert pairs(sources.read_evaluation(spark, str(tmp_path / "labels"))) == {(1, "x"), (2, "y")}
    (tmp_path / "t.tsv").write_text("id\tname\n1\ta b\n2\t\n")
    assert pairs(sources.read_tsv(spark, str(tmp_path / "t.tsv"), "id long, name string", header=True)) == {(1, "a b"), (2, None)}


def test_authors_sample_and_degrees(spark, hin):
    modes = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.0)], "id long, label string, share double")
    attributes = spark.createDataFrame([(1, 3), (2, 1), (9, 9)], "id long, hindex int")
    got = labels.author_table(modes, attributes, spark.createDataFrame([(1, 7)], "id long, degree long"))
    assert {(r.id, r.hindex, r.label, r.degree) for r in got.collect()} == {(1, 3, "a", 7), (2, 1, "b", 0)}
    many = spark.range(5000).select("id", F.lit(9).alias("degree"), F.when(F.col("id") % 2 == 0, 1).otherwise(5).alias("hindex"))
    picked = labels.outlier_labels(many).where("outlier").select("id").collect()
    assert all(r.id % 2 == 0 for r in picked) and 400 < len(picked) < 600
    degrees = metapath.projected_degrees(hin, parse_spec(PATHS, 4).metapaths[0][0])
    assert sum(r.n for r in metapath.degree_distribution(degrees).collect()) == 30


def test_prefix_filter_and_long_lists_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(u, t, str(v)) for u in range(80) for t in (1, 2) for v in rng.sample(range(12), rng.randint(0, 8))]
    nbr = spark.createDataFrame(rows, "u long, type int, v string")
    for measure in ("jaccard", "cosine", "overlap"):
        listed = pairs(similarity.similar_edges(nbr, {1: 0.5, 2: 0.4}, measure))
        monkeypatch.setattr(similarity, "WORDS", 0)
        assert pairs(similarity.similar_edges(nbr, {1: 0.5, 2: 0.4}, measure)) == listed
        monkeypatch.setattr(similarity, "LISTED", 0)
        assert pairs(similarity.similar_edges(nbr, {1: 0.5, 2: 0.4}, measure)) == listed
        monkeypatch.undo()


def test_level_clusters_keep_large_and_negative_ids(spark):
    ids = [-5, (1 << 60) + 1, 7]
    edges = spark.createDataFrame([(a, b, 0.5) for a in ids for b in ids], "u long, w long, s double")
    tau = index.k_thresholds_1d(edges, 2)
    got = index.level_clusters(edges, tau)
    assert {r.v for r in got.collect()} == set(ids) and {r.cid for r in got.collect()} == {-5}
