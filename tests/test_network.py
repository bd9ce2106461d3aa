"""Hand-made networks with pencil-and-paper answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions.similarity import MEASURES, exists_above, level, vector_sum, vector_text
from meshwork.operators import community, index, labels, metapath, metrics, neighborhood, similarity
from meshwork.operators.components import connected_components
from meshwork.sources import hin as sources
from meshwork.sources.hin import Hin
from meshwork.sources.spec import MetaPath, parse_spec


def pairs(df):
    return {tuple(r) for r in df.collect()}


def nbr_of(spark, sets):
    """sets: {u: {type: members}}."""
    rows = [(u, t, str(v)) for u, by in sets.items() for t, vs in by.items() for v in vs]
    return spark.createDataFrame(rows, "u long, type int, v string")


def brute(sets, eps, measure="jaccard"):
    def sim(a, b):
        if not a and not b:
            return 1.0
        if not a or not b:
            return 0.0
        c = len(a & b)
        return {"jaccard": c / len(a | b), "cosine": c / (len(a) * len(b)) ** 0.5, "overlap": c / min(len(a), len(b))}[measure]

    own = [u for u, by in sets.items() if any(by.get(t) for t in eps)]
    return {(u, w) for u in own for w in own if u == w or all(sim(set(sets[u].get(t, ())), set(sets[w].get(t, ()))) >= e for t, e in eps.items())}


@pytest.mark.parametrize("seed", range(3))
def test_similar_edges_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    single = seed == 1
    sets = {u: {1: rng.sample(range(5), rng.randint(0, 1 if single else 4)), 2: rng.sample(range(8), rng.randint(0, 5)), 3: rng.sample(range(3), rng.randint(0, 1))} for u in range(40)}
    nbr = nbr_of(spark, sets)
    for measure in list(MEASURES)[: 3 if seed == 0 else 1]:
        for eps in ({1: 0.5, 2: 0.3}, {2: 0.4, 3: 1.0}, {3: 0.5}):
            assert pairs(similarity.similar_edges(nbr, eps, measure)) == brute(sets, eps, measure)


def test_common_vectors_equal_filtered_ones(spark):
    rng = random.Random(9)
    sets = {u: {1: rng.sample(range(3), rng.randint(0, 1)), 2: rng.sample(range(6), rng.randint(0, 3)), 3: rng.sample(range(4), rng.randint(0, 2))} for u in range(40)}
    nbr = nbr_of(spark, sets)
    plain = lambda df: {(r.u, r.w, tuple(r.vec)) for r in df.collect()}
    for types in ([1, 2, 3], [2, 3], [1, 3]):
        every = similarity.similarity_vectors(nbr, similarity.typed_similarity(nbr), types)
        assert plain(similarity.common_vectors(nbr, types)) == plain(index.common_vectors(every))
        eps = {types[0]: 0.4, types[-1]: 0.5}
        assert pairs(similarity.index_edges(every, types, eps)) >= brute(sets, eps) - {(u, u) for u in sets}


def test_empty_rules(spark):
    sets = {1: {1: [1]}, 2: {1: [1]}, 3: {1: [1], 2: [5]}, 4: {}, 5: {9: [1]}}
    assert pairs(similarity.similar_edges(nbr_of(spark, sets), {1: 0.5, 2: 0.5})) == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}
    with pytest.raises(ValueError):
        similarity.similar_edges(nbr_of(spark, sets), {1: 0.0})
    with pytest.raises(ValueError):
        similarity.similar_edges(nbr_of(spark, sets), {1: 0.1}, "dice")


def edge_frame(spark, links, vertices):
    e = {(a, b) for x, y in links for a, b in ((x, y), (y, x))} | {(v, v) for v in vertices}
    return spark.createDataFrame(sorted(e), "u long, w long")


def test_self_counts_shared_border_and_hub(spark):
    clique = lambda vs: list(itertools.combinations(vs, 2))
    links = clique([1, 2, 3]) + clique([11, 12, 13]) + [(3, 20), (13, 20)]
    e = edge_frame(spark, links, [1, 2, 3, 11, 12, 13, 20, 30])
    assert pairs(community.core_vertices(e, 4)) == {(3,), (13,)}
    got = pairs(community.membership(e, 3))
    assert {(20, 1, "c"), (1, 1, "c")} <= got
    e = edge_frame(spark, clique([1, 2, 3, 4]) + clique([11, 12, 13, 14]) + [(4, 20), (14, 20)], [*range(1, 5), *range(11, 15), 20])
    got = pairs(community.membership(e, 4))
    assert {(20, 1, "n"), (20, 11, "n")} <= got and len(got) == 10
    q = spark.createDataFrame([(1,), (20,), (99,)], "id long")
    assert pairs(community.search(spark.createDataFrame(sorted(got), "v long, cid long, role string"), q)) == pairs(community.expand_search(e, 4, q))
    sets = {1: {1: ["a"]}, 2: {1: ["b"]}, 3: {1: ["a", "b"]}, 4: {1: ["a"]}, 5: {1: ["z"]}}
    members = spark.createDataFrame([(1, 1, "c"), (2, 2, "c")], "v long, cid long, role string")
    vertices = spark.createDataFrame([(i,) for i in range(1, 7)], "u long")
    assert pairs(community.roles(nbr_of(spark, sets), vertices, members, [1])) == {(3, "h"), (4, "o"), (5, "o"), (6, "o")}


def peel(adj, k):
    alive = set(adj)
    while bad := {u for u in alive if len(adj[u] & alive) < k}:
        alive -= bad
    return alive


def test_k_core_and_thresholds_equal_peeling(spark):
    rng = random.Random(3)
    n = 24
    s = {}
    for u in range(n):
        s[u, u] = (1.0, 1.0)
        for w in range(u):
            if rng.random() < 0.35:
                s[u, w] = s[w, u] = (rng.randint(1, 10) / 10, rng.randint(1, 10) / 10)
    vectors = spark.createDataFrame([(u, w, list(v)) for (u, w), v in s.items()], "u long, w long, vec array<double>")
    k = 4

    def core(a, b):
        adj = {u: set() for u in range(n)}
        for (u, w), (x, y) in s.items():
            if x >= a / 10 and y >= b / 10:
                adj[u].add(w)
        return peel(adj, k)

    assert {r[0] for r in pairs(community.k_core(vectors.select("u", "w"), k))} == core(0, 0)
    one = dict(index.k_thresholds_1d(vectors.select("u", "w", F.col("vec")[0].alias("s")), k).collect())
    for lv in range(11):
        assert {v for v, t in one.items() if t >= lv * 10} == core(lv, 0)
    two = index.k_thresholds(vectors, k, 2)
    for a, b in itertools.product(range(1, 11, 3), repeat=2):
        assert {r[0] for r in index.index_cores(two, [a / 10, b / 10]).collect()} == core(a, b)
    q = spark.createDataFrame([(u,) for u in range(n)], "id long")
    found = {}
    for a, b in pairs(community.k_core_search(vectors.select("u", "w"), k, q)):
        found.setdefault(a, set()).add(b)
    assert set(found) == core(0, 0) and all(a in b for a, b in found.items())


def test_level_tree(spark):
    s = {}
    for group, x in (((1, 2, 3), 0.9), ((4, 5, 6), 0.7)):
        for a, b in itertools.product(group, repeat=2):
            s[a, b] = 1.0 if a == b else x
    s[3, 4] = s[4, 3] = 0.5
    edges = spark.createDataFrame([(a, b, x) for (a, b), x in s.items()], "u long, w long, s double")
    tau = index.k_thresholds_1d(edges, 3)
    assert pairs(tau) == {(1, 90), (2, 90), (3, 90), (4, 70), (5, 70), (6, 70)}
    levels = index.level_clusters(edges, tau)
    assert pairs(levels.where("lv = 70")) == {(70, v, 1 if v < 4 else 4) for v in range(1, 7)}
    assert pairs(index.level_tree(levels)) == {(90, 1, 3, None, None), (70, 4, 3, None, None)}
    assert pairs(index.tree_query(levels, edges, tau, 0.8)) == {(1, 1, True), (2, 1, True), (3, 1, True)}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 100), (60, 61), (None, 3)], "a long, b long")
    got = dict(connected_components(e).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 60: 60, 61: 60}
    assert connected_components(e.limit(0)).count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Two authors (type 0), two papers (1), one venue (2), in text files; a parallel edge."""
    folder = tmp_path_factory.mktemp("net")
    (folder / "vertex.txt").write_text("10 0\n11 0\n20 5\n21 5\n30 7\n")
    links = [(10, 20), (10, 20), (11, 20), (11, 21), (20, 30), (21, 30)]
    kinds, rows = [], {}
    for i, (a, b) in enumerate(links):
        kinds += [f"{2 * i} {0 if a < 20 else 2}", f"{2 * i + 1} {1 if a < 20 else 3}"]
        rows.setdefault(a, []).append(f"{b} {2 * i}")
        rows.setdefault(b, []).append(f"{a} {2 * i + 1}")
    (folder / "edge.txt").write_text("\n".join(kinds) + "\n")
    (folder / "graph.txt").write_text("\n".join(f"{a} {' '.join(x)}" for a, x in rows.items()) + "\n")
    return Hin.from_files(spark, str(folder))


def test_ingestion_and_traversal(spark, small, tmp_path):
    assert pairs(small.vertices) == {(0, 10, 0), (1, 11, 0), (2, 20, 1), (3, 21, 1), (4, 30, 2)}
    assert small.edges.count() == 12 and pairs(small.schema()) == {(0, 1, 4), (1, 0, 4), (1, 2, 2), (2, 1, 2)}
    assert neighborhood.schema_distance(small, 0) == {0: 0, 1: 1, 2: 2}
    assert neighborhood.generating_type({0: 0, 1: 1, 2: 1}, [1, 2]) == 2
    seeds = small.of_type(0).select("id")
    hops = [pairs(neighborhood.d_hop(small, seeds, d)) for d in range(3)]
    assert hops[0] == {(0, 0, 0), (1, 0, 1)} and (0, 2, 4) in hops[2] and (0, 2, 4) not in hops[1] and (0, 0, 1) in hops[2]
    path = MetaPath.parse("0 -1 1 -1 0")
    assert pairs(metapath.path_counts(small, path)) == {(0, 0, 4), (0, 1, 2), (1, 0, 2), (1, 1, 2)}
    assert pairs(metapath.pathsim_pairs(small, [path])) == {(0, 0, 1.0), (1, 1, 1.0), (0, 1, 4 / 6), (1, 0, 4 / 6)}
    assert pairs(metapath.pathsim_edges(small, [(path, 0.7)])) == {(0, 0), (1, 1)}
    assert pairs(metapath.project(small, path)) == {(0, 1), (1, 0)}
    s = {(r.a, r.b): r.s for r in metapath.hetesim(small, path).collect()}
    assert s[0, 0] == 1.0 and abs(s[0, 1] - 2 / (2 * 2) ** 0.5 / 1) < 1e-12
    assert metapath.hetesim(small, MetaPath((0, 1, 0), (0, 1))).where("a <> b").count() == 0
    small.save(str(tmp_path / "p"))
    again = Hin.load(spark, str(tmp_path / "p"))
    assert pairs(again.vertices) == pairs(small.vertices) and again.edges.select(small.edges.columns).exceptAll(small.edges).isEmpty()
    small.export_text(str(tmp_path / "t"))
    assert {r.value for r in spark.read.text(str(tmp_path / "t" / "vertex_map")).collect()} == {"0 10 0", "1 11 0", "2 20 1", "3 21 1", "4 30 2"}
    sources.write_projection(metapath.project(small, path), str(tmp_path / "h"))
    assert pairs(sources.read_adjacency(spark, str(tmp_path / "h"))) == {(0, 1), (1, 0)} and pairs(sources.read_degrees(spark, str(tmp_path / "h"))) == {(0, 1), (1, 1)}


def test_bad_networks(spark):
    v = spark.createDataFrame([(1, 0), (2, 0)], "source_id long, type int")
    e = lambda rows: spark.createDataFrame(rows, "src long, dst long, edge_type int")
    with pytest.raises(ValueError, match="unknown"):
        Hin.from_tables(v, e([(1, 9, 0)]))
    with pytest.raises(ValueError, match="one end"):
        Hin.from_tables(v, e([(1, 2, 0)]))


def test_specification():
    s = parse_spec("5\n2\n1 100\n-1\n-1 0.2\n", 4)
    assert (s.mu, s.hops, s.query_type, s.n_queries, s.unit_eps) == (5, 2, 1, 100, 0.2)
    assert s.thresholds({0: 1, 1: 0, 2: 2, 3: 3}) == {0: 0.2, 2: 0.2}
    s = parse_spec("3\n1\n0 2\n7 8\n-4 2\n1 0.5\n2 0\n1\n0 -1 1 -1 0\n0.4\n", 3)
    assert s.ids == (7, 8) and s.thresholds({}) == {1: 0.5} and s.metapaths == ((MetaPath((0, 1, 0), (-1, -1)), 0.4),)
    for bad in ("0\n1\n0 1\n-1\n-1 .2", "1\n9\n0 1\n-1\n-1 .2", "1\n1\n0 1\n-1\n0 2.0"):
        with pytest.raises(ValueError):
            parse_spec(bad, 3)
    with pytest.raises(ValueError):
        MetaPath((1, 2), (1, 2))


def test_scalars(spark):
    df = spark.createDataFrame([(0.29, [0.2, 0.5], [[0.1, 0.9], [0.3, 0.5]])], "s double, v array<double>, ts array<array<double>>")
    r = df.select(level(F.col("s")), vector_sum(F.col("v")), vector_text(F.col("v")), exists_above(F.col("ts"), F.col("v"))).first()
    assert tuple(r) == (29, 0.7, "0.2 0.5", True)
    assert [x[0] for x in spark.createDataFrame([(i / 100,) for i in range(101)], "s double").select(level(F.col("s"))).collect()] == list(range(101))


def test_metrics(spark):
    e = edge_frame(spark, [(1, 2), (2, 3), (3, 4)], [1, 2, 3, 4])
    m = spark.createDataFrame([(v, 1, "c") for v in range(1, 5)], "v long, cid long, role string")
    assert pairs(metrics.diameter(e, m)) == {(1, 3)} and pairs(metrics.density(e, m)) == {(1, 4, 4, 10, 2.5)}
    tri = spark.createDataFrame([(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b] + [(4, 1)], "u long, w long")
    assert pairs(metrics.clustering(tri, m)) == {(1, 0.75)}
    pred = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, cluster_id string")
    truth = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (9, "o")], "id long, cluster_id string")
    assert pairs(metrics.best_match_f1(pred, truth)) == {("a", 0.8), ("b", 0.5)}
    assert pairs(metrics.outlier_f1(pred, truth)) == {(0.0,)}
    assert abs(metrics.mean_f1(pred, truth).first()[0] - 1.3 / 3) < 1e-12
    assert [r.cluster_id for r in metrics.top_f1(pred, truth, 2).collect()] == ["a", "b"]


def test_labels(spark):
    a = spark.createDataFrame([(1, [5, 6, 7]), (2, [9])], "a long, topics array<long>")
    c = spark.createDataFrame([(5, 1), (6, 1), (7, 0)], "id long, cluster int")
    assert pairs(labels.modal_cluster(a, c)) == {(1, 1, 0.67), (2, 2, 0.0)}
    rows = spark.createDataFrame([("l", ["b", "a"]), ("l", ["a"]), (None, ["z"])], "k string, t array<string>")
    assert {(r.k, tuple(r.t)) for r in labels.merge_topics(rows, "k", "t").collect()} == {("l", ("a", "b")), ("None", ("z",))}
    assert pairs(labels.renumber(spark.createDataFrame([("a", 3), ("b", 0)], "l string, c int"), "l", "c").select("l", "c", "global_id")) == {("a", 3, 0), ("b", 0, 1)}
