"""Searches from the query vertices outwards, against those over the whole type."""

import random

import pytest

from meshwork import api
from meshwork.operators import bounds, community, local, neighborhood, similarity
from meshwork.sources.hin import Hin
from meshwork.sources.spec import QuerySpec


def network(spark, links):
    """Items (type 0) that name tags (1) and users (2), users in towns (3): links by (type, number) pairs."""
    ids = sorted({x for pair in links for x in pair})
    source = {x: x[0] * 10_000 + x[1] for x in ids}
    vertices = spark.createDataFrame([(source[x], x[0]) for x in ids], "source_id long, type int")
    rows = [(source[a], source[b], 0) for a, b in links] + [(source[b], source[a], 1) for a, b in links]
    return Hin.from_tables(vertices, spark.createDataFrame(rows, "src long, dst long, edge_type int"))


def blobs(rng, n, size=6):
    """Groups of items that share tags and users, apart from each other."""
    links = set()
    for b in range(n):
        for i in range(size):
            item = (0, b * size + i)
            links |= {(item, (1, b * 4 + rng.randrange(3))) for _ in range(3)} | {(item, (2, b * 8 + rng.randrange(5))) for _ in range(4)}
        links |= {((2, b * 8 + u), (3, b * 2 + u % 2)) for u in range(5)}
    return sorted(links)


def answers(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("hops", "eps", "measure"), [(2, {2: 0.3, 3: 0.5}, "jaccard"), (1, {1: 0.6, 2: 0.5}, "cosine")])
def test_as_over_the_whole_type(spark, hops, eps, measure):
    hin = network(spark, blobs(random.Random(hops), 5) + [((0, 900 + i), (2, 900 + i % 2)) for i in range(5)])
    spec = QuerySpec(mu=3, hops=hops, query_type=0, n_queries=4, ids=(0, 7, 20, 31), eps=eps)
    got = answers(api.local_search(hin, spec, measure))
    assert got and got == answers(api.community_search(hin, spec, measure))


def test_rows_grow_with_the_answers(spark):
    """Four times the network around the same communities: not a pair, a neighbourhood or a vertex more."""
    done = []
    for n in (3, 12):
        hin = network(spark, blobs(random.Random(1), n))
        distance = neighborhood.schema_distance(hin, 0)
        queries = hin.of_type(0).where("source_id in (0, 8)").select("id")
        found = local.local_edges(hin, queries, 0, 1, {1: 0.4, 2: 0.3}, distance, 3)
        done.append((found.rounds, found.evaluated, found.neighbourhoods, found.compared))
    assert done[0] == done[1] and done[0][2] <= 12 and done[0][3] <= 30


def test_queries_without_an_answer(spark):
    hin = network(spark, [((0, 0), (1, 0)), ((0, 1), (1, 0)), ((0, 2), (1, 1)), ((0, 3), (2, 0))])
    spec = QuerySpec(mu=2, hops=1, query_type=0, n_queries=2, ids=(2, 3), eps={1: 0.5})
    assert answers(api.local_search(hin, spec)) == set()
    spec = QuerySpec(mu=2, hops=1, query_type=0, n_queries=2, ids=(0, 3), eps={1: 0.5})
    assert answers(api.local_search(hin, spec)) == {(0, 0, "c"), (0, 1, "c")}
    with pytest.raises(ValueError):
        api.local_search(hin, spec, "pathsim")


@pytest.mark.parametrize("measure", ["jaccard", "overlap"])
def test_bounded_cores(spark, measure):
    """Twins, one-valued types, empty sets and a neighbour of all: the cores of all similar pairs, from fewer of them."""
    rng = random.Random(4)
    sets = {u: {1: [u % 3] if u % 7 else [], 2: rng.sample(range(9), rng.randint(0, 4)) + [99], 3: rng.sample(range(5), rng.randint(0, 2))} for u in range(60)}
    sets |= {u: {1: [5], 2: [1, 2]} for u in range(100, 106)} | {200: {1: [0]}, 201: {1: [0]}, 202: {}}
    nbr = spark.createDataFrame([(u, t, str(v)) for u, by in sets.items() for t, vs in by.items() for v in vs], "u long, type int, v string")
    for eps in ({1: 0.5, 2: 0.4, 3: 0.3}, {1: 1.0})[: 2 if measure == "jaccard" else 1]:
        edges = similarity.similar_edges(nbr, eps, measure)
        got = bounds.bounded_cores(nbr, eps, 4, measure)
        assert answers(got.cores) == answers(community.core_vertices(edges, 4))
        assert got.verified <= got.formed
    got = bounds.bounded_cores(nbr, {2: 0.4}, 3, measure)
    if measure == "jaccard":
        assert got.verified < similarity.similar_edges(nbr, {2: 0.4}, measure).where("u < w").count()
