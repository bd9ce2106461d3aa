"""Pairs that are surely similar are left out where communities don't need them, and only these."""

import random

import pytest

from meshwork.operators import community, similarity
from meshwork.session import materialize


def network(spark, seed, people=90):
    """(u, type, v): keys of three groups, and sets of which most hold their group's members, with more of their own, few or many."""
    rng = random.Random(seed)
    rows = []
    for u in range(people):
        g = u % 3
        own = {f"g{g}-{i}" for i in range(12) if rng.random() < (0.95 if u % 5 else 0.4)} if u % 7 else set()
        own |= {f"x{rng.randrange(60)}" for _ in range(rng.choice((0, 1, 3, 20, 60)))} if u % 11 else set()
        rows += [(u, 1, f"k{g}")] * (u % 13 > 0) + [(u, 2, v) for v in own]
    return spark.createDataFrame(rows, "u long, type int, v string")


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("measure", "eps", "mu"), [("jaccard", {1: 0.3, 2: 0.3}, 3), ("cosine", {1: 0.3, 2: 0.5}, 3), ("cosine", {2: 0.5}, 6), ("overlap", {1: 0.5}, 2)])
def test_communities_and_cores_are_the_same(spark, measure, eps, mu):
    nbr = network(spark, 1)
    every, some = (materialize(similarity.similar_edges(nbr, eps, measure, n)) for n in (None, mu))
    assert rows(some) <= rows(every)  # without keys no member is in half of the sets, and no pair is left out
    assert rows(community.membership(some, mu)) == rows(community.membership(every, mu))
    assert rows(community.k_core(some, mu)) == rows(community.k_core(every, mu))


def test_rows_joined_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LISTED", 3)
    nbr, eps = network(spark, 2), {1: 0.3, 2: 0.4}
    every, some = similarity.similar_edges(nbr, eps), similarity.similar_edges(nbr, eps, enough=3)
    assert rows(some) < rows(every)
    assert rows(community.membership(some, 3)) == rows(community.membership(every, 3))


def test_pairs_of_a_group_grow_with_its_vertices(spark, monkeypatch):
    found = {}
    for n in (100, 400):
        shared = [(u, t, f"{t}-{i}") for u in range(n) for t, k in ((1, 1), (2, 20)) for i in range(k)]
        nbr = spark.createDataFrame(shared + [(u, 2, f"own{u}") for u in range(n)], "u long, type int, v string")
        with monkeypatch.context() as m:
            m.setattr(similarity, "_prefix_pairs", None)  # no pair is formed to be tested
            edges = similarity.similar_edges(nbr, {1: 0.3, 2: 0.3}, enough=3)
        found[n] = edges.count()
        assert {r.role for r in community.membership(edges, 3).collect()} == {"c"}
    assert found == {n: 7 * n - 12 for n in (100, 400)}  # itself, and a pair with each of three, both ways
