"""Vertices with the same neighbours are compared once; pairs of all that have them come from lists."""

import random

import pytest

from meshwork.operators import similarity

SIM = {"jaccard": lambda a, b: len(a & b) / len(a | b), "cosine": lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5, "overlap": lambda a, b: len(a & b) / min(len(a), len(b))}


@pytest.fixture(scope="module")
def sets():
    """Sixty vertices of eight kinds, some without any neighbour of a type, and two on their own."""
    rng = random.Random(3)
    kinds = [{1: {rng.randrange(3)} if i else set(), 2: set(rng.sample(range(6), rng.randint(0, 3)))} for i in range(8)]
    return {u: kinds[u % 8] for u in range(60)} | {60: {1: {0}, 2: {0, 1, 2, 3, 4, 5}}, 61: {1: {9}, 2: {9}}}


@pytest.fixture(scope="module")
def nbr(spark, sets):
    return spark.createDataFrame([(u, t, str(v)) for u, by in sets.items() for t, vs in by.items() for v in vs], "u long, type int, v string")


@pytest.fixture(autouse=True)
def compared(monkeypatch):
    """Lists of few vertices; and how many pairs are spread."""
    found, spread = [], similarity.spread
    monkeypatch.setattr(similarity, "SPREAD", 3)
    monkeypatch.setattr(similarity, "spread", lambda pairs, *a: found.append(pairs.count()) or spread(pairs, *a))
    return found


def like(a, b, measure="jaccard"):
    return 1.0 if not a and not b else 0.0 if not a or not b else SIM[measure](a, b)


@pytest.mark.parametrize("measure", SIM)
def test_pairs_that_share_a_neighbour(nbr, sets, compared, measure):
    got = {(r.u, r.w, r.type): r.s for r in similarity.similar_pairs(nbr, measure).collect()}
    want = {(u, w, t): like(sets[u][t], sets[w][t], measure) for u in sets for w in sets if u < w for t in (1, 2) if sets[u][t] & sets[w][t]}
    assert got == pytest.approx(want) and compared[0] < len(want) / 5


def test_mean_similarities(nbr, sets, compared):
    got = {(r.u, r.w): (r.x, r.y) for r in similarity.mean_similarities(nbr, [1, 2], {"jaccard": "x", "cosine": "y"}).collect()}
    pairs = [(u, w) for u in sets for w in sets if u < w and any(sets[u][t] & sets[w][t] for t in (1, 2))]
    want = {(u, w): tuple(sum(like(sets[u][t], sets[w][t], m) for t in (1, 2)) / 2 for m in ("jaccard", "cosine")) for u, w in pairs}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want) and compared[0] < len(want) / 5


@pytest.mark.parametrize("eps", [{1: 0.3, 2: 0.3}, {1: 0.9, 2: 1.0}])
def test_sums(nbr, sets, compared, eps):
    got = [tuple(r) for r in similarity.sum_edges(nbr, eps, 2).collect()]
    least = sum(eps.values()) - 1e-12
    want = {(u, w) for u in sets for w in sets if sets[u][2] & sets[w][2] and (u == w or sum(like(sets[u][t], sets[w][t]) for t in eps) >= least)}
    assert len(got) == len(set(got)) and set(got) == want and compared[0] < len(want) / 5
