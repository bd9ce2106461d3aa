"""Triangles by degree order, contracted components and exact diameters, against brute force."""

import itertools
import random

import pytest

from meshwork.operators import components, metapath, metrics, triangles, unionfind
from meshwork.operators.diameter import STARTS, exact_diameter, induced, linked
from meshwork.sources.spec import MetaPath

from test_api import hin  # noqa: F401


def frame(spark, links):
    return spark.createDataFrame(sorted(links), "u long, w long")


def members_of(spark, groups):
    return spark.createDataFrame([(v, c, "c") for c, vs in groups.items() for v in vs], "v long, cid long, role string")


def closed(edges):
    out = {u: {w for a, w in edges if a == u} for u, _ in edges}
    return {u: t for u, near in out.items() if (t := sum((x, y) in edges for x in near for y in near if x < y))}


@pytest.mark.parametrize("seed", range(4))
def test_closed_pairs_of_directed_edges_with_loops(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(60)}
    if seed % 2:
        edges |= {(b, a) for a, b in edges}
    rows = spark.createDataFrame([(7, u, w) for u, w in edges], "cid long, u long, w long")
    assert {r.u: r.t for r in triangles.closed_pairs(rows).collect()} == closed(edges)


def test_a_hub_is_no_pair_of_all_its_neighbours(spark):
    """A star of 300 and one triangle at its hub: one wedge, where the hub has 44,850 pairs of neighbours."""
    star = [(0, i) for i in range(1, 301)] + [(1, 2)]
    edges = spark.createDataFrame([(1, *e) for a, b in star for e in ((a, b), (b, a))], "cid long, u long, w long")
    assert triangles.wedges(triangles.oriented(edges)).count() == 1
    assert {r.u: r.t for r in triangles.closed_pairs(edges).collect()} == {0: 1, 1: 1, 2: 1}


def test_clustering_without_edges(spark):
    assert [tuple(r) for r in metrics.clustering(frame(spark, []), members_of(spark, {3: [1, 2]})).collect()] == [(3, 0.0)]


def rows_of_rounds(monkeypatch, run):
    """What ``run`` returns, and the rows that the rounds of stars went through."""
    seen, plain = [], components._digest
    monkeypatch.setattr(components, "_digest", lambda e: seen.append(plain(e)) or seen[-1])
    found = {tuple(r) for r in run().collect()}
    monkeypatch.undo()
    return found, sum(d[0] for d in seen)


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(3000)], list(itertools.combinations(range(120), 2))], ids=["path", "clique"])
def test_contracted_components_shuffle_less(spark, monkeypatch, links):
    edges = spark.createDataFrame(links, "a long, b long").repartition(3, "a") if len(links) > 5000 else spark.createDataFrame(links, "a long, b long").coalesce(3)
    plain, before = rows_of_rounds(monkeypatch, lambda: components.connected_components(edges))
    contracted, after = rows_of_rounds(monkeypatch, lambda: unionfind.contracted_components(edges))
    assert contracted == plain and len({c for _, c in plain}) == 1
    assert after < before


def test_contracted_components_odd_inputs(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(None, 3), (4, None), (500, 500), (500, 500), (-7, -(2**62))]
    edges = spark.createDataFrame(links, "a long, b long").repartition(3)
    want = {tuple(r) for r in components.connected_components(edges).collect()}
    assert {tuple(r) for r in unionfind.contracted_components(edges).collect()} == want
    assert unionfind.contracted_components(edges.limit(0)).count() == 0


def test_a_full_task_sends_on_what_it_has(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(unionfind, "GATHERED", 8)
    monkeypatch.setattr(unionfind, "KEPT", 4)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 5)), pa.array(range(i + 1, i + 6))], ["a", "b"]) for i in range(0, 40, 5)]
    got = [p for b in unionfind._forest(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    nodes, roots = unionfind.contract(np.array([a for a, _ in got]), np.array([b for _, b in got]))
    assert nodes.tolist() == list(range(41)) and set(roots.tolist()) == {0}


def distances(links, vs):
    """The greatest distance between linked vertices."""
    near = {v: {b for a, b in links if a == v and b in vs} | {a for a, b in links if b == v and a in vs} for v in vs}
    best = 0
    for s in vs:
        seen, now, d = {s}, {s}, 0
        while now := {w for v in now for w in near[v]} - seen:
            seen |= now
            d += 1
        best = max(best, d)
    return best


def test_exact_diameters(spark):
    rng = random.Random(8)
    groups = {1: range(40), 2: range(30, 60), 3: [70, 71], 4: [80], 5: range(100, 125)}
    links = [(i, i + 1) for i in range(24)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 100 + (i + 1) % 25) for i in range(25)] + [(80, 80)]
    got = {r.cid: r.diameter for r in exact_diameter(linked(frame(spark, links)), members_of(spark, groups)).collect()}
    assert got == {c: distances(links, set(vs)) for c, vs in groups.items()}


def test_bounds_close_most_starts(spark):
    """A broom, a path of 10 with 200 leaves at its end: less than a tenth of its members start. A ring needs them all."""
    broom = [(i, i + 1) for i in range(9)] + [(9, 100 + i) for i in range(200)]
    ring = [(1000 + i, 1000 + (i + 1) % 15) for i in range(15)]
    for links, diameter, most in ((broom, 10, 21), (ring, 7, 15)):
        counted, vs = [], {v for e in links for v in e}
        got = exact_diameter(linked(frame(spark, links)), members_of(spark, {1: vs}), counted)
        assert [tuple(r) for r in got.collect()] == [(1, diameter)]
        assert sum(counted) <= most and all(k <= STARTS for k in counted)


def test_diameter_over_metapaths_equals_that_over_their_pairs(spark, hin):  # noqa: F811
    paths = [MetaPath((1, 0, 1), (-1, -1))]
    ids = sorted(r.id for r in hin.of_type(1).collect())
    members = members_of(spark, {1: ids, 2: ids[:9], 3: ids[20:]})
    pairs = [(r.u, r.w) for r in metapath.induced_neighbours(hin, paths).collect()]
    want = {1: distances(pairs, set(ids)), 2: distances(pairs, set(ids[:9])), 3: distances(pairs, set(ids[20:]))}
    for chains in (induced(hin, paths), linked(metapath.induced_neighbours(hin, paths)), induced(hin, [MetaPath((1, 0, 1), (1, 0))])):
        assert {r.cid: r.diameter for r in exact_diameter(chains, members).collect()} == want


def test_diameter_without_members(spark):
    assert exact_diameter(linked(frame(spark, [(1, 2)])), members_of(spark, {})).count() == 0
