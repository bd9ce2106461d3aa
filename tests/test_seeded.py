"""Path similarity of given vertices, against that of all pairs."""

import random

import pytest

from meshwork import api
from meshwork.operators import metapath, seeded
from meshwork.sources.hin import Hin
from meshwork.sources.spec import MetaPath, QuerySpec, parse_spec

from test_api import PATHS, hin  # noqa: F401

ANY = MetaPath((1, 0, 1), (-1, -1))
LONG = MetaPath((1, 0, 3, 0, 1), (-1, -1, -1, -1))
TYPED = MetaPath((1, 0, 1), (0, 1))
BY_TYPE = MetaPath((1, 2, 1), (-1, -1))


def pairs(df):
    return {tuple(r) for r in df.collect()}


def near(df, ids=None):
    return {(r[0], r[1]): round(r[2], 9) for r in df.collect() if ids is None or r[0] in ids}


@pytest.fixture(scope="module")
def seeds(spark, hin):  # noqa: F811
    ids = sorted(r.id for r in hin.of_type(1).collect())[::7]
    return ids, spark.createDataFrame([(i,) for i in ids + ids[:1]], "id long")


@pytest.mark.parametrize("path", [ANY, LONG, TYPED, MetaPath((1, 0, 3), (-1, -1)), MetaPath((1, 0, 3, 0), (-1, -1, -1))])
def test_counts_met_in_the_middle(spark, hin, seeds, path):  # noqa: F811
    ids, frame = seeds
    every = {k: int(v) for k, v in near(metapath.path_counts(hin, path)).items()}
    want = {k: v for k, v in every.items() if k[0] in ids}
    asked = spark.createDataFrame([*list(want)[::2], (ids[0], -5)], "u long, w long")
    assert {(r.u, r.w): r.cnt for r in seeded.pair_counts(hin, path, asked).collect()} == {k: want[k] for k in list(want)[::2]}
    assert {r.u: r.cost for r in seeded.path_costs(hin, path, frame).collect()} == {u: sum(v for (a, _), v in want.items() if a == u) for u in ids}
    own = {r.u: r.own for r in seeded.own_counts(hin, path, frame).collect()}
    assert own == {u: v for (u, w), v in want.items() if u == w}


@pytest.mark.parametrize("paths", [[(ANY, 0.05), (BY_TYPE, 0.2)], [(BY_TYPE, 0.2), (LONG, 0.1), (ANY, 0.3)], [(LONG, 0.2)]])
def test_similar_pairs_of_seeds(hin, seeds, paths):  # noqa: F811
    ids, frame = seeds
    want = {p for p in pairs(metapath.pathsim_edges(hin, paths)) if p[0] in ids}
    assert want and pairs(seeded.seeded_pathsim(hin, paths, frame)) == want
    want = {p for p in pairs(metapath.hetesim_edges(hin, paths)) if p[0] in ids}
    assert want and pairs(seeded.seeded_hetesim_edges(hin, paths, frame)) == want


@pytest.mark.parametrize("path", [ANY, LONG, TYPED, MetaPath((1, 0, 3, 0), (-1, -1, -1)), MetaPath((1, 0, 3), (-1, -1))])
def test_hetesim_of_seeds(spark, hin, seeds, path):  # noqa: F811
    ids, frame = seeds
    every = near(metapath.hetesim(hin, path).select("a", "b", "s"), ids)
    assert every
    assert near(seeded.seeded_hetesim(hin, path, frame)) == every
    some = sorted({b for _, b in every})[::2]
    rights = spark.createDataFrame([(i,) for i in some], "id long")
    assert near(seeded.seeded_hetesim(hin, path, frame, rights)) == {k: v for k, v in every.items() if k[1] in some}


def test_searches_walk_to_the_same_communities(hin):  # noqa: F811
    spec = parse_spec(PATHS, 4)
    for measure in ("pathsim", "hetesim"):
        want = pairs(api.community_search(hin, spec, measure))
        assert want and pairs(api.path_search(hin, spec, measure)) == want
    with pytest.raises(ValueError):
        api.path_search(hin, spec, "jaccard")
    with pytest.raises(ValueError):
        api.path_search(hin, QuerySpec(mu=2, hops=1, query_type=1, n_queries=1, ids=(0,), eps={0: 0.5}), "pathsim")


def groups(spark, n):
    """``n`` groups of 6 authors (0) that write 8 papers (1) in one of 2 venues (2), and one venue of all papers."""
    rng, links = random.Random(2), set()
    for g in range(n):
        for a in range(6):
            links |= {((0, g * 6 + a), (1, g * 8 + rng.randrange(8))) for _ in range(3)}
        links |= {((1, g * 8 + p), (2, g * 2 + p % 2)) for p in range(8)} | {((1, g * 8 + p), (2, 9_000)) for p in range(8)}
    source = lambda x: x[0] * 10_000 + x[1]
    ids = sorted({x for e in links for x in e})
    rows = [(source(a), source(b), 0) for a, b in sorted(links)] + [(source(b), source(a), 1) for a, b in sorted(links)]
    return Hin.from_tables(spark.createDataFrame([(source(x), x[0]) for x in ids], "source_id long, type int"), spark.createDataFrame(rows, "src long, dst long, edge_type int"))


def test_the_cheaper_path_gives_the_candidates(spark, monkeypatch):
    """By venue every author is linked with all: candidates come by paper, and counted pairs don't grow with the network."""
    by_paper, by_venue = MetaPath((0, 1, 0), (-1, -1)), MetaPath((0, 1, 2, 1, 0), (-1, -1, -1, -1))
    made = []
    for n in (2, 8):
        net, rows = groups(spark, n), []
        ids = [r.id for r in net.of_type(0).where("source_id in (0, 3)").collect()]
        frame = spark.createDataFrame([(i,) for i in ids], "id long")
        assert {r.at for r in seeded.cheapest_path(net, [by_venue, by_paper], frame).collect()} == {1}
        plain = seeded.settle
        monkeypatch.setattr(seeded, "settle", lambda df, name="t", guess=0, plain=plain, rows=rows: (lambda got: rows.append(got[1]) or got)(plain(df, name, guess)))
        got = pairs(seeded.seeded_pathsim(net, [(by_venue, 0.01), (by_paper, 0.2)], frame))
        monkeypatch.undo()
        assert got == {p for p in pairs(metapath.pathsim_edges(net, [(by_venue, 0.01), (by_paper, 0.2)])) if p[0] in ids}
        made.append(max(rows))
    assert made[0] == made[1] <= 12


def test_seeds_without_instances(spark, hin):  # noqa: F811
    none = spark.createDataFrame([(-1,)], "id long")
    assert pairs(seeded.seeded_pathsim(hin, [(ANY, 0.1), (BY_TYPE, 0.1)], none)) == set()
    assert pairs(seeded.seeded_hetesim_edges(hin, [(ANY, 0.1)], none)) == set()
    assert pairs(seeded.seeded_pathsim(hin, [(ANY, 0.1)], none.limit(0))) == set()
    assert pairs(seeded.walked_edges(hin, [(ANY, 0.1)], none.limit(0), 2, "pathsim")) == set()
