"""Meta-path operators form no more pairs, and send no more rows of them, than they return."""

import pytest

from meshwork.operators import metapath
from meshwork.sources.hin import Hin
from meshwork.sources.spec import MetaPath

BY_HUB, BY_ORDER = MetaPath((0, 1, 0), (-1, -1)), MetaPath((0, 2, 0), (-1, -1))


@pytest.fixture(scope="module")
def hin(spark):
    """Twelve vertices of one hub each, of two, all but two of them on orders (a parallel edge too)."""
    vertices = [(v, 0) for v in range(12)] + [(100, 1), (101, 1)] + [(200 + o, 2) for o in range(6)]
    links = [(v, 100 + v % 2, 0) for v in range(11)] + [(v, 200 + (v * k) % 6, 2) for v in range(10) for k in (1, 2)] + [(3, 203, 2)]
    edges = [e for a, b, t in links for e in ((a, b, t), (b, a, t + 1))]
    return Hin.from_tables(spark.createDataFrame(vertices, "source_id long, type int"), spark.createDataFrame(edges, "src long, dst long, edge_type int"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pairs(hin, path):
    return {(r.u, r.w): r.cnt for r in metapath.path_counts(hin, path).collect()}


def test_pairs_of_a_hub_are_not_compared_with_each_other(hin):
    got = metapath.induced_neighbours(hin, [BY_HUB])
    assert "Aggregate" not in plan(got)
    assert sorted((r.u, r.w) for r in got.collect()) == sorted(pairs(hin, BY_HUB))
    both = metapath.induced_neighbours(hin, [BY_ORDER, BY_HUB]).collect()
    assert sorted((r.u, r.w) for r in both) == sorted(set(pairs(hin, BY_HUB)) | set(pairs(hin, BY_ORDER)))


def test_mean_pathsim_forms_no_pairs(spark, hin, monkeypatch):
    members = spark.createDataFrame([(v, v // 6) for v in range(12)] + [(1, 1)], "v long, cid long")
    want = {}
    every = {(r.u, r.w): r.s for r in metapath.pathsim_pairs(hin, [BY_HUB, BY_ORDER]).collect()}
    for cid in (0, 1):
        m = {r.v for r in members.where(f"cid = {cid}").collect()}
        want[cid] = sum(1.0 if u == w else every.get((u, w), 0.0) for u in m for w in m) / len(m) ** 2
    monkeypatch.setattr(metapath, "pathsim_pairs", None)
    got = {r.cid: r.avg_pathsim for r in metapath.mean_pathsim(hin, [BY_HUB, BY_ORDER], members).collect()}
    assert got == pytest.approx(want)


def test_hetesim_counts_a_pair_once(hin):
    got = metapath.hetesim(hin, BY_ORDER)
    assert "LeftSemi" not in plan(got)
    s = {(r.a, r.b): r.s for r in got.collect()}
    counts, own = pairs(hin, BY_ORDER), {r.src: r.n for r in hin.edges.where("src_type = 0 and dst_type = 2").groupBy("src").count().withColumnRenamed("count", "n").collect()}
    assert s == pytest.approx({(a, b): c / (own[a] * own[b]) ** 0.5 for (a, b), c in counts.items() if a != b} | {(r.id, r.id): 1.0 for r in hin.of_type(0).collect()})


def test_discovery_reads_the_types_of_its_paths(hin):
    assert "src_type" in plan(metapath.discover(hin, 1))
    assert metapath.discover(hin, 1).collect()[0].cnt > 0
