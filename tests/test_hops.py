"""Sizes of two-hop neighbourhoods counted by hubs, and searches that reach the compared types only."""

import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators import neighborhood
from meshwork.sources.hin import Hin


def rows(df):
    return {tuple(r) for r in df.collect()}


def random_network(spark, seed):
    """Types 0 (40), 1 (30), 2 (3), which many of type 0 and 1 share, and an isolated vertex."""
    rng = random.Random(seed)
    links = [(u, 100 + rng.randrange(30), 0) for u in range(40) for _ in range(3)]
    links += [(u, 200 + h, 2) for u in range(40) for h in rng.sample(range(3), rng.randint(0, 2))] + [(100 + v, 200 + rng.randrange(3), 4) for v in range(30)]
    edges = links + [(b, a, t + 1) for a, b, t in links]
    vertices = [(u, 0) for u in range(41)] + [(100 + v, 1) for v in range(30)] + [(200 + h, 2) for h in range(3)]
    return Hin.from_tables(spark.createDataFrame(vertices, "source_id long, type int"), spark.createDataFrame(edges, "src long, dst long, edge_type int"))


@pytest.mark.parametrize("seed", range(2))
def test_sizes_by_hubs_equal_listed_ones(spark, monkeypatch, seed):
    hin = random_network(spark, seed)
    for kind in (0, 2):
        seeds = hin.of_type(kind)
        want = rows(neighborhood.d_hop(hin, seeds, 2).groupBy("u", "type").agg(F.count("*").alias("n")).select("u", "type", "n"))
        for hub in (4, 1_000):
            monkeypatch.setattr(neighborhood, "HUB", hub)
            assert rows(neighborhood.two_hop_sizes(hin, seeds).select("u", "type", "n")) == want


def test_a_hub_is_counted_and_not_listed(spark, monkeypatch):
    """A nation of 300 customers: no table in between holds their 90,000 pairs."""
    n, links = 300, []
    links = [(u, 1_000, 0) for u in range(n)]
    edges = links + [(b, a, 1) for a, b, _ in links]
    vertices = [(u, 0) for u in range(n)] + [(1_000, 1)]
    hin = Hin.from_tables(spark.createDataFrame(vertices, "source_id long, type int"), spark.createDataFrame(edges, "src long, dst long, edge_type int"))
    seen, plain = [], neighborhood.materialize
    monkeypatch.setattr(neighborhood, "materialize", lambda df, *a: seen.append(plain(df, *a)) or seen[-1])
    got = rows(neighborhood.two_hop_sizes(hin, hin.of_type(0)).select("u", "type", "n"))
    assert got == {(u, t, k) for u in range(n) for t, k in ((0, n), (1, 1))}
    assert seen and all(x.count() <= 2 * n for x in seen)


def test_last_hop_to_the_types_asked_for(spark):
    hin = random_network(spark, 5)
    seeds = hin.of_type(0)
    for types in ([1], [2, 0]):
        got = neighborhood.d_hop(hin, seeds, 2, types)
        assert rows(got) == rows(neighborhood.d_hop(hin, seeds, 2).where(F.col("type").isin(*types)))


def test_the_first_hop_shuffles_the_edges_of_the_seeds_types_once(spark, tmp_path):
    random_network(spark, 3).save(str(tmp_path / "n"))
    hin = Hin.load(spark, str(tmp_path / "n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = neighborhood.d_hop(hin, hin.of_type(1), 1)
        plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("Exchange hashpartitioning") <= 3  # seeds, deduplicated, and their edges
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    near = {(r.src, r.dst_type, r.dst) for r in hin.edges.where("src_type = 1").collect()}
    assert rows(got) == near | {(r.id, 1, r.id) for r in hin.of_type(1).collect()}
