"""Entries of the prefix join: as wide for many neighbours as for few, with signatures that never tell too little."""

import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators import bounds, community, similarity


def network(spark, seed, people=60, kinds=40):
    """(u, type, v): two keys and sets of up to 20 of ``kinds``, some of them nearly equal."""
    rng, sets = random.Random(seed), []
    for u in range(people):
        near = set(rng.choice(sets)) if sets and u % 3 else set()
        sets.append(set(list(near)[: rng.randint(8, 20)]) | {rng.randrange(kinds) for _ in range(rng.randint(1, 4))})
    rows = [(u, 1, f"k{u % 2}") for u in range(people) if u % 11] + [(u, 2, f"v{v}") for u, s in enumerate(sets) if u % 13 for v in s]
    return spark.createDataFrame(rows, "u long, type int, v string"), rows


def brute(rows, eps):
    sets = {}
    for u, t, v in rows:
        sets.setdefault(u, {1: set(), 2: set()})[t].add(v)
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    return {(u, w) for u in sets for w in sets if u == w or all(like(sets[u][t], sets[w][t]) >= e for t, e in eps.items())}


def test_entries_hold_no_lists(spark):
    nbr, _ = network(spark, 1, people=300, kinds=5_000)
    entries, sets = similarity._entered(nbr.where("type = 2").select("u", "v"), [], 0.3)
    assert not [f.name for f in entries.schema if f.dataType.typeName() == "array"]
    members = {r.u: set(r.vs) for r in sets.collect()}
    a, b = entries.select("u", "n", *[f"m{i}" for i in range(similarity.WORDS)]).distinct(), entries.distinct()
    b = b.select(*[b[c].alias(f"r_{c}") for c in b.columns if c != "v"]).distinct()
    met = a.crossJoin(b).select("u", "r_u", similarity.most_common(similarity.WORDS).alias("most")).collect()
    assert len(met) == len(members) ** 2
    assert all(r.most >= len(members[r.u] & members[r.r_u]) for r in met)
    assert sum(r.most < 5 for r in met) > len(met) / 2  # most of the pairs, of sets with little in common, are told apart


def test_pairs_and_cores_of_many_neighbours(spark):
    eps = {1: 0.3, 2: 0.4}
    for seed, kinds in ((2, 30), (3, 4_000)):
        nbr, rows = network(spark, seed, kinds=kinds)
        edges = similarity.similar_edges(nbr, eps)
        assert {tuple(r) for r in edges.collect()} == brute(rows, eps)
        cores = {r.u for r in community.core_vertices(edges, 3).collect()}
        assert cores and {r.u for r in bounds.bounded_cores(nbr, eps, 3).cores.collect()} == cores


def test_both_sides_of_the_prefix_join_are_one_exchange(spark):
    nbr, rows = network(spark, 4, people=200, kinds=300)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test = similarity._threshold({2: 0.4}, "jaccard")
        got = similarity._prefix_pairs(nbr.where("type = 2").select("u", "v"), [], 2, test, (0.4, 0.4))
        found = {tuple(r) for r in got.collect()}
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "ReusedExchange" in plan
    assert {(u, w) for u, w in brute([r for r in rows if r[1] == 2], {2: 0.4}) if u < w} <= found


@pytest.mark.parametrize("small", [True, False])
def test_rows_of_lists_are_not_broadcast(spark, monkeypatch, small):
    plans, kept = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, name="t", files=None: (name == "sets" and plans.append(df._jdf.queryExecution().sparkPlan().toString())) or kept(df, name, files))
    if not small:
        monkeypatch.setattr(similarity, "broadcast_if_small", lambda df: df)
    own = kept(spark.range(20).select(F.col("id").alias("u"), F.sequence(F.col("id") * 40, F.col("id") * 40 + 399).alias("l")), "own")
    _, sets = similarity._entered(own.select("u", F.explode("l").alias("v")), [], 0.5)
    assert sets.where("n = 400 and size(vs) = 400").count() == 20
    assert len(plans) == 1 and "BuildLeft" not in plans[0] and ("BuildRight" if small else "SortMergeJoin") in plans[0]
