"""Similarity vectors, dominance ranks and thresholds from fewer rows, against brute force."""

import random
import re

from meshwork.operators import index, similarity


def network(spark, seed, people=60):
    rng = random.Random(seed)
    rows = [(u, 1, f"k{u % 3}") for u in range(people)] + [(u, 2, f"v{v}") for u in range(people) if u % 7 for v in rng.sample(range(25), rng.randint(1, 9))]
    return spark.createDataFrame(rows, "u long, type int, v string"), rows


def vectors_of(rows):
    sets = {}
    for u, t, v in rows:
        sets.setdefault(u, {1: set(), 2: set()})[t].add(v)
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    every = {(u, w): tuple(like(sets[u][t], sets[w][t]) for t in (1, 2)) for u in sets for w in sets}
    return {p: v for p, v in every.items() if min(v) > 0}


def test_pairs_are_counted_without_a_shuffle_of_pairs(spark, monkeypatch):
    nbr, rows = network(spark, 1)
    got = similarity.common_vectors(nbr, [1, 2])
    assert not re.search(r"hashpartitioning\(u#\d+L, w#\d+L", got._jdf.queryExecution().toString())
    want = vectors_of(rows)
    assert {(r.u, r.w): tuple(r.vec) for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(similarity, "LISTED", 2)  # lists in parts
    again = similarity.common_vectors(nbr, [1, 2])
    assert {(r.u, r.w): tuple(r.vec) for r in again.collect()} == want and again.count() == len(want)


def test_ranks_of_one_differing_type_need_no_join(spark):
    nbr, rows = network(spark, 2)
    want = vectors_of(rows)
    got = index.dominance_rank(spark.createDataFrame([(u, w, list(v)) for (u, w), v in want.items()], "u long, w long, vec array<double>"))
    assert "Join" not in got._jdf.queryExecution().toString()
    assert {(r.u, r.w): r.domin_rank for r in got.collect()} == {(u, w): sum(a == u and x[0] >= v[0] and x[1] >= v[1] for (a, _), x in want.items()) for (u, w), v in want.items()}
    assert index.dominance_rank(got.select("u", "w", "vec").limit(0)).count() == 0


def test_last_rounds_go_over_few_edges(spark, monkeypatch):
    rng, n, k = random.Random(5), 60, 4
    lv = {(u, u): 100 for u in range(n)}
    for u in range(n):
        for w in range(u):
            lv[u, w] = lv[w, u] = rng.choice([1, 2, 3, 5, 8, 20, 45, 60]) if rng.random() < 0.9 else 90
    alone = {n: 100}
    tau = {u: 100 for u in range(n)}
    while True:
        now = {u: sorted((min(tau[w], lv[u, w]) for w in tau if (u, w) in lv), reverse=True)[k - 1] for u in tau}
        if now == tau:
            break
        tau = now
    seen, plain = [], index._rounds
    monkeypatch.setattr(index, "_rounds", lambda e, *a: seen.append(e.count()) or plain(e, *a))
    edges = spark.createDataFrame([(u, w, x) for (u, w), x in lv.items()] + [(u, u, x) for u, x in alone.items()], "u long, w long, lv int")
    assert {r.u: r.tau for r in index._fixpoint(edges, k, []).collect()} == tau
    assert len(seen) == 2 and max(seen) < len(lv) / 2


def test_repeated_sets_are_compared_once(spark, monkeypatch):
    rng = random.Random(7)
    kinds = [rng.sample(range(6), rng.randint(1, 3)) for _ in range(8)]
    rows = [(u, t, f"v{v}") for u in range(40) for t in (1, 2) for v in kinds[(u * t) % 8]]
    nbr = spark.createDataFrame(rows, "u long, type int, v string")
    seen, plain = [], similarity._compared
    monkeypatch.setattr(similarity, "_compared", lambda n, m: seen.append(n.select("u", "type").distinct().count()) or plain(n, m))
    for measure in similarity.MEASURES:
        got = similarity.typed_similarity(nbr, measure)
        want = {tuple(r) for r in plain(nbr, measure).collect()}
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert max(seen) <= 16
