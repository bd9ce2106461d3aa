import math
import random

import pytest
from pyspark.sql import functions as F

from meshwork.llm.mixing import mix_sources, mixed_documents, multipliers


def reshared(sizes, weights, share, cap):
    """Targets by resharing what is above, round after round."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / (sum(w[s] for s in free) or 1)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


def rows(seed, n, sources):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * int(rng.expovariate(1 / 60))), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("sources", [["a", "B", "é", None], [f"s{i}" for i in range(9)] + ["big"] * 12, ["only"]])
def test_targets_and_copies(spark, sources):
    data = rows(1, 1500, sources)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    df = spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, source string, size int")
    got = mix_sources(df).collect()
    want, of = reshared(sizes, (5, 2, 1), 1.0, 3), {i: s for i, _, s in data}
    taken = {}
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(data)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(10, 0.001 * want[s])
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(df.repartition(3)).collect()))


def test_rates_solve_the_convex_problem(spark):
    """Each source's multiplier, found by bisection over documents, gives the same rates; they differ inside a source."""
    rng = random.Random(2)
    docs = [(s, rng.choice([0.1, 0.5, 1.0, 2.0, 5.0]), int(rng.expovariate(1 / 80)) + 1) for s in "abcd" for _ in range(200)]
    size = {s: sum(x for t, _, x in docs if t == s) for s in "abcd"}
    goals = [("a", size["a"], size["a"] * 2.5), ("b", size["b"], size["b"] * 0.05), ("c", size["c"], size["c"] * 3.0), ("d", size["d"], 0.0)]
    cells = spark.createDataFrame(docs, "source string, q double, size long").groupBy("source", "q", "size").count().withColumnRenamed("count", "n")
    found = {r.source: r for r in multipliers(cells, spark.createDataFrame(goals, "source string, source_size long, target double"), 3).collect()}
    for s, _, t in goals:
        own = [(q, x) for u, q, x in docs if u == s]
        mean = sum(x for _, x in own) / len(own)
        rates = lambda lam: [min(3, q * math.exp(min(700, lam * x / mean))) for q, x in own]  # noqa: E731, B023
        lo, hi = -1e4, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(r * x for r, (_, x) in zip(rates(mid), own)) < t else (lo, mid)
        got = rates(found[s].lam)
        assert math.isclose(sum(r * x for r, (_, x) in zip(got, own)), t, rel_tol=1e-8, abs_tol=1e-6)
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(got, rates((lo + hi) / 2)))
    assert len({round(min(3, math.exp(found["b"].lam * x / 80)), 6) for u, _, x in docs if u == "b"}) > 50


def test_repeats_are_rounded_each_on_its_own(spark):
    data = [(7, "w " * 10, "a")] * 100 + [(100 + i, "v " * 10, "b") for i in range(100)] + [(None, "u " * 10, "c")] * 100
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    runs = [mix_sources(df.repartition(n), weights=(10, 4, 2)).collect() for n in (1, 4)]
    assert sorted(map(tuple, runs[0]), key=str) == sorted(map(tuple, runs[1]), key=str)
    for target in {r.target for r in runs[0]}:
        assert abs(sum(r.taken for r in runs[0] if r.target == target) - target) <= 10
    mixed = mixed_documents(df.withColumn("row", F.lit("x")), weights=(10, 4, 2))
    assert mixed.columns == ["doc_id", "text", "source", "row"] and mixed.count() == sum(r.copies for r in runs[0])


def test_rates_differ_inside_a_source(spark):
    got = mix_sources(spark.createDataFrame(rows(3, 600, ["a", "b", "c"]), "doc_id long, text string, source string")).collect()
    assert all(len({r.rate for r in got if r.target == t and r["size"]}) > 30 for t in {r.target for r in got})


def test_odd_rows(spark):
    data = [(None, "a b", "x"), (1, None, "x"), (1, "", None), (2, "c d", None), (2, "c d", None), (3, "q", "zero")]
    got = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert len(got) == 6 and all(0 <= r.taken <= 3 * r["size"] for r in got)
    none = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mix_sources(none).collect()] == [(0.0, 0)] * 2
    assert mix_sources(none.limit(0)).collect() == []
