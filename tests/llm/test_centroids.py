import hashlib
import math
import random

import numpy as np
import pytest

from meshwork.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, owner string, q string"


def brute(rows, k, rounds):
    """Lloyd by its definition in Python integers: every vector against every centroid in each round."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda p: (hashlib.sha256(f"1:{'' if p[0] is None else p[0]}".encode()).hexdigest(), np.array(p[1], "<i4").tobytes()))
    cs = [p[1] for p in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((dist(v, c), j) for j, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        owners = assign()
        for j in range(len(cs)):
            own = [v for (_, v), (_, o) in zip(kept, owners, strict=True) if o == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = assign()
    total = sum(d for d, _ in last)
    by = {j: sum(d for d, o in last if o == j) for j in range(len(cs))}
    return sorted(((i, j, d, by[j], total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


def ours(spark, rows, k=16, rounds=3, parts=3):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, centroids.cluster_vectors(df, k, rounds).collect()), key=str)


def near(r, n, spread=0.3):
    middle = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "k", "rounds"), [(1, 16, 3), (2, 5, 8), (3, 40, 1), (4, 3, 0)])
def test_as_by_definition(spark, seed, k, rounds):
    rows = near(random.Random(seed), 200)
    assert ours(spark, rows, k, rounds) == brute(rows, k, rounds)


def test_copies_ties_and_bad_vectors(spark):
    r = random.Random(9)
    one = [0.5] * 64
    rows = near(r, 60) + [(i, one) for i in range(100, 160)] + [(7, one), (7, one), (None, one), (None, [0.25] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [math.nan] + [1.0] * 63), (906, [math.inf] + [1.0] * 63), (907, [1e5, -1e5] * 32)]
    assert ours(spark, rows) == brute(rows, 16, 3)
    assert ours(spark, [(1, one)] * 5) == brute([(1, one)] * 5, 16, 3)
    assert ours(spark, [(900, None)]) == [] and ours(spark, []) == []
    huge = ours(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, one)], 1, 0)
    assert len(huge) == 3 and max(x[2] for x in huge) <= 1 << 62


def test_only_moved_centroids_and_their_vectors_are_compared(spark, monkeypatch):
    """A round's distances are to moved centroids, but for vectors whose owner moved; transfers cancel to the sums."""
    rows = near(random.Random(5), 300, 0.05)
    points = centroids.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    state, cs = centroids.lloyd(points, 6, 3)
    got = centroids._assigned(state.withColumnRenamed("distance", "distance"), cs, np.array([], np.int64)).collect()
    assert all(r.was == r.owner for r in got)  # nothing moved, nothing changes hands
    fake = state.withColumn("distance", (state.distance * 0 - 1))  # a stored distance that can't be beaten
    kept = centroids._assigned(fake, cs, np.array([2])).collect()
    assert all(r.owner == r.was and r.distance == -1 for r in kept if r.was != 2) and all(r.distance >= 0 for r in kept if r.was == 2)


def test_distances_are_exact_beyond_doubles():
    x = np.array([[centroids.LIMIT, -centroids.LIMIT + 1] * 32], np.int64)
    c = np.array([[-centroids.LIMIT, centroids.LIMIT] * 32], np.int64)
    want = sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], c[0], strict=True))
    assert centroids.distances(x, c).tolist() == [[want]]
