import random

import numpy as np

import corpus_pipeline
from meshwork.llm import near_copies as module
from meshwork.llm.near_copies import band_keys, minima, near_copies, shingle_set


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def alike(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def brute_groups(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min(least.get(g, d), d)
    return sorted((d, least[g]) for (d, _), g in zip(rows, group))


def edited(rng, ws, edits):
    ws = ws[:]
    for at in rng.sample(range(len(ws)), edits):
        ws[at] = f"new{rng.randrange(10**6)}"
    return ws


def test_groups_equal_brute_force(spark):
    rng, rows = random.Random(2), []
    for _ in range(60):
        ws = [f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows) * 2 + 1, " ".join(edited(rng, ws, rng.randint(0, len(ws) // 35)))))
    base = [f"v{i}" for i in range(40)]
    rows += [(900, " ".join(base)), (901, " ".join(base[4:])), (902, " ".join(["x", *base[5:]]))]
    rows += [(910, None), (911, ""), (912, " \n"), (913, "same"), (914, "SAME"), (915, "same two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, near_copies(df).collect()))
    want = brute_groups(rows)
    assert got == want and len({c for _, c in want}) < len(rows) - 30
    assert near_copies(df.limit(0)).count() == 0


def test_stage_drops_copies_with_several_edits(spark):
    rng = random.Random(4)
    one, two = ([f"{c}{rng.randrange(10**6)}" for _ in range(300)] for c in "ab")
    rows = [(i, " ".join(edited(rng, one, 5 if i else 0))) for i in range(5)] + [(10, " ".join(two)), (11, " ".join(edited(rng, two, 25)))]
    assert alike(shingles(rows[0][1]), shingles(rows[1][1])) and not alike(shingles(rows[5][1]), shingles(rows[6][1]))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 10, 11]


def test_a_family_is_joined_without_its_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    rows = [(i, " ".join(edited(rng, base, rng.randint(1, 2)))) for i in range(300)] + [(1000, " ".join(edited(rng, base, 30)))]
    compared, plain = [], module.alike

    def counted(docs, pairs, *rest):
        compared.append(pairs.count())
        return plain(docs, pairs, *rest)

    monkeypatch.setattr(module, "alike", counted)
    monkeypatch.setattr(module, "MEMBERS", 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_copies(df).collect())) == brute_groups(rows)
    assert sum(compared) < 300 * 30  # of 45,000


def test_share_of_equal_bands_follows_similarity():
    rng, met, n = np.random.default_rng(1), 0, 300
    for _ in range(n):
        h = rng.integers(0, 1 << 63, 900, np.uint64)
        met += (band_keys(minima(np.unique(h[:800]))) == band_keys(minima(np.unique(h[100:])))).mean()  # similarity 700 / 900
    assert abs(met / n - (7 / 9) ** 4) < 0.03
    assert len(shingle_set([])) == 0
