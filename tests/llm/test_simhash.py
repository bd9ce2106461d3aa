import random
import re
from collections import Counter

import xxhash

from meshwork.llm.simhash import embedding, fingerprint, near_groups, near_pairs, one_of_each
from meshwork.llm.text import words


def slow_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    prints = [(d, slow_fingerprint(t)) for d, t in rows]
    parent = {f: f for _, f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fs = list(parent)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        least[root(f)] = min(least.get(root(f), d), d)
    return sorted((d, f"{f:016x}", least[root(f)]) for d, f in prints)


def test_fingerprint_equals_definition():
    for t in ["", "One", "one two", "One two three É x", "a b c d e f g " * 9, None]:
        assert fingerprint(words(t)) == slow_fingerprint(t)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    values = {0, 1, 7, 15, (1 << 64) - 1, 1 << 63}
    for _ in range(150):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(4):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    df = spark.createDataFrame([(signed(v),) for v in values], "simhash long").repartition(5)
    got = {tuple(r) for r in near_pairs(df).collect()}
    vs = sorted(map(signed, values))
    want = {(a, b) for i, b in enumerate(vs) for a in vs[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_bound_is_below_hamming(spark):
    rng = random.Random(4)
    rows = [(signed(rng.getrandbits(64)), signed(rng.getrandbits(64))) for _ in range(200)]
    from pyspark.sql import functions as F

    for r in spark.createDataFrame(rows, "x long, y long").select("x", "y", F.bit_count(embedding(F.col("x")).bitwiseXOR(embedding(F.col("y")))).alias("m")).collect():
        counts = [[(v >> i & 3).bit_count() for i in range(0, 64, 2)] for v in (r.x, r.y)]
        assert r.m == sum(abs(a - b) for a, b in zip(*counts)) <= ((r.x ^ r.y) & (2**64 - 1)).bit_count()


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        ws = rng.choices(vocab, k=rng.randint(1, 120))
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.7:
                ws = ws[:]
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 1, " ".join(ws)))
    rows += [(900, None), (901, ""), (902, " \n"), (5, "same"), (6, "SAME")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, simhash int")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(df).collect())
    assert got == brute_groups(rows)
    assert Counter(r[2] for r in got)[900] == 3
    assert near_groups(df.limit(0)).count() == 0
    assert near_groups(df.unionByName(df)).count() == 2 * len(rows)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "x y z"), (4, "x y z"), (None, "p q r s")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in near_groups(df).collect()), key=str) == [(4, 4), (None, 4), (None, None)]


def test_one_row_of_each_component_whatever_the_ids(spark):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[2]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (8, texts[4].upper()), (9, texts[5]), (4, texts[5])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = one_of_each(df)
    assert got.columns == ["doc_id", "text", "n"]
    kept = sorted(((r.doc_id, r.text.lower()) for r in got.collect()), key=str)
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (3, texts[2]), (7, texts[3]), (8, texts[4]), (4, texts[5])], key=str)
    assert one_of_each(df.limit(0)).count() == 0
