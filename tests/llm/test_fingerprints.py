import hashlib

import numpy as np

from meshwork.llm.fingerprints import fingerprint, fingerprint_neighbours, likeness, packed, shingle_hashes
from meshwork.llm.text import words


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(2**63), r[1] or ""), reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        text, follow = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        a, b, c = (fingerprint(words(t)) for t in (text, edited, follow))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(a), packed(b), likeness(a, b), likeness(a, c)))
    return out


def key(r):
    return tuple(map(str, r))


def test_frame_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), " ".join(rng.choice(["ä", "b", "Cc", "dd", "e\n"], rng.integers(0, 40)))) for i in rng.permutation(300)]
    rows += [(None, "null id"), (7, "again"), (7, "again"), (8, None), (9, "")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, near_next double")
    for size in (7, 10_000):
        got = [tuple(r) for r in fingerprint_neighbours(df, size).collect()]
        assert sorted(got, key=key) == sorted(brute(rows), key=key)
    one = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    assert [tuple(r) for r in fingerprint_neighbours(one).collect()] == brute([(1, "x y")])
    assert fingerprint_neighbours(one.limit(0)).collect() == []


def test_likeness_follows_jaccard():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        base = [f"{x}".encode() for x in rng.integers(0, 10**6, 400)]
        cut = int(rng.integers(0, 400))
        other = base[:cut] + [f"{x}".encode() for x in rng.integers(0, 10**6, 400 - cut)]
        sets = [{tuple(ws[i : i + 5]) for i in range(396)} for ws in (base, other)]
        errors.append(likeness(fingerprint(base), fingerprint(other)) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.15


def test_edges():
    assert fingerprint([]) is None and likeness(None, None) == 1.0 and likeness(None, fingerprint([b"a"])) == 0.0
    assert likeness(fingerprint([b"a", b"b"]), fingerprint([b"a", b"b"])) == 1.0
    assert likeness(fingerprint([b"a"] * 4), fingerprint([b"a"] * 5)) < 0.3


def test_bins_and_borrowing_written_out():
    """One permutation, bin by bin: the least hash of each bin, an empty bin takes the first filled one of its tries, at last the least."""
    mask = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        return h ^ (h >> 31)

    for n in (1, 4, 5, 6, 30, 300, 5000):
        ws = [f"w{i * 37 % 1009}".encode() for i in range(n)]
        least = {}
        for h in map(int, shingle_hashes(ws)):
            least[h >> 55] = min(h, least.get(h >> 55, mask))
        assert len(shingle_hashes(ws)) == max(1, n - 4)
        want = []
        for b in range(512):
            at, t = b, 0
            while at not in least:
                at, t = (mixed((t << 9) + b + 1) >> 55, t + 1) if t < 1096 else (min(least), t)
            want.append(least[at] & 15)
        assert fingerprint(ws).tolist() == want


def test_shingle_hashes_follow_their_words():
    a, b = shingle_hashes([b"a", b"b", b"c", b"d", b"e", b"f"]), shingle_hashes([b"b", b"c", b"d", b"e", b"f", b"g"])
    assert a[1] == b[0] and len({*a.tolist(), *b.tolist()}) == 3
    assert shingle_hashes([b"a", b"b"])[0] != shingle_hashes([b"b", b"a"])[0]
