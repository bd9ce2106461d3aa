import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from meshwork.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, run string, n string"


def brute(rows):
    """The trie by its definition, with lists of turns as nodes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((-1, 0) if turn is None else (0, turn), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        text = ",".join(map(str, sorted(ends[p])))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, prefix_trie.conversation_trie(df).collect()), key=str)


def made(seed, convs, turns):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randint(1, turns)):
            rows.append((c * r.choice([1, 1, 1, 5]), t * 1000 + c, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", None, ""])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_as_by_definition(spark, seed):
    rows = made(seed, 60, 14)
    assert ours(spark, rows) == brute(rows)


def test_blocks_and_pieces(spark, monkeypatch):
    """Conversations over many blocks and partitions, chunks of two ids."""
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    rows = [(c, t, "user", "x" if t < 60 - c else f"{c}") for c in (0, 5, 10, 15, 20, 25) for t in range(70 - c // 2)]
    rows += [(c, t, "user", "same") for c in range(30, 100, 5) for t in range(9)]
    assert ours(spark, rows, 5) == brute(rows)


def test_nested_runs(spark):
    """Each conversation leaves the one before a turn later, so that messages pass run by run."""
    rows = [(5 * c, t, "user", "same" if t < c else f"own {c}") for c in range(8) for t in range(c + 2)]
    assert ours(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (7, None, None, None), (8, 1, "user", ""), (8, 1, "user", ""), (1, 0, "user", "x" * 500_000), (2, 3, None, "x"),
        (12345678901234, 0, "a", "b"), (3, None, "user", "first"), (3, -5, "user", "then"),
    ]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, rows[:1]) == []
    assert ours(spark, [(7, 0, "user", "x")]) == brute([(7, 0, "user", "x")])  # turnless, unless h is 0


def test_texts_and_ends(spark):
    df = spark.createDataFrame([(0, 0, "user", "hi", "", "", ""), (0, 1, "assistant", "ho", "", "", ""), (10, 0, "user", "hi", "", "", "")], SCHEMA)
    trie = prefix_trie.build_trie(*prefix_trie.shared_starts(prefix_trie.positions(prefix_trie.turn_facts(df))))
    got = {(r.depth, r.role, r.text, r.conv_id, r.n_convs) for r in trie.with_texts(df).collect()}
    assert got == {(0, None, None, 0, 2), (1, "user", "hi", 0, 2), (2, "assistant", "ho", 0, 1)}
    assert sorted(r.conv_id for r in trie.ends.collect()) == [0, 10]
