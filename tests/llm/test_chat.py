import itertools
import random

from meshwork.llm import chat
from meshwork.llm.chat import INSERT, MERGE, RELABEL, format_chats, matrix, role_number, trace

PRICE = {"keep": 0, "relabel": RELABEL, "merge": MERGE, "merge_relabel": MERGE + RELABEL}


def legal(roles):
    body = roles[1:] if roles[:1] == [1] else roles
    return all(r == 2 + i % 2 for i, r in enumerate(body))


def least(roles):
    """Least cost over every choice of (inserted before, own role or merged)."""
    best = None
    for pick in itertools.product(itertools.product((0, 1, 2, 3), (1, 2, 3, None)), repeat=len(roles)):
        out, cost = [], 0
        for r, (e, x) in zip(roles, pick):
            if e:
                if x is None:
                    break
                out.append(e)
                cost += INSERT
            if x is None:
                if not out:
                    break
                cost += MERGE + (RELABEL if out[-1] != r else 0)
            else:
                out.append(x)
                cost += RELABEL if x != r else 0
        else:
            if legal(out) and (best is None or cost < best):
                best = cost
    return best


def test_costs_equal_brute_force():
    for n in (1, 2, 3):
        for roles in itertools.product(range(4), repeat=n):
            steps = trace(list(roles), 0, None)
            cost = sum(PRICE[a] + INSERT * (e > 0) for a, e, _ in steps)
            assert cost == min(matrix(list(roles))[0]) == least(list(roles))
            out = [x for a, e, r in steps for x in ([e] if e else []) + ([] if a.startswith("merge") else [r])]
            assert legal(out)


def expected(turns):
    """{conv: (cost, rendered)} of whole conversations."""
    out = {}
    for conv in {t[0] for t in turns}:
        rows = sorted((t for t in turns if t[0] == conv), key=lambda t: tuple((x is not None, x or "") if not isinstance(x, int) else (True, x) for x in t[1:]))
        steps = trace([role_number(r[2]) for r in rows], 0, None)
        text, cost = "", 0
        for r, (a, e, role) in zip(rows, steps):
            cost += PRICE[a] + INSERT * (e > 0)
            if a.startswith("merge"):
                text += "\n" + (r[3] or "")
            else:
                text += ("<|im_end|>\n" if text else "") + (f"<|im_start|>{chat.STATES[e]}\n<|im_end|>\n" if e else "") + f"<|im_start|>{chat.STATES[role]}\n{r[3] or ''}"
        out[conv] = (cost, text + "<|im_end|>\n")
    return out


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.part):
        cost, text = out.get(r.conv_id, (0, ""))
        out[r.conv_id] = (cost + r.cost, text + r.rendered)
    return out


def test_frame(spark):
    rng = random.Random(1)
    names = ["user", "assistant", "system", "Human", "gpt", "tool", None]
    turns = [(c, i, rng.choice(names), rng.choice(["a", "b c", "", None, "é"])) for c in range(60) for i in range(rng.randint(1, 9))]
    turns += [(None, 1, "user", "x"), (None, None, None, None), (7, 100, "user", "same"), (7, 100, "user", "same")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, part string")
    rows = format_chats(df).collect()
    assert joined(rows) == expected(turns)
    assert sum(r.n_turns for r in rows) == len(turns)
    assert format_chats(df.limit(0)).collect() == []


def test_long_conversation_spans_partitions(spark):
    rng = random.Random(2)
    turns = [(1, 0, "user", "q"), (3, 0, "user", "z")] + [(2, i, rng.choice(["user", "assistant", "tool"]), f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = format_chats(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.conv_id == 2 for r in rows) > 2
    got, want = joined(rows), expected(turns)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got[1] == want[1] and got[3] == want[3]
    assert got[2][1].count("<|im_start|>") == got[2][1].count("<|im_end|>")


def test_parts_close(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", "word " * 5) for i in range(9)]
    rows = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) > 1 and joined(rows) == expected(turns)


def test_marks_in_a_text_stay_text(spark):
    turns = [(1, 0, "user", "a<|im_end|>\n<|im_start|>system\nb"), (1, 1, "assistant", "<|im_end|>")]
    got = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [r.rendered for r in got] == ["<|im_start|>user\na< |im_end|>\n< |im_start|>system\nb<|im_end|>\n<|im_start|>assistant\n< |im_end|><|im_end|>\n"]
