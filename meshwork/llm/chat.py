"""Chat formatting by minimum-cost role repair over a legal-turn automaton.

Legal: at most one system turn, first; then user and assistant in turns, user
first. Each turn of a conversation is kept, given another role (relabelled),
joined to the turn before (merged), or preceded by an empty turn of the role that
is due (inserted); costs add up and dynamic programming finds the least. Among
repairs of equal cost the earliest action in the order of ACTIONS wins, from the
last turn backwards.

A turn's choices form a matrix over the automaton's states; runs of turns compose
by min-plus products. So a conversation that spans partitions is solved by their
matrices alone (4 x 4 numbers for the first and last run of each partition), and
each partition then traces its own turns between known states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: States are what was said last.
STATES = ("start", "system", "user", "assistant")
ROLES = STATES[1:]

#: Costs of joining, renaming and inserting.
MERGE, RELABEL, INSERT = 2, 3, 4

#: Names that stand for a role.
ALIASES = {"system": "system", "developer": "system", "user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "bot": "assistant", "gpt": "assistant"}

#: Characters of rendered text after which a part is closed.
PART_CHARS = 1 << 20

_DUE = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}  # states that may follow
_FAR = 1 << 40


def _choices(role: int) -> list[list[tuple[int, int, tuple[str, int]]]]:
    """From each state: (next state, cost, (action, role inserted before or 0)), in order of preference."""
    table = []
    for s in range(4):
        found = []
        for x in _DUE[s]:
            found.append((x, 0 if x == role else RELABEL, ("keep" if x == role else "relabel", 0)))
        if s:
            found.append((s, MERGE + (0 if s == role else RELABEL), ("merge" if s == role else "merge_relabel", 0)))
        for e in _DUE[s]:
            for x in _DUE[e]:
                found.append((x, INSERT + (0 if x == role else RELABEL), ("keep" if x == role else "relabel", e)))
        table.append(found)
    return table


#: By role: 1..3, and 0 for a name that is none.
_TABLE = [_choices(r) for r in range(4)]
ACTIONS = ("keep", "relabel", "merge", "merge_relabel")


def role_number(name: str | None) -> int:
    """1 system, 2 user, 3 assistant, 0 anything else; case and outer blanks don't count."""
    known = ALIASES.get((name or "").strip().lower())
    return STATES.index(known) if known else 0


def advance(costs: list[int], role: int) -> list[int]:
    """Least costs of the states after a turn, from those before it."""
    out = [_FAR] * 4
    for s, c in enumerate(costs):
        if c < _FAR:
            for x, k, _ in _TABLE[role][s]:
                if c + k < out[x]:
                    out[x] = c + k
    return out


def matrix(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each over a run of turns."""
    rows = [[0 if i == k else _FAR for k in range(4)] for i in range(4)]
    for r in roles:
        rows = [advance(row, r) for row in rows]
    return rows


def trace(roles: list[int], first: int, last: int | None) -> list[tuple[str, int, int]]:
    """(action, role inserted before or 0, role) of each turn, from state ``first`` to ``last`` (None: the best)."""
    ahead = [[0 if i == first else _FAR for i in range(4)]]
    for r in roles:
        ahead.append(advance(ahead[-1], r))
    state = min(range(4), key=lambda i: ahead[-1][i]) if last is None else last
    out = []
    for i in range(len(roles) - 1, -1, -1):
        order = ((s, k, a) for s in range(4) for x, k, a in _TABLE[roles[i]][s] if x == state and ahead[i][s] < _FAR)
        s, k, a = min(order, key=lambda o: (ahead[i][o[0]] + o[1], ACTIONS.index(o[2][0]), o[2][1], o[0]))
        out.append((*a, state))
        state = s
    return out[::-1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str | None, str]]]]:
    """(conv_id, [(role, text)]) of consecutive rows."""
    at, turns, any_ = None, [], False
    for b in batches:
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if any_ and conv != at:
                yield at, turns
                turns = []
            at, any_ = conv, True
            turns.append((role, text or ""))
    if any_:
        yield at, turns


def _entries(ends: list[tuple[int, int, bool, object, list[list[int]]]]) -> dict[tuple[int, bool], tuple[int, int | None, bool, int]]:
    """For the runs at the ends of partitions: state before, state after, goes on, number of partitions since it began.

    ``ends``: (partition, is the partition's last run, is its first, conv_id, matrix), in order.
    """
    chains, out = [], {}
    for e in ends:
        joins = chains and e[2] and chains[-1][-1][1] and chains[-1][-1][3] == e[3] and chains[-1][-1][0] != e[0]
        if joins:
            chains[-1].append(e)
        else:
            chains.append([e])
    for chain in chains:
        ahead = [[0, _FAR, _FAR, _FAR]]
        for *_, m in chain:
            ahead.append([min(ahead[-1][i] + m[i][k] for i in range(4)) for k in range(4)])
        state = min(range(4), key=lambda i: ahead[-1][i])
        for i in range(len(chain) - 1, -1, -1):
            part, _, is_first, _, m = chain[i]
            before = min(range(4), key=lambda s: (ahead[i][s] + m[s][state], s))
            out[(part, is_first)] = (before, state, i + 1 < len(chain), i)
            state = before
    return out


def format_chats(turns: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Repaired and rendered conversations, in parts.

    ``turns``: conv_id, turn, role, text. Returns conv_id, part, n_turns (input
    turns of the part), n_merged, n_relabeled, n_inserted, cost and rendered. The
    parts of a conversation, in order of ``part``, join to its rendering, one
    ``begin role LF text end LF`` per repaired turn, merged texts joined by LF. A
    conversation has one part, 0, unless it spans partitions or PART_CHARS. Where a
    text has ``begin`` or ``end`` itself, a blank after its first character keeps
    it from being read as one.

    Turns are taken by turn, role, text, nulls first. A null text is empty, a null
    or unknown role is relabelled or merged, all rows with a null conv_id are one
    conversation, repeated rows are turns of their own; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = turns.sparkSession
    shared_dir(spark)
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "text").checkpoint()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        for conv, run in _runs(batches):
            last = (conv, [role_number(r) for r, _ in run])
            first = first or last
        if first:
            made = [(part, last is first, True, *first)] + ([] if last is first else [(part, True, False, *last)])
            yield pa.RecordBatch.from_pydict({"p": [m[0] for m in made], "is_last": [m[1] for m in made], "is_first": [m[2] for m in made], "conv_id": pa.array([m[3] for m in made], pa.int64()), "m": [[x for row in matrix(m[4]) for x in row] for m in made]})

    found = rows.select("conv_id", "role", F.lit("").alias("text")).mapInArrow(solve, "p long, is_last boolean, is_first boolean, conv_id long, m array<long>").collect()
    ends = [(r.p, r.is_last, r.is_first, r.conv_id, [r.m[i : i + 4] for i in range(0, 16, 4)]) for r in sorted(found, key=lambda r: (r.p, not r.is_first))]
    entries = _entries(ends)
    schema = "conv_id long, part long, n_turns long, n_merged long, n_relabeled long, n_inserted long, cost long, rendered string"
    price = {"keep": 0, "relabel": RELABEL, "merge": MERGE, "merge_relabel": MERGE + RELABEL}

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where = TaskContext.get().partitionId()
        names = [c.split()[0] for c in schema.split(", ")]
        held, out, size = None, [], 0

        def parts(conv, run, first, last):
            alone = (0, None, False, 0)
            before, after, more, index = entries.get((where, first), alone) if first or last else alone
            number = index << 24
            text, counts, length, opened = [], [0] * 5, 0, before != 0
            steps = trace([role_number(r) for r, _ in run], before, after)
            for (_, body), (action, inserted, role) in zip(run, steps, strict=True):
                if length >= PART_CHARS:
                    yield (conv, number, *counts, "".join(text))
                    number, text, counts, length = number + 1, [], [0] * 5, 0
                for mark in (begin, end):
                    body = body.replace(mark, f"{mark[:1]} {mark[1:]}")
                if action.startswith("merge"):
                    piece = "\n" + body
                else:
                    piece = f"{end}\n" if opened else ""
                    if inserted:
                        piece += f"{begin}{STATES[inserted]}\n{end}\n"
                    piece += f"{begin}{STATES[role]}\n{body}"
                opened = True
                text.append(piece)
                length += len(piece)
                for i, v in enumerate((1, action.startswith("merge"), action.endswith("relabel"), inserted > 0, price[action] + INSERT * (inserted > 0))):
                    counts[i] += int(v)
            if not more:
                text.append(f"{end}\n")
            yield (conv, number, *counts, "".join(text))

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 7 else pa.int64()) for i in range(8)], names=names)

        first = True
        for conv, run in _runs(batches):
            if held:
                for r in parts(*held, first, False):
                    out.append(r)
                    size += len(r[-1])
                first = False
                if size > PART_CHARS:
                    yield batch(out)
                    out, size = [], 0
            held = (conv, run)
        if held:
            out += parts(*held, first, True)
        if out:
            yield batch(out)

    return rows.mapInArrow(render, schema)
