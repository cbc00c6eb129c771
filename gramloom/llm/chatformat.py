"""Chat formatting with minimum-cost role repair.

Legal conversations are words of an automaton: an optional system turn, then user and assistant in turn, the
assistant last. Dynamic programming over its states chooses, for each source turn, the role it gets, whether it is
merged into the turn before, and which empty turns stand before it, at the least total cost. Costs over a stretch of
turns form a min-plus matrix, and matrices of neighbouring stretches multiply: a conversation may lie in any number of
partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.tables import table
from gramloom.session import checkpointed

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# fixed values: other names of the roles
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 40
_STATES = range(4)


def _inserts() -> dict[tuple[int, int], list[int]]:
    """Empty turns that lead from one state to another, as few as possible."""
    out: dict[tuple[int, int], list[int]] = {}
    for s in _STATES:
        out[s, s] = []
        front = [s]
        while front:
            front = [t for u in front for t in LEGAL[u] if (s, t) not in out and not out.__setitem__((s, t), [*out[s, u], t])]
    return out


INSERTS = _inserts()


def _steps() -> dict[int | None, list[list[tuple[int, bool, tuple[int, ...]]]]]:
    """[role][state before][state after] -> (cost, merged, empty turns before) of one source turn, the cheapest first."""
    out = {}
    for role in (None, SYSTEM, USER, ASSISTANT):
        grid = [[(FAR, False, ())] * 4 for _ in _STATES]
        for s in _STATES:
            for t in ROLES:
                label = 0 if t == role else RELABEL
                ways = [(MERGE + label, True, ())] if s == t else []
                ways += [(INSERT * len(path) + label, False, tuple(path)) for u in _STATES if t in LEGAL[u] and (path := INSERTS.get((s, u))) is not None]
                if ways:
                    grid[s][t] = min(ways, key=lambda w: (w[0], not w[1], len(w[2]), w[2]))
        out[role] = grid
    return out


STEPS = _steps()
# what is left to pay where a conversation ends; an empty one is legal
ENDS = [0 if s in (START, ASSISTANT) else INSERT * len(INSERTS[s, ASSISTANT]) for s in _STATES]


MARK = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", re.DOTALL)


def escaped(text: str) -> str:
    """A text in which no mark can be read: a backslash more stands between every `<` and `|` that only backslashes part."""
    return MARK.sub(r"<\\\1|", text) if "|" in text else text


def turns_of(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered conversation, the texts as they were before they were escaped."""
    return [(role, ESCAPED.sub(r"<\1|", text)) for role, text in TURN.findall(rendered)]


def role_of(name: str | None) -> int | None:
    return ALIASES.get(name.strip().lower()) if name else None


def stretch(roles: list[int | None]) -> list[list[int]]:
    """Least cost from each state to each state over some turns."""
    out = [[0 if s == t else FAR for t in _STATES] for s in _STATES]
    for role in roles:
        step = STEPS[role]
        out = [[min(row[u] + step[u][t][0] for u in _STATES) for t in _STATES] for row in out]
    return out


def to_go(roles: list[int | None], after: list[int]) -> list[list[int]]:
    """Least cost still to pay in each state before every turn and at the end, `after` being that beyond the end."""
    out = [after]
    for role in reversed(roles):
        step, last = STEPS[role], out[-1]
        out.append([min(step[s][t][0] + last[t] for t in _STATES) for s in _STATES])
    return out[::-1]


def walk(roles: list[int | None], state: int, left: list[list[int]]) -> list[int]:
    """The states after each turn; of equally cheap ways the one whose states are first in order."""
    out = []
    for i, role in enumerate(roles):
        step = STEPS[role][state]
        state = next(t for t in _STATES if step[t][0] + left[i + 1][t] == left[i][state])
        out.append(state)
    return out


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(number, rows) of the runs of rows of one conversation in a partition; rows are (conversation, turn, role, text)."""
    rows: list[tuple] = []
    number = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][0] != row[0]:
                yield number, rows
                number, rows = number + 1, []
            rows.append(row)
    if rows:
        yield number, rows


def _edges(batches):
    """The first and the last fragment of a partition, with the cost matrix: only these may go on elsewhere."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None

    def row(number, rows):
        matrix = stretch([role_of(r[2]) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([str(rows[0][0]) if rows[0][0] is not None else None], pa.string()),
                                           pa.array([len(rows)]), pa.array([[x for line in matrix for x in line]], pa.list_(pa.int64()))],
                                          names=["part", "number", "conv", "n", "matrix"])

    for number, rows in _fragments(batches):
        if number == 0:
            yield row(number, rows)
        else:
            last = number, rows
    if last:
        yield row(*last)


def _exits(ahead: dict[tuple[int, int], list[int]]):
    """For fragments that go on elsewhere: state after, and turns opened, for each state before."""
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        wanted = {n for p, n in ahead if p == part}
        for number, rows in _fragments(batches) if wanted else ():
            if number in wanted:
                roles = [role_of(r[2]) for r in rows]
                left = to_go(roles, ahead[part, number])
                ends, opened = [], []
                for s in _STATES:
                    states = walk(roles, s, left) if left[0][s] < FAR else [s]
                    ends.append(states[-1])
                    opened.append(sum(len(p) + (not m) for p, m in _ways(roles, s, states)) if left[0][s] < FAR else 0)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([ends], pa.list_(pa.int64())), pa.array([opened], pa.list_(pa.int64()))],
                                                 names=["part", "number", "ends", "opened"])

    return run


def _ways(roles, state, states):
    """(empty turns before, merged) of each turn."""
    for role, t in zip(roles, states):
        _, merged, path = STEPS[role][state][t]
        yield path, merged
        state = t


def _formatted(known: dict[tuple[int, int], tuple[int, list[int], int, int, bool]], names: list[str], types: list[pa.DataType]):
    """The repaired rows of every conversation."""
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        for number, rows in _fragments(batches):
            state, after, turn, piece, ends = known.get((part, number), (START, ENDS, 0, 0, True))
            roles = [role_of(r[2]) for r in rows]
            states = walk(roles, state, to_go(roles, after))
            begun = state != START
            for row, role, (path, merged), t in zip(rows, roles, _ways(roles, state, states), states):
                for role_in in path:
                    out.append((row[0], turn, None, None, None, "insert", ROLES[role_in], "<|end|>\n" * begun + f"<|{ROLES[role_in]}|>\n"))
                    turn, begun = turn + 1, True
                text = escaped(row[3] or "")
                if merged:
                    piece_text = "\n" + text
                else:
                    piece_text = "<|end|>\n" * begun + f"<|{ROLES[t]}|>\n" + text
                    turn, begun = turn + 1, True
                action = "+".join(a for a, on in (("relabel", t != role), ("merge", merged)) if on) or "keep"
                out.append((row[0], turn - 1, piece, row[1], row[2], action, ROLES[t], piece_text))
                piece += 1
            if ends:
                for role_in in INSERTS[states[-1], ASSISTANT]:
                    out.append((rows[0][0], turn, None, None, None, "insert", ROLES[role_in], f"<|end|>\n<|{ROLES[role_in]}|>\n"))
                    turn += 1
                out[-1] = (*out[-1][:-1], out[-1][-1] + "<|end|>\n")
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def repair_roles(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each source turn and each inserted one, which in order of (out_turn, piece) give the chat text.

    Columns: conversation, out_turn (0, 1, ... of the repaired conversation), piece (0, 1, ... of its source turns;
    null for an inserted one), turn and role as they were, action (keep, relabel, merge, relabel+merge, insert),
    out_role, rendered. A merge costs 1, an empty turn 2, a new role 3; names of roles count without case, other
    and null roles must be relabelled, a null text is empty. Of equally cheap repairs the one whose states are
    first in order is taken, so the result does not depend on the partitions. Turns come in order of turn (null
    first), role and text; a null conversation is one like others.

    A rendered turn is `<|role|>`, a line end, the text and `<|end|>` with a line end; what looks like a mark in a text is
    escaped, and `turns_of` reads the turns back.

    Turns are range-partitioned, so that a long conversation spreads over many tasks, and never met as a whole:
    two cost matrices for each partition are all that the driver combines.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.col(role).alias("r"), F.col(text).alias("t"))
    placed = source.withColumn("_place", F.monotonically_increasing_id())
    keys = ["c", "n", "r", "t", "_place"]
    ordered = checkpointed(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place"))
    light = ordered.withColumn("t", F.lit(None).cast("string"))

    edges = sorted(light.mapInArrow(_edges, "part bigint, number bigint, conv string, n bigint, matrix array<bigint>").collect(), key=lambda e: (e["part"], e["number"]))
    chains: list[list] = []  # fragments of one conversation in neighbouring partitions
    for e in edges:
        before = chains[-1][-1] if chains else None
        if before and before["conv"] == e["conv"] and e["number"] == 0 and before["part"] < e["part"]:
            chains[-1].append(e)
        else:
            chains.append([e])
    chains = [c for c in chains if len(c) > 1]
    ahead = {}
    for chain in chains:
        left = ENDS
        for e in reversed(chain):
            ahead[e["part"], e["number"]] = left
            left = [min(e["matrix"][4 * s + t] + left[t] for t in _STATES) for s in _STATES]
    exits = {(x["part"], x["number"]): x for x in light.mapInArrow(_exits(ahead), "part bigint, number bigint, ends array<bigint>, opened array<bigint>").collect()} if ahead else {}
    known = {}
    for chain in chains:
        state, opened, piece = START, 0, 0
        for e in chain:
            key = e["part"], e["number"]
            known[key] = state, ahead[key], opened, piece, e is chain[-1]
            opened, piece = opened + exits[key]["opened"][state], piece + e["n"]
            state = exits[key]["ends"][state]

    names = [conv, "out_turn", "piece", "turn", "role", "action", "out_role", "rendered"]
    fields = {f.name: f.dataType for f in source.schema.fields}
    kinds = [fields["c"].simpleString(), "bigint", "bigint", fields["n"].simpleString(), "string", "string", "string", "string"]
    types = [to_arrow_type(fields["c"]), pa.int64(), pa.int64(), to_arrow_type(fields["n"]), *[pa.string()] * 4]
    return ordered.mapInArrow(_formatted(known, names, types), ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def op7_chat_format(spark, sf_dir):
    return repair_roles(table(spark, sf_dir, "conversations"))
