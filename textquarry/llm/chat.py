"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation is a word of the automaton ``LEGAL``: an optional system turn, then user and assistant turns by
turns, beginning with a user's. Every turn is read once and costs what its cheapest treatment costs: kept (0), given another role
(``RELABEL``), merged into the turn before it, which must have its role in the end (``MERGE`` for a turn that says
the role itself, plus ``RELABEL`` if not), and before it an empty turn may be inserted (``INSERT``), whose role lies between. The
dynamic programme finds the cheapest treatment of the sequence; ties go to the treatment listed first in ``moves``.

A turn's costs form a matrix over the automaton's states, and sequences of turns multiply in the (min, +) semiring, so a
conversation of any length is cut by the order of its turns, whatever their numbers are: rows are dealt to tasks by ranges of
(conversation, turn, role, text), and a task cuts what it has of a conversation (a piece) into blocks of ``BLOCK`` turns with
a matrix each. Conversations that lie within one block are repaired at once. Of the others each piece's product goes into the
states at the pieces' borders, those and the blocks' matrices into the states at the blocks' borders, and each block is then
repaired and rendered between its two states. So no task holds more than its range, however long a conversation is.

The result has a row for each block, numbered from 0 within its conversation; the blocks' texts, concatenated in order, are
the conversation. A turn is closed by what follows it, in the same block or the next, so a merge at a block's start goes on
with the turn of the block before. Text can't forge a turn: between ``<`` and ``|`` a backslash is added (``escape``), which
``unescape`` takes away.

Defined results: turns are ordered by turn, role, text, nulls first; null text counts as empty; roles are compared in lower
case without outer space; an unknown or null role may become any role for ``RELABEL``; repeated turns, and turns of equal or
null number, are merged like others; a null conv_id is a conversation; other columns are left out, whatever their names; an
empty table gives none. A repair never drops text, and no text is too long.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of a role, from each state: -1 is illegal.
LEGAL = {
    "system": (SYSTEM, -1, -1, -1),
    "user": (USER, USER, -1, USER),
    "assistant": (-1, -1, ASSISTANT, -1),
}
RELABEL, MERGE, INSERT = 3, 2, 4
#: Turns of a block.
BLOCK = 512
FAR = 1 << 40
STATE_ROLE = (None, *ROLES)


def moves(role: str | None) -> list[list[tuple[int, int, tuple]]]:
    """For each state the ways to read a turn: (cost, next state, operation), the preferred first."""
    out = []
    for state in range(4):
        ways = []
        for to in ROLES:
            cost, name = (0, "keep") if to == role else (RELABEL, "relabel")
            if (after := LEGAL[to][state]) >= 0:
                ways.append((cost, after, (name, to)))
            for gap in ROLES:
                middle = LEGAL[gap][state]
                if gap != "system" and middle >= 0 and (after := LEGAL[to][middle]) >= 0:
                    ways.append((cost + INSERT, after, ("insert", gap, name, to)))
        if state != START:
            ways.append((MERGE + (0 if STATE_ROLE[state] == role else RELABEL), state, ("merge", STATE_ROLE[state])))
        best: dict[int, tuple[int, int, tuple]] = {}
        for w in ways:
            if w[1] not in best or w[0] < best[w[1]][0]:
                best[w[1]] = w
        out.append(sorted(best.values(), key=lambda w: w[0]))
    return out


MOVES = {r: moves(r) for r in (*ROLES, None)}


def known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state to each over a block."""
    out = np.full((4, 4), FAR, np.int64)
    for start in range(4):
        costs = {start: 0}
        for role in roles:
            after: dict[int, int] = {}
            for state, cost in costs.items():
                for c, to, _ in MOVES[role][state]:
                    after[to] = min(after.get(to, FAR), cost + c)
            costs = after
        for state, cost in costs.items():
            out[start, state] = cost
    return out


def borders(matrices: list[np.ndarray], start: int = START, end: int | None = None) -> list[tuple[int, int]]:
    """The states before and after each block on a cheapest way from ``start`` to ``end``, or to any state."""
    cost = np.full(4, FAR, np.int64)
    cost[start] = 0
    back = []
    for m in matrices:
        ways = cost[:, None] + m
        back.append(ways.argmin(0))
        cost = ways.min(0)
    state, out = int(cost.argmin()) if end is None else end, []
    for b in reversed(back):
        before = int(b[state])
        out.append((before, state))
        state = before
    return out[::-1]


def repair(roles: list[str | None], start: int, end: int) -> tuple[int, list[tuple]]:
    """Cost and operations of the cheapest way from one state to the other."""
    table_, costs = [], {start: 0}
    for role in roles:
        after: dict[int, tuple[int, int, tuple]] = {}
        for state in sorted(costs):
            for c, to, op in MOVES[role][state]:
                if to not in after or costs[state] + c < after[to][0]:
                    after[to] = (costs[state] + c, state, op)
        table_.append(after)
        costs = {s: v[0] for s, v in after.items()}
    ops, state = [], end
    for after in reversed(table_):
        ops.append(after[state][2])
        state = after[state][1]
    return costs[end], ops[::-1]


_MARK = re.compile(r"<(\\*)\|")
END = "<|end|>\n"


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(texts: list[str], ops: list[tuple], first: bool = True, last: bool = True) -> str:
    """ChatML-like text of a block; ``first`` and ``last`` say whether the conversation begins and ends in it."""
    out = []
    for text, op in zip(texts, ops, strict=True):
        if op[0] == "merge":
            out += ["\n", escape(text)]
            continue
        if not first:
            out.append(END)
        if op[0] == "insert":
            out += [f"<|{op[1]}|>\n", END]
        out += [f"<|{op[-1]}|>\n", escape(text)]
        first = False
    return "".join([*out, END] if last else out)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """The stored blocks of all conversations: piece, chunk (from 0 in the piece), alone, roles, texts, m, and on a piece's
    last block its product and number of blocks. ``alone`` are those that hold a whole conversation for sure."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "piece", "chunk", "alone", "roles", "texts", "m", "total", "n_chunks"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, conv_type = TaskContext.get().partitionId(), pa.null()
        out: list[tuple] = []
        state = {"conv": None, "begun": False, "first": True, "chunk": 0, "total": None}
        roles: list = []
        texts: list = []

        def flush(ended: bool, by_other: bool) -> None:
            m = matrix([known(r) for r in roles])
            state["total"] = m if state["total"] is None else product(state["total"], m)
            alone = ended and by_other and not state["first"] and state["chunk"] == 0
            total = state["total"].ravel().tolist() if ended else None
            out.append((state["conv"], piece, state["chunk"], alone, list(roles), list(texts), m.ravel().tolist(), total, state["chunk"] + 1 if ended else None))
            roles.clear()
            texts.clear()
            state["chunk"] += 1
            if ended:
                state.update(first=False, chunk=0, total=None)

        def batch_of() -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text"), strict=True):
                if state["begun"] and conv != state["conv"]:
                    flush(True, True)
                elif len(roles) == block:
                    flush(False, False)
                state.update(conv=conv, begun=True)
                roles.append(role)
                texts.append(text.as_py() or "")
            yield batch_of()
        if state["begun"]:
            flush(True, False)
            yield batch_of()

    schema = f"conv_id {kind}, piece long, chunk long, alone boolean, roles array<string>, texts array<string>, m array<long>, total array<long>, n_chunks long"
    return stored(rows.mapInArrow(cut, schema))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, block, n_turns, n_merged, n_relabelled, n_inserted, cost and the rendered text of every block."""
    bounded_batches(turns.sparkSession)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    # Equal rows may be taken in any order, so their number only serves to deal many of them to several ranges.
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order, "copy").sortWithinPartitions(*order).select("conv_id", "role", "text")
    made = _blocks(dealt, block)

    @F.pandas_udf("array<struct<piece:long,start:int,end:int,base:long,first:boolean,last:boolean>>")
    def of_pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            found = []
            for of in series:
                of = sorted(of, key=lambda p: p["piece"])
                ends = borders([np.array(p["total"], np.int64).reshape(4, 4) for p in of])
                base = np.cumsum([0] + [p["n_chunks"] for p in of])
                found.append([{"piece": p["piece"], "start": s, "end": e, "base": int(base[k]), "first": k == 0, "last": k + 1 == len(of)} for k, (p, (s, e)) in enumerate(zip(of, ends, strict=True))])
            yield pd.Series(found, dtype=object)

    @F.pandas_udf("array<struct<chunk:long,start:int,end:int,last:boolean>>")
    def of_chunks(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, starts, ends in batches:
            found = []
            for of, start, end in zip(lists, starts, ends, strict=True):
                of = sorted(of, key=lambda c: c["chunk"])
                states = borders([np.array(c["m"], np.int64).reshape(4, 4) for c in of], int(start), int(end))
                found.append([{"chunk": c["chunk"], "start": s, "end": e, "last": k + 1 == len(of)} for k, (c, (s, e)) in enumerate(zip(of, states, strict=True))])
            yield pd.Series(found, dtype=object)

    @F.pandas_udf("n_turns long, n_merged long, n_relabelled long, n_inserted long, cost long, rendered string")
    def repaired(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out = []
            for r, t, m, s, e, first, last in zip(*columns, strict=True):
                if e < 0:  # a whole conversation: its cheapest end
                    e = np.array(m, np.int64).reshape(4, 4)[START].argmin()
                cost, ops = repair([known(x) for x in r], int(s), int(e))
                count = lambda name: sum(name in o for o in ops)  # noqa: E731, B023
                out.append((len(r), count("merge"), count("relabel"), count("insert"), cost, render(list(t), ops, first, last)))
            yield pd.DataFrame(out, columns=["n_turns", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered"])

    whole = made.where("alone").select("conv_id", F.lit(0).cast("long").alias("block"), "roles", "texts", "m", F.lit(START).alias("start"), F.lit(-1).alias("end"), F.lit(True).alias("first"), F.lit(True).alias("last"))
    rest = made.where("not alone")
    pieces = rest.where("total is not null").groupBy("conv_id").agg(F.collect_list(F.struct("piece", "total", "n_chunks")).alias("p"))
    pieces = pieces.select("conv_id", F.inline(of_pieces("p"))).withColumnRenamed("conv_id", "id")
    chunks = rest.groupBy("conv_id", "piece").agg(F.collect_list(F.struct("chunk", "m")).alias("c"))
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    states = chunks.join(pieces.withColumnRenamed("piece", "at"), same & (F.col("piece") == F.col("at")))
    states = states.select("id", "at", "base", F.col("first").alias("head"), F.col("last").alias("tail"), F.inline(of_chunks("c", "start", "end")))
    states = states.select("id", "at", F.col("chunk").alias("k"), (F.col("base") + F.col("chunk")).alias("block"), "start", "end", (F.col("head") & (F.col("chunk") == 0)).alias("first"), (F.col("tail") & F.col("last")).alias("last"))
    met = rest.join(states, same & (F.col("piece") == F.col("at")) & (F.col("chunk") == F.col("k")))
    both = whole.unionByName(met.select(whole.columns))
    return both.select("conv_id", "block", repaired("roles", "texts", "m", "start", "end", "first", "last").alias("r")).select("conv_id", "block", "r.*")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
