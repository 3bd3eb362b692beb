"""The conversational session as a pure step function, folded over recorded turns in batch or in a stream."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEARCHES, CITATION_REPAIRS, ARGUMENT_REPAIRS, PROTOCOL_REPAIRS, ACTIONS, HISTORY = 2, 1, 1, 2, 8, 8
STAGES = ("rewrite", "retrieval", "answer", "repair", "wiki")
# The tools each stage allows.
TOOLS = {"rewrite": ("rewrite", "ask"), "retrieval": ("search", "ask"), "answer": ("search", "answer", "save"), "repair": ("answer",), "wiki": ("confirm", "revise", "reject")}


@dataclass(frozen=True)
class Session:
    presented: bool = False
    replied: bool = False
    searches: int = 0
    repairs: int = 0
    protocol_repairs: int = 0
    actions: int = 0
    pending: bool = False
    answered: int = 0


def stage(s: Session) -> str:
    if s.pending:
        return "wiki"
    if not s.presented:
        return "rewrite"
    if s.repairs:
        return "repair"
    return "answer" if s.searches else "retrieval"


def step(s: Session, event: str, ok: bool = True) -> tuple[Session, str]:
    """The next state and what came of an event: ok, refused, repair, failed or reset."""
    if event == "user":
        s = replace(s, actions=0, protocol_repairs=0)
        return (replace(s, replied=True) if s.presented else s), "ok"
    if event == "next":
        return Session(answered=s.answered), "reset"
    if s.actions >= ACTIONS:
        return s, "failed"
    s = replace(s, actions=s.actions + 1)
    if event not in TOOLS[stage(s)]:
        s = replace(s, protocol_repairs=s.protocol_repairs + 1)
        return s, "failed" if s.protocol_repairs > PROTOCOL_REPAIRS else "refused"
    if event == "rewrite":
        return replace(s, presented=True), "ok"
    if event == "search":
        if not s.replied or s.searches >= SEARCHES:
            return s, "refused"
        return replace(s, searches=s.searches + 1), "ok"
    if event == "answer":
        if ok:
            return Session(presented=False, answered=s.answered + 1), "ok"
        return (s, "failed") if s.repairs >= CITATION_REPAIRS else (replace(s, repairs=s.repairs + 1), "repair")
    if event == "save":
        return replace(s, pending=True), "ok"
    if event in ("confirm", "reject"):
        return replace(s, pending=False), "ok"
    return s, "ok"


OUT = "session_id long, seq long, event string, stage string, outcome string, searches int, answered int"


def run_sessions(events: DataFrame) -> DataFrame:
    """events: session_id, seq, event, ok. Each session is folded in order; actions per turn and searches are bounded."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s, out = Session(), []
        for r in rows.sort_values("seq").itertuples():
            at = stage(s)
            s, outcome = step(s, r.event, bool(r.ok))
            out.append((key[0], r.seq, r.event, at, outcome, s.searches, s.answered))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return events.groupBy("session_id").applyInPandas(fold, OUT)


def run_sessions_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream: the state of a session lives between batches and is dropped after two idle hours."""
    state_schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int'}" for k, v in asdict(Session()).items())

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = Session(*state.get) if state.exists else Session()
        rows, out = pd.concat(list(batches)).sort_values("seq"), []
        for r in rows.itertuples():
            at = stage(s)
            s, outcome = step(s, r.event, bool(r.ok))
            out.append((key[0], r.seq, r.event, at, outcome, s.searches, s.answered))
        state.update(tuple(asdict(s).values()))
        state.setTimeoutDuration(2 * 3600 * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return events.groupBy("session_id").applyInPandasWithState(fold, OUT, state_schema, "append", "ProcessingTimeTimeout")


def latest(rows: DataFrame, key: str, order: str, n: int = HISTORY) -> DataFrame:
    from .retrieval import ranked

    return ranked(rows, [key], [F.col(order).desc()], n, "back")
