"""Live state of proposals while a run's log comes in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.runs import ROLES, WRITE_ROLE

OUTPUT = "run_id long, proposal_id long, pos long, to string"


def _apply(book: dict, pos: int, role: str, status: str, kind: str, proposal: str) -> list[tuple[str, str]]:
    """One entry of the log on a run's proposals: (proposal, new state) for each change. A proposal that is done leaves
    the book, so what a run keeps is what stands open."""
    changes = []
    mine = book.get(proposal)
    if status != "error":
        if kind == "filed" and mine is None:
            book[proposal] = {"by": role, "objections": 0, "passed": [], "state": "open", "pos": pos}
            changes.append((proposal, "open"))
        elif kind == "objected" and mine is not None:
            mine["objections"] += 1
            if mine["state"] == "integrated":
                mine["state"] = "open"
                changes.append((proposal, "reopened"))
        elif kind == "implemented" and mine is not None and mine["state"] == "integrated":
            del book[proposal]
            changes.append((proposal, "done"))
    if status == "ok":
        for number, p in book.items():
            if p["state"] == "open" and p["pos"] < pos and role not in p["passed"]:
                p["passed"].append(role)
            owed = [r for r in ROLES if r not in (p["by"], WRITE_ROLE) and r not in p["passed"]]
            if p["state"] == "open" and not owed and not p["objections"]:
                p["state"] = "integrated"
                changes.append((number, "integrated"))
    return changes


def live_transitions(entries: DataFrame) -> DataFrame:
    """(run_id, proposal_id, pos, to) of every change of state, from a stream of entries (run_id, pos, role, status, kind,
    proposal_id; kind: filed, objected, implemented or turn). A run's entries come in the order of their positions, but
    for those of one batch, which are put in order; kept by run: its open and integrated proposals."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["pos", "kind"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            number = "" if pd.isna(r.proposal_id) else str(int(r.proposal_id))
            out += [(key[0], int(p), int(r.pos), to) for p, to in _apply(book, int(r.pos), r.role, r.status, r.kind, number)]
        state.update((json.dumps(book),))
        yield pd.DataFrame(out, columns=["run_id", "proposal_id", "pos", "to"])

    return entries.groupBy("run_id").applyInPandasWithState(run, OUTPUT, "book string", "append", GroupStateTimeout.NoTimeout)


class OrderedRuns(StatefulProcessor):
    """A run's entries wait until the watermark has passed them, and are then applied in the order of their positions; a
    run without entries for `idle` is forgotten."""

    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, pos long, role string, status string, kind string, proposal string")
        self.book = handle.getValueState("book", "book string, last long")

    def _known(self) -> tuple[dict, int]:
        text, last = self.book.get() if self.book.exists() else ("{}", 0)
        return json.loads(text), last

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, last = self._known()
        for batch in rows:
            ms = -(-batch["ts"].to_numpy("datetime64[us]").astype(np.int64) // 1000)
            names = ["" if pd.isna(p) else str(int(p)) for p in batch["proposal_id"]]
            self.waiting.appendList(list(zip(ms.tolist(), batch["pos"].tolist(), batch["role"], batch["status"], batch["kind"], names, strict=True)))
            for t in np.unique(ms).tolist():
                self.handle.registerTimer(t)
            last = max(last, int(ms.max()))
        self.handle.registerTimer(last + self.idle)
        self.book.update((json.dumps(book), last))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        book, last = self._known()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] <= now), key=lambda r: (r[1], r[4]))
        out = []
        for _, pos, role, status, kind, proposal in due:
            out += [(key[0], int(p), pos, to) for p, to in _apply(book, pos, role, status, kind, proposal)]
        rest = [r for r in held if r[0] > now]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if not rest and last + self.idle <= now:
            self.book.clear()
        else:
            self.book.update((json.dumps(book), last))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "proposal_id", "pos", "to"])

    def close(self) -> None:
        pass


def ordered_transitions(entries: DataFrame, delay: str = "1 hour", idle_hours: float = 24 * 30) -> DataFrame:
    """As live_transitions, from entries that have a time ts as well, and may come in any order within the delay, over as
    many batches as they like: an entry takes effect when the watermark has passed it, positions in order. Times do not
    fall as positions rise. What comes later than the delay is dropped (streaming.lateness counts it), and a run that is
    silent for idle_hours is forgotten: state is bounded by what is open and what is on its way. The session's state store
    must be RocksDB."""
    seen = entries.withWatermark("ts", delay).select("run_id", "pos", "role", "status", "kind", "proposal_id", F.col("ts"))
    return seen.groupBy("run_id").transformWithStateInPandas(OrderedRuns(int(idle_hours * 3_600_000)), OUTPUT, "append", "eventtime")
