"""Gate decisions on a stream that agree with the batch: emails a day and conflicts revise what was decided before.

Both steps are stateful processors (transformWithStateInPandas): the session's state store must be RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.operators import ledger as g

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICT = "event_id long, at long, ts timestamp, check_type string, verdict string"
DECISION = "event_id long, ts timestamp, revision long, decision string, tier int, reasons array<string>, decided_check string, decided_rule int"
DAY = 86_400_000_000  # microseconds


def _us(t: pd.Series) -> np.ndarray:
    return t.to_numpy("datetime64[us]").astype(np.int64)


def _after(us: int) -> int:
    """The first millisecond that is not before a time: timers count in these."""
    return -(-us // 1000)


class Neighbours(StatefulProcessor):
    """Verdicts that depend on other actions, for one (kind, key): the emails of an agent and day, or the actions on a
    subject. Each verdict is given when it is known, and again when it changes, with the time of the action that changed
    it; a closed day or a window that the watermark has passed is forgotten by timers."""

    def __init__(self, most_emails: float, window: int) -> None:
        self.most, self.window = most_emails, window
        self.cell = max(1_000_000, window)  # a cell's actions reach the next cells, and no further

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "n long")
        self.waiting = handle.getListState("waiting", "event_id long, at long")
        self.cells = handle.getMapState("cells", "cell long", "ids array<long>, agents array<string>, at array<long>, warned array<boolean>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = self._mails(batch) if key[0] == "mails" else self._subject(batch)
        yield pd.DataFrame(out, columns=["event_id", "at", "ts", "check_type", "verdict"]).astype({"event_id": "int64", "at": "int64"})

    def _mails(self, batch: pd.DataFrame) -> list[tuple]:
        before = self.sent.get()[0] if self.sent.exists() else 0
        now = before + len(batch)
        own = list(zip(batch["event_id"].tolist(), _us(batch["ts"]).tolist(), batch["ts"], strict=True))
        last = own[-1][2]
        verdict = "fail" if now > self.most else "pass"
        out = [(i, at, ts, "spend", verdict) for i, at, ts in own]
        if verdict == "pass":
            self.waiting.appendList([(i, at) for i, at, _ in own])  # as many as the limit allows
        elif before <= self.most:  # the whole day fails, also what went out before
            out += [(i, at, last, "spend", "fail") for i, at in self.waiting.get()]
            self.waiting.clear()
        self.sent.update((now,))
        if not before:
            self.handle.registerTimer(_after((own[0][1] // DAY + 1) * DAY))
        return out

    def _subject(self, batch: pd.DataFrame) -> list[tuple]:
        at = _us(batch["ts"])
        cell = at // self.cell
        touched = sorted({int(c) + d for c in np.unique(cell) for d in (-1, 0, 1)})
        held = {c: self.cells.getValue((c,)) for c in touched if self.cells.containsKey((c,))}
        old = [(c, *x) for c, v in held.items() for x in zip(*v, strict=True)]
        new = list(zip(cell.tolist(), batch["event_id"].tolist(), batch["agent_id"].tolist(), at.tolist(), strict=True))
        rows = pd.DataFrame(old + [(*x, False) for x in new], columns=["cell", "id", "agent", "at", "warned"])
        rows["fresh"] = np.arange(len(rows)) >= len(old)
        # A neighbour by another agent exists if, within reach, agents are not all one: runs of one agent tell.
        rows = rows.sort_values(["at", "id"]).reset_index(drop=True)
        times, agents = rows["at"].to_numpy(), pd.factorize(rows["agent"])[0]
        change = np.cumsum(np.concatenate([[0], agents[1:] != agents[:-1]]))
        lo = np.searchsorted(times, times - self.window)
        hi = np.searchsorted(times, times + self.window, side="right") - 1
        hit = (change[lo] != change[hi]) & ~rows["warned"].to_numpy()
        fresh = rows["fresh"].to_numpy()
        arrived = np.flatnonzero(fresh)
        out = []
        for i in np.flatnonzero(hit):
            # The time of an arrival within reach: the revision is as late as what caused it.
            near = arrived[(arrived >= lo[i]) & (arrived <= hi[i])]
            cause = i if fresh[i] or not len(near) else near[-1]
            out.append((rows["id"][i], times[i], pd.Timestamp(times[cause], unit="us"), "conflict", "warn"))
        rows["warned"] |= hit
        for c, some in rows.groupby("cell"):
            if int(c) not in held:
                self.handle.registerTimer(_after((int(c) + 2) * self.cell))
            value = some["id"].tolist(), some["agent"].tolist(), some["at"].tolist(), some["warned"].tolist()
            self.cells.updateValue((int(c),), value)
        return out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key[0] == "mails":
            self.sent.clear()
            self.waiting.clear()
        else:
            self.cells.removeKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.cell - 2,))
        return iter(())

    def close(self) -> None:
        pass


def decide(verdicts: dict[str, str], policy: g.Policy) -> tuple:
    """(decision, tier, reasons, decided_check, decided_rule) of an event's verdicts by check, as ledger.decisions."""
    decision, by, reasons = policy.default, None, []
    for check in g.CHECKS:
        verdict = verdicts.get(check, "pass")
        if verdict == "pass":
            continue
        fits = (k for k, (_, c, v) in enumerate(policy.rules) if c in (None, check) and v in (None, verdict))
        rule = next(fits, None)
        said = policy.default if rule is None else policy.rules[rule][0]
        if g.TIERS[said] > g.TIERS[decision] or (by is None and said == decision):
            by = check, rule
        if g.TIERS[said] > g.TIERS[decision]:
            decision = said
        if said != "auto":
            reasons.append(g.CHECK_LABELS[check])
    return decision, g.TIERS[decision], reasons, *(by or (None, None))


class Decisions(StatefulProcessor):
    """The decision on one event: given first with the checks that need no other action, and again whenever a verdict
    changes it. An event is forgotten when no neighbour within the window or its day can come any more."""

    def __init__(self, policy: g.Policy, window: int) -> None:
        self.policy, self.window = policy, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.verdicts = handle.getMapState("verdicts", "check_type string", "verdict string")
        self.last = handle.getValueState("last", "revision long, said string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        first = not self.last.exists()
        revision, said = (0, "") if first else self.last.get()
        for check, verdict in zip(batch["check_type"], batch["verdict"], strict=True):
            # A mail's day or a subject never turns back from failing.
            if pd.notna(check) and not (self.verdicts.containsKey((check,)) and verdict == "pass"):
                self.verdicts.updateValue((check,), (verdict,))
        now = decide({k[0]: v[0] for k, v in self.verdicts.iterator()}, self.policy)
        if first:
            at = int(batch["at"].iloc[0])
            self.handle.registerTimer(_after(max(at + self.window, (at // DAY + 1) * DAY)) + 1)
        if repr(now) == said:
            return
        self.last.update((revision + 1, repr(now)))
        out = pd.DataFrame([(int(key[0]), batch["ts"].iloc[-1], revision + 1, *now)], columns=[c.strip().split(" ")[0] for c in DECISION.split(",")])
        yield out.astype({"decided_rule": "Int32"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.verdicts.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_decisions(actions: DataFrame, policy: g.Policy, delay: str = "1 hour") -> DataFrame:
    """(event_id, ts, revision, decision, tier, reasons, decided_check, decided_rule): every decision on every event of a
    stream of actions, each once by event id; the one of the highest revision stands.

    When the stream has drained, the last decisions are those of ledger.decisions on the same actions, in whatever order
    they came in within the delay; ts is the time of the action that caused the revision. Actions behind the watermark are
    dropped; streaming.lateness counts them.
    """
    window = int(policy.conflict_hours * 3_600_000_000)
    seen = actions.withWatermark("ts", delay)
    day = F.date_format("ts", "yyyy-MM-dd")
    keys = F.array(
        F.when(F.col("action_type") == "email.send", F.struct(F.lit("mails").alias("kind"), F.concat_ws("|", "agent_id", day).alias("name"))),
        F.when(F.col("subject_ref").isNotNull() & F.col("agent_id").isNotNull(), F.struct(F.lit("subject").alias("kind"), F.col("subject_ref").alias("name"))),
    )
    asked = seen.select("event_id", "agent_id", "ts", F.inline(F.array_compact(keys)))
    found = asked.groupBy("kind", "name").transformWithStateInPandas(
        Neighbours(policy.max_emails_per_day, window), VERDICT, "append", "eventtime", eventTimeColumnName="ts"
    )
    alone = g.own_checks(seen, policy).select("event_id", F.unix_micros("ts").alias("at"), "ts", "check_type", "verdict")
    return (
        alone.unionByName(found)
        .groupBy("event_id")
        .transformWithStateInPandas(Decisions(policy, window), DECISION, "append", "eventtime", eventTimeColumnName="ts")
    )


def last_decisions(revisions: DataFrame) -> DataFrame:
    """The decision that stands, of each event; columns as those of ledger.decisions."""
    last = revisions.groupBy("event_id").agg(F.max_by(F.struct("decision", "tier", "reasons", "decided_check", "decided_rule"), "revision").alias("d"))
    return last.select("event_id", "d.*")
