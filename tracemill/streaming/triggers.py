"""Rules that arm and fire, kept as per-run state of a stream of calls.

Calls are taken in arrival order, so the batch form in ``operators.incremental`` is the
definition.  State is a few numbers per rule.  Runs have no end marker: give ``ttl_ms`` so that
idle runs are forgotten.  Spark then keeps scheduling batches to watch the clock, so such a query
belongs under a processing-time trigger and never ends by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

OUTPUT = "run_id long, event_id string, armed_at long, fired_at long"
STATE = "calls long, armed string, fired string"


@dataclass(frozen=True)
class Rule:
    event_id: str
    activation_tools: Sequence[str] = ()
    fire_tools: Sequence[str] = ()
    delay: int = 0
    activation_args: dict[str, Any] = field(default_factory=dict)
    fire_args: dict[str, Any] = field(default_factory=dict)
    #: Whether the rule ends the call that it fires on; only :func:`replay_rules_stream` looks at it.
    ends: bool = False

    def hits(self, tools: Sequence[str], args: dict[str, Any], tool: str, given: dict[str, Any]) -> bool:
        return (not tools or tool in tools) and all(comparable(given.get(k)) == comparable(v) for k, v in args.items())


def comparable(value: Any) -> str:
    """Text that is equal for equal values, as in the batch form: numbers by value, booleans apart from numbers."""
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f"#{float(value)}"
    return json.dumps(value, sort_keys=True)


def arm_then_fire_stream(calls: DataFrame, rules: Sequence[Rule], ttl_ms: int | None = None) -> DataFrame:
    """One row per fired rule; ``calls(run_id, pos, tool, arguments)``."""
    plain = [asdict(r) for r in rules]

    def update(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = [Rule(**r) for r in plain]
        if state.exists:
            count, armed, fired = state.get[0], json.loads(state.get[1]), set(json.loads(state.get[2]))
        else:
            count, armed, fired = 0, {r.event_id: 0 for r in known if not r.activation_tools}, set()
        out = []
        # A micro-batch may arrive in several chunks: its calls are put in order together.
        arrived = list(batches)
        calls_ = pd.concat(arrived).sort_values("pos", kind="stable") if arrived else None
        for batch in [] if calls_ is None else [calls_]:
            for tool, raw in batch[["tool", "arguments"]].itertuples(index=False):
                given = json.loads(raw) if raw else {}
                for rule in known:
                    start = armed.get(rule.event_id)
                    if rule.event_id in fired or start is None or count - start < max(0, rule.delay):
                        continue
                    if rule.hits(rule.fire_tools, rule.fire_args, tool, given):
                        fired.add(rule.event_id)
                        out.append((key[0], rule.event_id, start, count + 1))
                count += 1
                for rule in known:
                    if rule.event_id not in armed and rule.hits(rule.activation_tools, rule.activation_args, tool, given):
                        armed[rule.event_id] = count
        state.update((count, json.dumps(armed), json.dumps(sorted(fired))))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["run_id", "event_id", "armed_at", "fired_at"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return calls.groupBy("run_id").applyInPandasWithState(update, OUTPUT, STATE, "append", timeout)


REPLAY = "run_id long, kind string, event_id string, armed_at long, fired_at long, pos long"


class _Replay(StatefulProcessor):
    """One run: calls wait in a buffer until the watermark has passed them, then meet the rules in the order of their times."""

    def __init__(self, rules: Sequence[dict], ttl_ms: int | None):
        self.plain, self.ttl_ms = list(rules), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = [Rule(**r) for r in self.plain]
        self.waiting = handle.getMapState("waiting", "at long, pos long", "tool string, arguments string, raised boolean")
        self.marks = handle.getMapState("marks", "event_id string", "armed_at long, history long, fired_at long")
        self.progress = handle.getValueState("progress", "at long, pos long, calls long, counted long, timer long")

    def _read(self) -> tuple[int, int, int, int, int | None]:
        return tuple(self.progress.get()) if self.progress.exists() else (-1, -1, 0, 0, None)

    def handleInputRows(self, key, rows, timerValues):
        at, pos, calls, counted, timer = self._read()
        first, late = None, []
        for batch in rows:
            for when, place, tool, arguments, raised in batch[["at", "pos", "tool", "arguments", "raised"]].itertuples(index=False):
                if (when, place) <= (at, pos):
                    late.append((key[0], "late", None, None, None, int(place)))
                    continue
                self.waiting.updateValue((int(when), int(place)), (tool, arguments, bool(raised)))
                first = int(when) if first is None else min(first, int(when))
        if first is not None and (timer is None or first < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            self.progress.update((at, pos, calls, counted, first))
        yield pd.DataFrame(late, columns=[c.split()[0] for c in REPLAY.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, pos, calls, counted, timer = self._read()
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()) if self.waiting.exists() else []
        due = [h for h in held if h[0][0] <= passed]
        rest = held[len(due) :]
        out = []
        for place, (tool, arguments, raised) in due:
            calls += 1
            counted, fired = self._play(calls, counted, tool, json.loads(arguments) if arguments else {}, raised)
            out += [(key[0], "fired", event, armed, calls, place[1]) for event, armed in fired]
            at, pos = place
            self.waiting.removeKey(place)
        if rest:
            timer = rest[0][0][0]
        elif due:
            # Nothing waits: the run is forgotten if no call comes for so long.
            timer = at + self.ttl_ms if self.ttl_ms else None
        else:
            for store in (self.waiting, self.marks, self.progress):
                store.clear()
            return
        if timer is not None:
            self.handle.registerTimer(timer)
        self.progress.update((at, pos, calls, counted, timer))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLAY.split(", ")])

    def _play(self, index: int, counted: int, tool: str, given: dict, raised: bool) -> tuple[int, list[tuple[str, int]]]:
        """One call against the rules: how many calls count now, and which rules fired."""
        fired, ended = [], False
        marks = {}
        for rule in self.known:
            kept = self.marks.getValue((rule.event_id,)) if self.marks.containsKey((rule.event_id,)) else None
            armed, history, done = marks[rule.event_id] = tuple(kept) if kept else (None if rule.activation_tools else 0, 0, None)
            if done is not None or armed is None or counted - history < max(0, rule.delay) or not rule.hits(rule.fire_tools, rule.fire_args, tool, given):
                continue
            self.marks.updateValue((rule.event_id,), (armed, history, index))
            fired.append((rule.event_id, armed))
            if rule.ends:
                ended = True
                break
        if ended or raised:
            return counted + ended, fired
        for rule in self.known:
            if marks[rule.event_id][0] is None and rule.hits(rule.activation_tools, rule.activation_args, tool, given):
                self.marks.updateValue((rule.event_id,), (index, counted + 1, None))
        return counted + 1, fired


def replay_rules_stream(calls: DataFrame, rules: Sequence[Rule], time_col: str, delay: str, ttl_ms: int | None = None) -> DataFrame:
    """Stream form of ``operators.incremental.replay_rules``: a row per fired rule, and a row per late call.

    ``calls(run_id, pos, tool, arguments, raised)`` may arrive in any order; ``time_col`` must rise with ``pos`` in a run.  A call
    waits, in the state of its run, until the watermark (``delay`` behind the latest time seen) has passed it; then the
    calls so far are played in order.  The state holds the calls that wait and three numbers per rule.  A call older than one
    that its run has played is not played: it comes out with ``kind`` late.  After ``ttl_ms`` of event time without
    a call a run is forgotten.  The last calls of a stream wait for later ones, of any run, to move the watermark.

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.  Null runs, times or positions
    are left out.
    """
    timed = calls.withWatermark(time_col, delay)
    raised = F.coalesce("raised", F.lit(False)) if "raised" in calls.columns else F.lit(False)
    # The time goes on as a number: rows behind the watermark then reach the processor, which reports them.
    plain = timed.select(F.col("run_id").cast("long"), F.col("pos").cast("long"), "tool", "arguments", raised.alias("raised"), F.unix_millis(F.col(time_col).cast("timestamp")).alias("at"))
    plain = plain.filter("run_id IS NOT NULL AND pos IS NOT NULL AND at IS NOT NULL")
    return plain.groupBy("run_id").transformWithStateInPandas(_Replay([asdict(r) for r in rules], ttl_ms), REPLAY, "Append", "EventTime")
