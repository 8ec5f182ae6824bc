"""Reading sessions over a stream of actions: the state machine of operators.reading_state, with state in maps and a list, and timers.

Actions may come out of order. Each waits in a list until the watermark has passed its time; then a timer runs the actions that are due, by time and step, so that a session
is the same as if it had been run at once. An action that comes when a later one has been run is late: it changes nothing, and its outcome is "late".
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.reading_state import ACTIONS, OUTCOMES, Memory, step

_MAPS = ("questions", "evidence", "searches", "opened")
_REST = ("waiting", "active", "target", "gap", "ready", "stopped", "budget")
_COLUMNS = [c.split()[0] for c in OUTCOMES.split(", ")]


class ReadingSession(StatefulProcessor):
    """Maps of questions, evidence, searches and opened elements, a list of waiting actions, one value for the rest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = {name: handle.getMapState(name, "id string", "place int, value string") for name in _MAPS}
        self.rest = handle.getValueState("rest", "value string")
        self.pending = handle.getListState("pending", "at long, step long, action string")

    def _load(self) -> tuple[Memory, dict, tuple[int, int]]:
        """The memory, what is stored of it, and the place of the last action that was run."""
        memory, held, last = Memory(), {}, (-1 << 62, 0)
        for name, state in self.maps.items():
            rows = sorted((v[0], k[0], v[1]) for k, v in state.iterator())
            held[name] = {key: (place, value) for place, key, value in rows}
            setattr(memory, name, {key: json.loads(value) for _, key, value in rows})
        if self.rest.exists():
            rest = json.loads(self.rest.get()[0])
            last = tuple(rest.pop("last"))
            for name, value in rest.items():
                setattr(memory, name, value)
        return memory, held, last

    def _store(self, memory: Memory, held: dict, last: tuple[int, int]) -> None:
        """Only what has changed is written."""
        for name, state in self.maps.items():
            now = {key: (place, json.dumps(value)) for place, (key, value) in enumerate(getattr(memory, name).items())}
            for key in held[name].keys() - now.keys():
                state.removeKey((key,))
            for key, value in now.items():
                if held[name].get(key) != value:
                    state.updateValue((key,), value)
        self.rest.update((json.dumps({k: getattr(memory, k) for k in _REST} | {"last": last}),))

    def _outcomes(self, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        memory, _, last = self._load()
        late, timers = [], set(self.handle.listTimers())
        for frame in rows:
            for at, number, action in zip(frame["at"], frame["step"], frame["action"], strict=True):
                at, number = int(at), int(number)
                if (at, number) <= last:
                    a = json.loads(action)
                    state = step(memory, a | {"kind": None, **{k: None for k in ("refs", "add", "replace", "remove", "reuse")}})
                    late.append(state | {"kind": a["kind"], "outcome": "late"})
                    continue
                self.pending.appendValue((at, number, action))
                if at not in timers:
                    self.handle.registerTimer(at)
                    timers.add(at)
        yield from self._outcomes(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        waiting = list(self.pending.get())
        due = sorted(x for x in waiting if x[0] <= until)
        if not due:
            return
        memory, held, last = self._load()
        out = [step(memory, json.loads(action)) for _, _, action in due]
        self._store(memory, held, tuple(due[-1][:2]))
        left = [x for x in waiting if x[0] > until]
        self.pending.clear()
        if left:
            self.pending.put(left)
        yield from self._outcomes(out)

    def close(self) -> None:
        pass


def run_stream(actions: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of ACTIONS -> a stream of OUTCOMES, append only. Rows without a time have none to wait for, and are dropped by the watermark."""
    names = [c.name for c in actions.schema.fields if c.name in {x.split()[0] for x in ACTIONS.split(", ")}]
    whole = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rows = actions.withWatermark("ts", late).select("session_id", "ts", "step", F.unix_millis("ts").alias("at"), whole.alias("action"))
    return rows.groupBy("session_id").transformWithStateInPandas(ReadingSession(), OUTCOMES, outputMode="Append", timeMode="EventTime")
