"""A state processor that hands a key's rows over in event-time order."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Ordered(StatefulProcessor):
    """Buffers rows until the watermark passes them, then folds them one by one.

    Subclasses give ``fold(state, row) -> (state, outputs)``, ``expire(state, now_ms) ->
    (state, outputs)`` for state that ends by itself at ``deadline(state)`` (ms), and the
    output columns.  Rows are dicts with ``t_us`` and ``row_id`` (absent
    if null, and then first); state is JSON.
    """

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.state = handle.getValueState("state", "json string")

    def close(self) -> None:
        pass

    def fold(self, state: Any, row: dict) -> tuple[Any, list[dict]]:
        raise NotImplementedError

    def deadline(self, state: Any) -> int | None:
        return None

    def expire(self, state: Any, now_ms: int) -> tuple[Any, list[dict]]:
        return None, []

    def _held(self) -> list[dict]:
        return [json.loads(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []

    def _current(self) -> Any:
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        """Columns of objects, as an empty column of numbers is no empty column of strings."""
        return pd.DataFrame({c: [r.get(c) for r in rows] for c in self.columns}, dtype=object)

    def _timer(self, held: list[dict], state: Any) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        due = [min(r["t_us"] for r in held) // 1000 + 1] if held else []
        end = self.deadline(state) if state is not None else None
        if end is not None:
            due.append(end)
        if due:
            self.handle.registerTimer(min(due))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [json.loads(x) for batch in rows for x in batch["row"].tolist()]
        if new:
            self.waiting.appendList([(json.dumps(r),) for r in new])
        self._timer(self._held(), self._current())
        yield self._frame([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(self._held(), key=lambda r: (r["t_us"], r.get("row_id", -(2**63))))
        ready = [r for r in held if r["t_us"] // 1000 < now]
        rest = held[len(ready) :]
        state, out = self._current(), []
        for row in ready:
            while state is not None and (end := self.deadline(state)) is not None and end * 1000 <= row["t_us"]:
                state, more = self.expire(state, end)
                out += more
            state, more = self.fold(state, row)
            out += more
        while state is not None and (end := self.deadline(state)) is not None and end <= now:
            state, more = self.expire(state, now)
            out += more
        self.waiting.clear()
        if rest:
            self.waiting.put([(json.dumps(r),) for r in rest])
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
        self._timer(rest, state)
        yield self._frame(out)
