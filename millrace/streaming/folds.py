"""Folds over the rows of a key in time order, on Spark's arbitrary state.

A processor gets a key's rows of a micro-batch as frames in no order. One frame is sorted and folded as it is. Where more
come, they wait in map state by slice of time, and slices are folded one after the other, so memory holds a slice of a
key and never a key. What a fold keeps between batches is one value; an event-time timer takes it away once it can make no
more difference, so idle keys leave nothing behind.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
# processors travel as a whole: the process that starts them beside the driver need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Fold(StatefulProcessor):
    """``columns``: the columns of a row that the fold reads, beside ``at`` (microseconds) and ``id``."""

    held = "x long"
    columns: tuple[str, ...] = ()
    slice_s = 60

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # each call of the state is a round trip, so the timer's time is held beside the state
        self.state = handle.getValueState("held", f"{self.held}, timer long")
        self.waiting = handle.getMapState("waiting", "slice long, frame long", "at array<long>, id array<long>, of array<string>")

    # what a fold is: its empty state, one row, and until when its state matters

    def empty(self) -> Any:
        raise NotImplementedError

    def load(self, value: tuple) -> Any:
        return tuple(value)

    def store(self, state: Any) -> tuple:
        return tuple(state)

    def row(self, state: Any, at: int, of: tuple) -> tuple[Any, tuple | None]:
        """The state after a row, and the row's output columns or None."""
        raise NotImplementedError

    def until(self, state: Any) -> int:
        """Microseconds of event time after which the state is as good as empty."""
        raise NotImplementedError

    def table(self, key: tuple, ids: list[int], rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    # how it is run

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        state, timer = (self.empty(), None) if held is None else (self.load(tuple(held)[:-1]), held[-1])
        first = next(rows, None)
        second = next(rows, None)
        if second is None:
            parts = [] if first is None else iter([self._columns(first)])
        else:
            slices: dict[int, list[int]] = {}
            for n, frame in enumerate(chain((first, second), rows)):
                for s in self._put(n, frame):
                    slices.setdefault(s, []).append(n)
            parts = (self._take(s, slices[s]) for s in sorted(slices))
        for at, ids, of in parts:
            order = sorted(range(len(at)), key=lambda i: (at[i], ids[i]))  # noqa: B023
            found_ids, found = [], []
            for i in order:
                state, out = self.row(state, at[i], of[i])
                if out is not None:
                    found_ids.append(ids[i])
                    found.append(out)
            yield self.table(key, found_ids, found)
        if second is not None:
            self.waiting.clear()
        self._keep(state, timer)

    def _columns(self, frame: pd.DataFrame) -> tuple[list, list, list]:
        at = (frame["at"].astype("datetime64[us]").astype("int64")).tolist()
        return at, frame["id"].tolist(), list(zip(*[frame[c].tolist() for c in self.columns])) if self.columns else [()] * len(at)

    def _put(self, n: int, frame: pd.DataFrame) -> list[int]:
        """A frame's part of each slice goes under a key of its own, so none is read to be added to."""
        at, ids, of = self._columns(frame)
        by: dict[int, list[int]] = {}
        for i, t in enumerate(at):
            by.setdefault(t // (self.slice_s * SECOND), []).append(i)
        for s, mine in by.items():
            self.waiting.updateValue((s, n), ([at[i] for i in mine], [ids[i] for i in mine], ["\t".join(map(str, of[i])) for i in mine]))
        return list(by)

    def _take(self, s: int, frames: list[int]) -> tuple[list, list, list]:
        at, ids, of = ([x for part in column for x in part] for column in zip(*[self.waiting.getValue((s, n)) for n in frames]))
        return at, ids, [tuple(x.split("\t")) if self.columns else () for x in of]

    def _keep(self, state: Any, before: int | None) -> None:
        ms = max(1, self.until(state) // 1000 + 1)
        self.state.update((*self.store(state), ms))
        if before != ms:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])


class Budget(Fold):
    """Units admitted in a sliding window, at most ``limit``; what is denied does not count."""

    held, columns = "at array<long>, units array<long>", ("units",)

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window = limit, window_s * SECOND

    def empty(self):
        return [], []

    def load(self, value):
        return list(value[0]), list(value[1])

    def row(self, state, at, of):
        # admitted units never exceed the limit and each row has one at least: the lists are bounded
        times, units = state
        gone = next((i for i, t in enumerate(times) if t >= at - self.window), len(times))
        times, units, n = times[gone:], units[gone:], int(of[0])
        ok = sum(units) + n <= self.limit
        return ((times + [at], units + [n]) if ok else (times, units)), (n, ok)

    def until(self, state):
        return max(state[0], default=0) + self.window

    def table(self, key, ids, rows):
        return pd.DataFrame({"id": ids, "user_id": key[0], "feature": key[1], "units": [r[0] for r in rows], "allowed": [r[1] for r in rows]})


class Window(Fold):
    """A counter that starts with a key's first row and anew with the first one ``window_s`` later."""

    held = "start long, n long"

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window = limit, window_s * SECOND

    def empty(self):
        return -(1 << 62), 0

    def row(self, state, at, of):
        start, n = state if at < state[0] + self.window else (at, 0)
        return (start, n + 1), (n + 1 <= self.limit,)

    def until(self, state):
        return state[0] + self.window

    def table(self, key, ids, rows):
        return pd.DataFrame({"id": ids, "user_id": key[0], "allowed": [r[0] for r in rows]})


class Backoff(Fold):
    """The n-th violation blocks a key for ``base`` 2^(n-1) seconds, ``most`` at most; rows meanwhile are refused. A key
    without a row for ``forget_s`` after its block is forgotten."""

    held, columns = "until long, n long", ("feature",)

    def __init__(self, base_s: int, most_s: int, forget_s: int):
        self.base, self.most, self.forget = base_s, most_s, forget_s * SECOND

    def empty(self):
        return -(1 << 62), 0

    def row(self, state, at, of):
        until, n = state
        refused = at < until
        if not refused and of[0] == "error":
            n += 1
            until = at + min(self.base * 2 ** min(n - 1, 20), self.most) * SECOND
        return (until, n), (refused, n)

    def until(self, state):
        return max(0, state[0]) + self.forget

    def table(self, key, ids, rows):
        return pd.DataFrame({"id": ids, "user_id": key[0], "refused": [r[0] for r in rows], "violations": [r[1] for r in rows]})


class Preset(Fold):
    """Requests a minute up to a preset's limit; one too many is a violation, which blocks as ``Backoff`` does, and the count
    starts anew after the block."""

    held = "start long, n long, until long, violations long"

    def __init__(self, limits: dict[str, int], base_s: int, most_s: int, forget_s: int):
        self.limits, self.base, self.most, self.forget = limits, base_s, most_s, forget_s * SECOND

    columns = ("preset",)

    def empty(self):
        return -(1 << 62), 0, -(1 << 62), 0

    def row(self, state, at, of):
        start, n, until, violations = state
        if at < until:
            return state, (of[0], False, violations)
        if at >= start + 60 * SECOND:
            start, n = at, 0
        n += 1
        allowed = n <= self.limits[of[0]]
        if not allowed:
            violations += 1
            start, n, until = -(1 << 62), 0, at + min(self.base * 2 ** min(violations - 1, 20), self.most) * SECOND
        return (start, n, until, violations), (of[0], allowed, violations)

    def until(self, state):
        return max(0, state[0] + 60 * SECOND, state[2]) + self.forget

    def table(self, key, ids, rows):
        return pd.DataFrame({"id": ids, "user_id": key[0], "preset": [r[0] for r in rows], "allowed": [r[1] for r in rows], "violations": [r[2] for r in rows]})


class Fall(Fold):
    """Rows whose score falls by ``least`` or more against the key's last one."""

    held, columns = "health long", ("health",)
    slice_s = 3600  # a repository has few scores in an hour, and a slice costs two calls of the state a frame

    def __init__(self, least: int, forget_s: int):
        self.least, self.forget, self.last = least, forget_s * SECOND, 0

    def empty(self):
        return (None,)

    def store(self, state):
        return (state[0],)

    def row(self, state, at, of):
        health, before = int(of[0]), state[0]
        self.last = at
        fell = before is not None and before - health >= self.least
        return (health,), (health, before - health) if fell else None

    def until(self, state):
        return self.last + self.forget

    def table(self, key, ids, rows):
        return pd.DataFrame({"id": ids, "repo": key[0], "health": [r[0] for r in rows], "fall": [r[1] for r in rows]})


def folded(stream: DataFrame, by: list[str], fold: Fold, schema: str, late: str = "1 day") -> DataFrame:
    """The stream's rows, folded by key. Rows later than ``late`` behind the newest may be dropped."""
    return stream.withWatermark("at", late).groupBy(*by).transformWithStateInPandas(fold, schema, "append", "eventTime")
