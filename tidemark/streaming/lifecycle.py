"""Tasks' state machine as a stream: keyed state, late events in order, timers for tasks that went stale."""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import model

#: Micro-seconds to a milli-second, of which timers and watermarks count.
_MILLI = 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Tasks are kept in so many groups, by hash; those without a name in another.
GROUPS = 1024
_NAMELESS = -1


class State(NamedTuple):
    """What is known of a task; times in micro-seconds."""

    status: str | None = None
    progress: int | None = None
    message: str | None = None
    at: int | None = None
    seq: int | None = None
    accepted: int = 0
    refused: int = 0


class Event(NamedTuple):
    at: int
    seq: int
    status: str | None
    progress: int | None
    message: str | None


def sweep(state: State, now: int, stale: int) -> State:
    """A task that is open for longer than ``stale`` has become an error at that moment."""
    if state.status in model.OPEN_STATUS and now > state.at + stale:
        return state._replace(status="error", progress=0, message=model.INTERRUPTED, at=state.at + stale)
    return state


def advance(state: State, event: Event, stale: int) -> State:
    """The state after the next event in order; what TRANSITIONS does not allow changes nothing."""
    allowed = event.status in model.TRANSITIONS[state.status]
    if allowed:
        state = sweep(state, event.at, stale)
        allowed = event.status in model.TRANSITIONS[state.status]
    if not allowed:
        return state._replace(refused=state.refused + 1)
    return State(event.status, event.progress, event.message, event.at, event.seq, state.accepted + 1, state.refused)


def _plain(column: pd.Series, kind: type | None = None) -> list:
    """A column's values as Python's own, None where there is none."""
    return [None if x is None or x != x else kind(x) if kind else x for x in column.tolist()]


def _least(values: tuple) -> tuple:
    return tuple((x is not None, x if x is not None else 0) for x in values)


class Lifecycle(StatefulProcessor):
    """A group of tasks: each one's state, and those of its events that the watermark has not passed, since others may come before them.

    A group is one value, read and written once when it has events or its timer is due, because a call
    to the state store from Python takes as long as many events.
    """

    def __init__(self, task: str, stale_hours: int):
        self.task, self.stale = task, stale_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held binary")

    def _read(self) -> tuple[int | None, dict]:
        """When the group's timer is due, and (state, waiting events) by task."""
        found = self.held.get()
        return pickle.loads(found[0]) if found else (None, {})

    def _now(self, timer: int | None, tasks: dict, told: set, watermark: int) -> Iterator[pd.DataFrame]:
        """Settle what the watermark has passed; the states after all events so far of tasks in told, and of those that it swept."""
        rows, sweeps, last = [], [], None
        for task, (settled, waiting) in tasks.items():
            state = State(*settled)
            events = sorted(waiting.items(), key=itemgetter(0))
            passed = 0
            while passed < len(events) and events[passed][0][0] < watermark:
                place, values = events[passed]
                state = advance(state, Event(*place, *values), self.stale)
                del waiting[place]
                passed += 1
            before, state = state, sweep(state, watermark, self.stale)
            swept = state is not before
            tasks[task] = (tuple(state), waiting)
            for place, values in events[passed:]:
                state = advance(state, Event(*place, *values), self.stale)
            if passed < len(events):
                last = max(last or 0, events[-1][0][0])
            if state.status in model.OPEN_STATUS:
                sweeps.append(state.at + self.stale)
            if swept or task in told:
                rows.append((task, *state))
        # the next sweep, or when all that waits can be settled
        due = min((x // _MILLI + 1 for x in (*sweeps, *([] if last is None else [last]))), default=None)
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.held.update((pickle.dumps((timer, tasks), pickle.HIGHEST_PROTOCOL),))
        if rows:
            yield self._frame(rows)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        columns = dict(zip((self.task, *State._fields), zip(*rows, strict=True), strict=True))
        none = np.iinfo(np.int64).min  # numpy's NaT
        at = np.array([none if x is None else x for x in columns["at"]], np.int64).view("datetime64[us]")
        return pd.DataFrame({k: pd.Series(at).dt.tz_localize("UTC") if k == "at" else pd.Series(v, dtype=object if None in v else None) for k, v in columns.items()})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timer, tasks = self._read()
        told = set()
        for frame in rows:
            names = [None] * len(frame) if key[0] == _NAMELESS else frame["task"].tolist()
            places = zip(map(int, frame["micros"].tolist()), map(int, frame["seq"].tolist()), strict=True)
            values = zip(_plain(frame["status"]), _plain(frame["progress"], int), _plain(frame["message"]), strict=True)
            told.update(names)
            for task, place, new in zip(names, places, values, strict=True):
                if task not in tasks:
                    tasks[task] = (tuple(State()), {})
                waiting = tasks[task][1]
                # repeated; of unlike ones the smallest, as in a batch
                waiting[place] = min(new, waiting[place], key=_least) if place in waiting else new
        yield from self._now(timer, tasks, told, max(0, timerValues.getCurrentWatermarkInMs()) * _MILLI)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, tasks = self._read()
        yield from self._now(None, tasks, set(), max(0, timerValues.getCurrentWatermarkInMs()) * _MILLI)

    def close(self) -> None:
        pass


def states(events: DataFrame, task: str, late: str = "1 hour", stale_hours: int = model.STALE_HOURS, groups: int = GROUPS) -> DataFrame:
    """As the batch operator ``tasks.lifecycle``, on a stream of (task, at, seq, status, progress, message).

    A row comes out whenever a task has events or is swept; the last one is the task's state. Events
    may come in any order, and more than once, as long as they come within ``late`` of the newest;
    older ones are dropped. State is read and written by groups of tasks: take as many as keep about a
    thousand tasks in each, and the same number for a stream's whole life. Needs the RocksDB state store.
    """
    timed = events.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    kind = timed.schema[task].dataType.simpleString()
    schema = f"{task} {kind}, status string, progress int, message string, at timestamp, seq long, accepted long, refused long"
    name = F.col(task)
    group = F.when(name.isNull(), F.lit(_NAMELESS).cast("long")).otherwise(F.pmod(F.xxhash64(name), F.lit(groups)))
    if kind in ("tinyint", "smallint", "int", "bigint"):  # one null would make floats of a batch's numbers
        name = F.coalesce(name, F.lit(0).cast(kind))
    rows = timed.select(group.alias("group"), name.alias("task"), "at", "micros", "seq", "status", "progress", "message")
    return rows.groupBy("group").transformWithStateInPandas(Lifecycle(task, stale_hours), schema, "Update", "EventTime")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store, for streams that start inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
