"""Keyed state over event streams: the life of a conversion job, and the format of a text that is being edited.

Both are ``transformWithState`` processors with event-time timers, so a job that nothing more is
heard of and an editor that falls silent are settled when the watermark passes them, and state
ends.  What becomes of a key depends on its events and their order alone, not on how they
fall into batches: a deadline that an event has passed is settled before the event.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioloom.operators.jobs import decided

#: Needed by ``transformWithState``; set it on the session before a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

JOB_OUT = "job_id string, ts_ms long, status string, progress int, kind string"
FORMAT_OUT = "editor string, ts_ms long, format string"
START, STEP, MOST = 10, 15, 85


class _WithDeadline(StatefulProcessor):
    """Keeps one timer, at the deadline of the state; none in a batch, where no time passes after the last event."""

    timers = True

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", self.SCHEMA)

    def _store(self, state: tuple | None) -> None:
        for timer in list(self._handle.listTimers()) if self.timers else []:
            self._handle.deleteTimer(timer)
        if state is None:
            self._state.clear()
            return
        self._state.update(state)
        if self.timers:
            self._handle.registerTimer(self._deadline(state))

    def _load(self) -> tuple | None:
        return tuple(self._state.get()) if self._state.exists() else None

    def _run(self, key: str, state: tuple | None, until: int | None) -> Iterator[tuple[tuple | None, Row | None]]:
        """States and rows of the deadlines up to ``until``."""
        while state is not None and (until is None or self._deadline(state) <= until):
            state, row = self._passed(key, state)
            yield state, row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        state = self._load()
        for state, row in self._run(key[0], state, expiredTimerInfo.getExpiryTimeInMs()):
            if row is not None:
                yield row
        self._store(state)


class JobLife(_WithDeadline):
    """A job is started (or done at once), ticks, is done or fails, and is removed.

    A start sets progress to 10, a tick adds 15 up to 85, ``done`` gives 100 and ``error`` 0.
    Every event gives a row: ``applied``, ``illegal`` (no such step from here), ``repeated`` (the
    same step at the same time) or ``late`` (before the last applied one); only the first changes
    the job.  A job that is silent for ``stuck_ms`` while processing fails with a row
    ``stuck``; one that ended is forgotten after ``keep_ms``, and its id may start again.
    """

    SCHEMA = "status string, progress int, ts long, step string"

    def __init__(self, stuck_ms: int, keep_ms: int):
        self._stuck_ms, self._keep_ms = stuck_ms, keep_ms

    def _deadline(self, state: tuple) -> int:
        return state[2] + (self._stuck_ms if state[0] == "processing" else self._keep_ms)

    def _passed(self, key: str, state: tuple) -> tuple[tuple | None, Row | None]:
        at = self._deadline(state)
        if state[0] != "processing":
            return None, None
        return ("error", 0, at, "stuck"), Row(job_id=key, ts_ms=at, status="error", progress=0, kind="stuck")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        state = self._load()
        for event in sorted(rows, key=lambda r: (r.ts_ms, r.step or "")):
            for state, row in self._run(key[0], state, event.ts_ms):
                if row is not None:
                    yield row
            before, kind = state, "applied"
            status, progress = (state[0], state[1]) if state else (None, None)
            if state and event.ts_ms < state[2]:
                kind = "late"
            elif state and (event.ts_ms, event.step) == (state[2], state[3]):
                kind = "repeated"
            elif state is None and event.step in ("processing", "done"):
                status, progress = event.step, START if event.step == "processing" else 100
            elif status == "processing" and event.step == "tick":
                progress = min(progress + STEP, MOST)
            elif status == "processing" and event.step in ("done", "error"):
                status, progress = event.step, 100 if event.step == "done" else 0
            elif state and event.step == "removed":
                status, progress = "removed", None
            else:
                kind = "illegal"
            if kind == "applied":
                state = None if status == "removed" else (status, progress, event.ts_ms, event.step)
            at = status if kind == "applied" else before and before[0]
            yield Row(job_id=key[0], ts_ms=event.ts_ms, status=at, progress=progress, kind=kind)
        self._store(state)


class TextFormat(_WithDeadline):
    """The detected format of a text after each pause in its edits; see ``jobs.detections``.

    An editor that is silent for ``keep_ms`` is forgotten, and with it the format that a short
    text would keep.  An edit before the pending one, which comes late, is passed over.
    """

    SCHEMA = "pending boolean, ts long, size int, found string, format string"

    def __init__(self, quiet_ms: int, keep_ms: int, least_chars: int):
        self._quiet_ms, self._keep_ms, self._least_chars = quiet_ms, keep_ms, least_chars

    def _deadline(self, state: tuple) -> int:
        return state[1] + (self._quiet_ms if state[0] else self._keep_ms)

    def _passed(self, key: str, state: tuple) -> tuple[tuple | None, Row | None]:
        pending, ts, size, found, last = state
        if not pending:
            return None, None
        now = found if size > self._least_chars else None if size == 0 else last
        return (False, ts, size, found, now), Row(editor=key, ts_ms=ts, format=now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        state = self._load()
        for edit in sorted(rows, key=lambda r: (r.ts_ms, r.content is not None, r.content or "")):
            if state and edit.ts_ms < state[1]:
                continue
            for state, row in self._run(key[0], state, edit.ts_ms):
                if row is not None:
                    yield row
            state = (True, edit.ts_ms, edit.size, edit.found, state[4] if state else None)
        self._store(state)


def job_lives(events: DataFrame, key: str, ts: str, step: str, stuck_ms: int = 600_000, keep_ms: int = 86_400_000, late: str = "10 seconds") -> DataFrame:
    """``job_id, ts_ms, status, progress, kind`` of every event and every job that got stuck; see ``JobLife``.

    Events without a key or time belong to no job and are left out.  On a batch table, jobs that are
    silent at its end stay as they are.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    rows = rows.select(F.col(key).cast("string").alias("job_id"), F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"), F.col(step).alias("step"))
    life = JobLife(stuck_ms, keep_ms)
    life.timers = events.isStreaming
    _ = events.sparkSession.streams.active  # starts the coordinator of state stores, which a batch needs too
    return rows.groupBy("job_id").transformWithState(life, JOB_OUT, "Append", "EventTime" if life.timers else "None")


def text_formats(edits: DataFrame, key: str, ts: str, content: str, quiet_ms: int = 300, keep_ms: int = 86_400_000, late: str = "10 seconds", least_chars: int = 10) -> DataFrame:
    """``editor, ts_ms, format`` after each pause in a stream of edits; see ``TextFormat``."""
    size, found = decided(F.col(content), least_chars)
    rows = edits.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key).cast("string").alias("editor"), F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"), F.col(content).alias("content"), size.alias("size"), found.alias("found"))
    return rows.groupBy("editor").transformWithState(TextFormat(quiet_ms, keep_ms, least_chars), FORMAT_OUT, "Append", "EventTime")
