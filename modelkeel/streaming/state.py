"""Keyed state machines on ``transformWithState``, in event-time order whatever the order of the batches.

Rows are held back in state until the watermark has passed them and are then taken in the order of time and number. What
a machine says therefore does not depend on how rows were spread over micro-batches, as long as they are within
the lateness; later ones are dropped by the watermark. A key holds what the lateness and one micro-batch bring, which
the source's trigger limits bound; beyond that it keeps one small row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from modelkeel.operators.alerts import BREAKER_COOLDOWN, BREAKER_FAILURES
from modelkeel.operators.rates import STALE_SECONDS
from modelkeel.schema import columns
from modelkeel.streaming.common import use_state_store

#: A buffer of records is written when it holds this many, or when its first one is so many seconds old.
FLUSH_RECORDS, FLUSH_SECONDS = 200, 10

#: What is held of a row, and how many rows are Python objects at a time.
_HELD = ["ms", "at", "id", "value"]
_AT_ONCE = 50_000


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``take`` in order; ``settle`` says what the watermark alone decides.

    Rows are ``key, ms`` (event time in milliseconds, as the watermark counts it), ``at`` (what orders rows of one time,
    finer time or number) and ``value``. ``state`` is the machine's own row, None at first.
    """

    #: Types of ``value`` and of the machine's row.
    value = "long"
    kept: T.StructType
    #: Names of the output's columns, set by :func:`run_in_order`.
    output: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # many rows an entry, as bytes of an Arrow stream, under a name of its own: a list is one value to the store, which
        # reads it again at every append
        self.waiting = handle.getMapState("waiting", columns(name="string"), columns(rows="binary"))
        self.own = handle.getValueState("own", self.kept)

    def take(self, key: str, state, ms: int, at: int, value) -> Iterator:
        """Yields output rows; the last thing yielded is a tuple, the new state."""
        raise NotImplementedError

    def settle(self, key: str, state, watermark: int) -> Iterator:
        """Like ``take``, for time that passed without rows."""
        yield state

    def wake(self, state) -> int | None:
        """The time at which ``settle`` may have something to say."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, schema = None, to_arrow_schema(columns(ms="long", at="long", id="long", value=self.value))
        parts: list[pa.Table] = []
        for came in rows:
            if len(came):
                parts.append(pa.Table.from_pandas(came[_HELD], preserve_index=False, schema=schema))
                low = int(came["ms"].min())
                first = low if first is None else min(first, low)
                if sum(map(len, parts)) >= _AT_ONCE:
                    self._hold(pa.concat_tables(parts))
                    parts = []
        if parts:
            self._hold(pa.concat_tables(parts))
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def _hold(self, rows: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        self.waiting.updateValue((uuid.uuid4().hex,), (sink.getvalue().to_pybytes(),))

    def _said(self, rows: list[Row]) -> pd.DataFrame:
        return pd.DataFrame.from_records([tuple(r) for r in rows], columns=self.output)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [pa.ipc.open_stream(x[0]).read_all() for x in self.waiting.values()] if self.waiting.exists() else []
        rows = pa.concat_tables(held) if held else None
        ready = rest = None
        if rows is not None:
            passed = pc.less_equal(rows["ms"], watermark)
            ready, rest = rows.filter(passed), rows.filter(pc.invert(passed))
            ready = ready.take(np.lexsort([ready[c].to_numpy() for c in ("id", "at", "ms")]))
        state, said = tuple(self.own.get()) if self.own.exists() else None, []
        # a few rows at a time become Python objects
        for part in ready.to_batches(max_chunksize=_AT_ONCE) if ready is not None else ():
            for ms, at, value in zip(*(part.column(c).to_pylist() for c in ("ms", "at", "value"))):
                for out in self.take(key[0], state, ms, at, value):
                    if isinstance(out, Row):
                        said.append(out)
                    else:
                        state = out
            if len(said) >= _AT_ONCE:
                yield self._said(said)
                said = []
        for out in self.settle(key[0], state, watermark):
            if isinstance(out, Row):
                said.append(out)
            else:
                state = out
        if said:
            yield self._said(said)
        if state is not None:
            self.own.update(state)
        elif self.own.exists():
            self.own.clear()
        if ready is not None and len(ready):
            self.waiting.clear()
            if len(rest):
                self._hold(rest)
        due = [t for t in (self.wake(state), pc.min(rest["ms"]).as_py() if rest is not None else None) if t is not None and t > watermark]
        if due:
            self.handle.registerTimer(min(due))


def run_in_order(rows: DataFrame, machine: InOrder, output: T.StructType) -> DataFrame:
    """Run a machine over a stream of ``key, ts`` (with watermark)``, at, id, value``."""
    use_state_store(rows.sparkSession)
    machine.output = output.names
    timed = rows.select("key", "ts", F.unix_millis("ts").alias("ms"), "at", "id", "value")
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=machine, outputStructType=output, outputMode="append", timeMode="EventTime")


class AlertHold(InOrder):
    """``firing`` once the condition held long enough, ``resolved`` when it stops or pauses."""

    value = "boolean"
    kept = columns(since="long", last="long", firing="boolean")

    def __init__(self, step: int, hold: int):
        self.step, self.hold = step, hold

    def take(self, key, state, ms, at, value):
        since, last, firing = state or (None, None, False)
        if since is not None and (not value or at - last > self.step):
            if firing:
                yield Row(key=key, event="resolved", since_s=since, at_s=at)
            since, firing = None, False
        if value:
            since, last = (at if since is None else since), at
            if not firing and at - since >= self.hold:
                firing = True
                yield Row(key=key, event="firing", since_s=since, at_s=since + self.hold)
        yield None if since is None else (since, last, firing)


HOLD_EVENTS = columns(key="string", event="string", since_s="long", at_s="long")


def hold_stream(grid: DataFrame, step_seconds: int, hold_seconds: int) -> DataFrame:
    """Alert events from evaluations ``key, ts`` (with watermark)``, t`` (epoch seconds) and ``active``."""
    rows = grid.select("key", "ts", F.col("t").alias("at"), F.lit(0).cast("long").alias("id"), F.col("active").alias("value"))
    return run_in_order(rows, AlertHold(step_seconds, hold_seconds), HOLD_EVENTS)


class Breaker(InOrder):
    """Closed → open after N failures in a row → half-open after the cooldown.

    Calls that fall into the open time were never sent upstream, so they change nothing. In
    half-open a success closes and a failure opens again, as the failure count is kept.
    """

    value = "boolean"
    kept = columns(failures="long", opened="long")

    def __init__(self, threshold: int, cooldown_us: int):
        self.threshold, self.cooldown = threshold, cooldown_us

    def take(self, key, state, ms, at, value):
        failures, opened = state or (0, -1)
        half_open = opened >= 0 and at - opened >= self.cooldown
        if opened < 0 or half_open:
            if half_open:
                yield Row(key=key, t=at, before="open", after="half-open")
            if value:
                failures += 1
                if failures >= self.threshold:
                    yield Row(key=key, t=at, before="half-open" if half_open else "closed", after="open")
                    opened = at
            else:
                if half_open:
                    yield Row(key=key, t=at, before="half-open", after="closed")
                failures, opened = 0, -1
        yield failures, opened


BREAKER_EVENTS = columns(key="string", t="long", before="string", after="string")


def breaker_stream(
    calls: DataFrame, threshold: int = BREAKER_FAILURES, cooldown_seconds: float = BREAKER_COOLDOWN
) -> DataFrame:
    """Breaker transitions from calls ``key, ts`` (with watermark)``, t`` (microseconds)``, id, failed``.

    A breaker lives in one process, so ``key`` names process and model; that spreads a busy
    model over as many keys as it has processes.
    """
    rows = calls.select("key", "ts", F.col("t").alias("at"), "id", F.col("failed").alias("value"))
    return run_in_order(rows, Breaker(threshold, int(cooldown_seconds * 1_000_000)), BREAKER_EVENTS)


class Silence(InOrder):
    """A row per stretch without samples longer than the limit; the open one once the watermark passes its end."""

    kept = columns(last="long", reported="boolean")

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def take(self, key, state, ms, at, value):
        last, reported = state or (None, False)
        if last is not None and at - last > self.limit and not reported:
            yield Row(key=key, last_ms=last)
        yield at, False

    def settle(self, key, state, watermark):
        if state is not None and not state[1] and state[0] + self.limit + 1 <= watermark:
            yield Row(key=key, last_ms=state[0])
            state = (state[0], True)
        yield state

    def wake(self, state):
        return None if state is None or state[1] else state[0] + self.limit + 1


SILENCE_EVENTS = columns(key="string", last_ms="long")


def silence_stream(samples: DataFrame, limit_seconds: int = STALE_SECONDS) -> DataFrame:
    """Stale reports from samples ``key, ts`` (with watermark) and ``ms`` (epoch milliseconds)."""
    zero = F.lit(0).cast("long")
    rows = samples.select("key", "ts", F.col("ms").alias("at"), zero.alias("id"), zero.alias("value"))
    return run_in_order(rows, Silence(limit_seconds * 1000), SILENCE_EVENTS)


class CounterIncrease(InOrder):
    """Reset-corrected growth per pane; the last value of a series stays in state from batch to batch."""

    kept = columns(last="long", pane="long", growth="long")

    def __init__(self, pane_ms: int):
        self.pane = pane_ms

    def take(self, key, state, ms, at, value):
        pane = ms // self.pane * self.pane
        last, open_pane, growth = state or (None, pane, 0)
        if open_pane is not None and pane != open_pane:
            yield Row(key=key, pane_ms=open_pane, increase=growth)
            growth = 0
        elif open_pane is None:
            growth = 0
        grown = 0 if last is None else value if value < last else value - last
        yield value, pane, growth + grown

    def settle(self, key, state, watermark):
        if state is not None and state[1] is not None and state[1] + self.pane <= watermark:
            yield Row(key=key, pane_ms=state[1], increase=state[2])
            state = (state[0], None, 0)
        yield state

    def wake(self, state):
        return None if state is None or state[1] is None else state[1] + self.pane


INCREASES = columns(key="string", pane_ms="long", increase="long")


def counter_increase_stream(samples: DataFrame, pane_seconds: int) -> DataFrame:
    """``key, pane_ms, increase`` of every pane with samples, once the watermark has passed it.

    ``samples`` are ``key, ts`` (with watermark)``, id, value``: readings of counters that may restart.
    """
    rows = samples.select("key", "ts", F.unix_micros("ts").alias("at"), "id", F.col("value").cast("long").alias("value"))
    return run_in_order(rows, CounterIncrease(pane_seconds * 1000), INCREASES)


class FlushBuffer(InOrder):
    """Records of a model in batches: full after so many, or due when the first one is so old, whichever comes first."""

    value = "string"
    kept = columns(batch="long", first="long", records=T.ArrayType(T.StringType()))

    def __init__(self, records: int, age_ms: int):
        self.records, self.age = records, age_ms

    def _written(self, key, state, cause):
        batch, first, held = state
        return Row(key=key, batch=batch, size=len(held), first_ms=first, cause=cause, records=list(held)), (batch + 1, None, [])

    def take(self, key, state, ms, at, value):
        state = state or (0, None, [])
        if state[2] and ms >= state[1] + self.age:
            row, state = self._written(key, state, "age")
            yield row
        batch, first, held = state
        state = (batch, ms if first is None else first, [*held, value])
        if len(state[2]) >= self.records:
            row, state = self._written(key, state, "count")
            yield row
        yield state

    def settle(self, key, state, watermark):
        if state is not None and state[2] and state[1] + self.age <= watermark:
            row, state = self._written(key, state, "age")
            yield row
        yield state

    def wake(self, state):
        return state[1] + self.age if state is not None and state[2] else None


FLUSHES = columns(key="string", batch="long", size="long", first_ms="long", cause="string", records=T.ArrayType(T.StringType()))


def flush_stream(records: DataFrame, max_records: int = FLUSH_RECORDS, age_seconds: float = FLUSH_SECONDS) -> DataFrame:
    """``key, batch, size, first_ms, cause, records`` of every buffer that is written, from ``key, ts`` (with watermark)``, id, record``.

    A key holds fewer than ``max_records`` records, so the state of a busy model is as small as that of a quiet one.
    """
    rows = records.select("key", "ts", F.unix_micros("ts").alias("at"), "id", F.col("record").alias("value"))
    return run_in_order(rows, FlushBuffer(max_records, int(age_seconds * 1000)), FLUSHES)
