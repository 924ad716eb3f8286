"""Orders that take too long: one small state machine, run on streams with event-time timers and on batches by replay.

An order starts at its PLACED event, or the earliest seen until that arrives. Its status only moves forward. If it is
still open when the timer at start + sla fires, it is in breach; if it is then delivered, that is reported once. Finished
orders and breaches are remembered for ttl, so a straggler doesn't open the order anew.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brookmill.operators.latest import rank_of
from brookmill.schemas import ALERTS, STATUS_RANK

FINAL = ("DELIVERED", "CANCELLED")
STATE = "zone string, restaurant_id string, first_seen long, placed long, status string, rank int, last_seen long, breached boolean, closed boolean"
_COLUMNS = [c.split()[0] for c in ALERTS.split(", ")]
_REPLAYED = [*_COLUMNS[:-1], "open_ms"]


@dataclass(frozen=True)
class Order:
    """State of one order; times in epoch milliseconds."""

    zone: str | None
    restaurant_id: str | None
    first_seen: int
    placed: int | None
    status: str | None
    rank: int
    last_seen: int
    breached: bool = False
    closed: bool = False

    @property
    def start(self) -> int:
        return self.first_seen if self.placed is None else self.placed

    def seen(self, status: str | None, at: int) -> Order:
        rank = STATUS_RANK.get(status, 0)
        ahead = (rank, at) > (self.rank, self.last_seen) if rank == self.rank else rank > self.rank
        placed = self.placed
        if status == "PLACED":
            placed = at if placed is None else min(placed, at)
        return replace(
            self,
            first_seen=min(self.first_seen, at),
            placed=placed,
            status=status if ahead else self.status,
            rank=rank if ahead else self.rank,
            last_seen=max(self.last_seen, at),
        )


@dataclass(frozen=True)
class Step:
    """Outcome of events or of a timer: the state (None: forget the order), alerts (kind, at, open for ms), and when to fire."""

    state: Order | None
    alerts: tuple = ()
    timer: int | None = None


@dataclass(frozen=True)
class Policy:
    sla: int
    ttl: int

    def events(self, state: Order | None, events: Iterable[tuple], watermark: int) -> Step:
        """events: (status, at, zone, restaurant_id) in any order."""
        was_closed = state is not None and state.closed
        for status, at, zone, restaurant in sorted(events, key=lambda e: e[1]):
            if state is None:
                state = Order(zone, restaurant, at, None, status, STATUS_RANK.get(status, 0), at)
            state = state.seen(status, at)
        if state is None:
            return Step(None)
        if state.status in FINAL:
            late = not was_closed and state.breached and state.status == "DELIVERED"
            alerts = (("DELIVERED_AFTER_BREACH", state.last_seen, state.last_seen - state.start),) if late else ()
            return Step(replace(state, closed=True), alerts, max(state.last_seen + self.ttl, watermark + 1))
        due = state.start + (self.ttl if state.breached else self.sla)
        return Step(state, (), max(due, watermark + 1))

    def fired(self, state: Order, watermark: int) -> Step:
        if state.closed or state.breached:
            return Step(None)
        alert = ("SLA_BREACH", watermark, watermark - state.start)
        return Step(replace(state, breached=True), (alert,), max(state.start + self.ttl, watermark + 1))


def _frame(order_id: str, step: Step, known: Order) -> pd.DataFrame:
    stamp = lambda ms: pd.Timestamp(ms, unit="ms")
    rows = [(order_id, known.zone, known.restaurant_id, kind, known.status, stamp(known.start), stamp(at), open_for / 1000.0) for kind, at, open_for in step.alerts]
    return pd.DataFrame(rows, columns=_COLUMNS)


class SlaProcessor(StatefulProcessor):
    """The state machine with one value and one event-time timer for each order."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = handle.getValueState("order", STATE)

    def _keep(self, step: Step, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if step.state is None:
            self.order.clear()
            return
        s = step.state
        self.order.update((s.zone, s.restaurant_id, s.first_seen, s.placed, s.status, s.rank, s.last_seen, s.breached, s.closed))
        self.handle.registerTimer(step.timer)

    def _known(self) -> Order | None:
        got = self.order.get() if self.order.exists() else None
        return None if got is None else Order(*got)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        events = [(status, pd.Timestamp(at).value // 1_000_000, zone, restaurant) for pdf in rows for status, at, zone, restaurant in zip(pdf["status"], pdf["event_ts"], pdf["zone"], pdf["restaurant_id"])]
        step = self.policy.events(self._known(), events, watermark)
        self._keep(step, watermark)
        return iter([_frame(key[0], step, step.state)] if step.alerts else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        if known is None:
            return iter([])
        watermark = timerValues.getCurrentWatermarkInMs()
        step = self.policy.fired(known, watermark)
        self._keep(step, watermark)
        return iter([_frame(key[0], step, known)] if step.alerts else [])

    def close(self) -> None:
        pass


def sla_alerts(orders: DataFrame, sla_seconds: int, ttl_seconds: int, delay: str) -> DataFrame:
    """Alerts of a stream of order events."""
    narrow = orders.select("order_id", "status", "event_ts", "zone", "restaurant_id").withWatermark("event_ts", delay)
    alerts = narrow.groupBy("order_id").transformWithStateInPandas(SlaProcessor(Policy(sla_seconds * 1000, ttl_seconds * 1000)), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime")
    return alerts.withColumn("emitted_at", F.current_timestamp())


def _replay(policy: Policy):
    """Runs the machine over Arrow batches in order of (order, time); an order may span batches, and only its state is held."""
    schema = pa.schema([(c, pa.int64() if c in ("placed_ts", "detected_at", "open_ms") else pa.string()) for c in _REPLAYED])

    def run(batches):
        order = state = timer = None
        out: list[tuple] = []

        def alert(known: Order, step: Step) -> None:
            out.extend((order, known.zone, known.restaurant_id, kind, known.status, known.start, at, open_for) for kind, at, open_for in step.alerts)

        def until(now: int | None) -> None:
            """Fires what is due before now; all that is left without one."""
            nonlocal state, timer
            while state is not None and (now is None or timer < now):
                step = policy.fired(state, timer)
                alert(state, step)
                state, timer = step.state, step.timer

        def flushed() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
            out.clear()
            return found

        for batch in batches:
            for key, status, at, zone, restaurant in zip(*[c.to_pylist() for c in batch.columns]):
                if key != order:
                    until(None)
                    order = key
                until(at)
                step = policy.events(state, [(status, at, zone, restaurant)], at - 1)
                alert(step.state, step)
                state, timer = step.state, step.timer
            yield flushed()
        until(None)
        yield flushed()

    return run


def replayed(orders: DataFrame, sla_seconds: int, ttl_seconds: int) -> DataFrame:
    """Alerts of whole histories by the same machine, as a stream gives them whose watermark follows each order's events closely
    and ends beyond all timers. Rows without an order or a time are left out, as the rules of orders leave them out.
    """
    millis = F.unix_millis(F.col("event_ts").cast("timestamp")).alias("at")
    rows = orders.where("order_id IS NOT NULL AND event_ts IS NOT NULL").select(F.col("order_id").cast("string").alias("order_id"), "status", millis, "zone", "restaurant_id")
    sorted_ = rows.repartition("order_id").sortWithinPartitions("order_id", "at", F.coalesce(rank_of("status"), F.lit(0)))
    found = sorted_.mapInArrow(_replay(Policy(sla_seconds * 1000, ttl_seconds * 1000)), ", ".join(f"{c} {'long' if c in ('placed_ts', 'detected_at', 'open_ms') else 'string'}" for c in _REPLAYED))
    times = {c: F.timestamp_millis(c) for c in ("placed_ts", "detected_at")} | {"open_seconds": F.col("open_ms") / 1000}
    return found.withColumns(times).select(*_COLUMNS)
