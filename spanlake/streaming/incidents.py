"""Incident state per monitor over a stream of evaluations and actions, in event time.

Events may arrive in any order within a delay.  They wait in the state of their monitor until the watermark has
passed them, and only then are folded, in the same total order as the batch form: the changes of a monitor do not
depend on how its events were dealt over files and micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.incidents import KEY, incident_id

#: How late an event may be, at least.
DELAY = "10 minutes"
#: Kind of rows that only move event time on: without a later row no event is known to be in time.
CLOCK = "clock"

_CHANGES = ("tenant_id string, monitor_id string, status string, triggered_us long, at_us long, "
            "trigger_value double")
_OPEN = "status string, opened long, value double"
_WAITING = "at long, step int, kind string, value double"

#: (open status, event) → next status; '' means that no incident is open.
MOVES = {
    ("", "violation"): "triggered",
    ("triggered", "normal"): "resolved",
    ("triggered", "acknowledge"): "acknowledged",
    ("triggered", "resolve"): "resolved",
    ("acknowledged", "resolve"): "resolved",
}


def _folding() -> StatefulProcessor:
    """The stateful processor.  A nested class travels to the workers by value, so they need not have this
    package installed."""
    moves, clock = MOVES, CLOCK

    def order(event: tuple) -> tuple:
        at, step, kind, value = event
        return at, step, kind, value is not None, value or 0.0

    class Folding(StatefulProcessor):
        """One monitor: events that wait for the watermark, and its open incident."""

        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", _OPEN)
            self.waiting = handle.getListState("waiting", _WAITING)

        def _wake(self, events: list[tuple]) -> None:
            if events:
                self.handle.registerTimer(-(-min(e[0] for e in events) // 1000))

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            events = [(r["at_us"], r["step"], r["kind"], r["value"]) for r in rows
                      if r["kind"] != clock and r["at_us"] > mark]
            if events:
                self.waiting.appendList(events)
                self._wake(events)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            events = [tuple(e) for e in self.waiting.get()]
            due = sorted((e for e in events if e[0] <= mark), key=order)
            rest = [e for e in events if e[0] > mark]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self._wake(rest)
            status, opened, value = self.open.get() if self.open.exists() else ("", None, None)
            before = status, opened, value
            for at, _, kind, seen in due:
                after = moves.get((status, kind), status)
                if after == status:
                    continue
                if status == "":
                    opened, value = at, seen
                yield Row(tenant_id=key[0], monitor_id=key[1], status=after, triggered_us=opened, at_us=at,
                          trigger_value=value)
                status = "" if after == "resolved" else after
            if status:
                if (status, opened, value) != before:
                    self.open.update((status, opened, value))
            elif before[0]:
                self.open.clear()

    return Folding()


def incidents_stream(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Status changes (append) of incidents.

    ``events`` is the time line of :func:`~spanlake.operators.incidents.as_events`.  State is one small row per
    monitor with an open incident, and its events of the last ``delay``.  An event at or behind the watermark
    when it arrives changes nothing; Spark counts it in ``numRowsDroppedByWatermark``.  The last events come out
    once a later one, or a row of kind CLOCK (any tenant and monitor), has moved the watermark past them.
    """
    timed = (events.withWatermark("at", delay)
             .select(*KEY, "at", F.unix_micros("at").alias("at_us"), "step", "kind", "value"))
    changes = timed.groupBy(*KEY).transformWithState(
        statefulProcessor=_folding(), outputStructType=_CHANGES, outputMode="append", timeMode="eventTime")
    return (changes.select(*KEY, "status", F.timestamp_micros("triggered_us").alias("triggered_at"),
                           F.timestamp_micros("at_us").alias("at"), "trigger_value")
            .withColumn("incident_id", incident_id(F.col("triggered_at"))))


def latest_status(changes: DataFrame) -> DataFrame:
    """Current incidents out of the stored changes; same columns as the batch form."""
    steps = F.array(*[F.lit(s) for s in ("triggered", "acknowledged", "resolved")])
    last = changes.groupBy("incident_id", *KEY, "triggered_at").agg(
        F.max_by("status", F.struct("at", F.array_position(steps, F.col("status")))).alias("status"),
        F.max(F.when(F.col("status") == "resolved", F.col("at"))).alias("resolved_at"),
        F.max("trigger_value").alias("trigger_value"))
    return last.select("incident_id", *KEY, "status", "triggered_at", "resolved_at",
                       "trigger_value")
