"""The job lane as streams: state per batch with one terminal event each, and windows of requests.

State is a few integers a key, so it stays small however many items a batch has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.operators.jobs import STATES

_COUNTS = ", ".join(f"{s} long" for s in STATES)
EVENTS = f"batch_id long, status string, {_COUNTS}"


def _status(n: dict[str, int]) -> str | None:
    """The terminal status of a batch's counts, null while items are open."""
    if n["pending"] or n["running"] or not sum(n.values()):
        return None
    if not n["failed"] and not n["cancelled"]:
        return "completed"
    if not n["succeeded"]:
        return "cancelled" if n["cancelled"] else "failed"
    return "partially_failed"


def batch_events(changes: DataFrame, at: str | None = None, late: str = "1 hour", remember: float = 7 * 24 * 3600) -> DataFrame:
    """changes: a stream of (batch_id, total_items, was, now), one per item's change of state, `was` null for
    a new item. One event per batch, when all its items have ended; later changes give no second one.

    With `at`, the time of a change, a finished batch's state is dropped `remember` seconds of event time after
    its last change; without it all states stay.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n = dict(zip((*STATES, "total", "done"), state.get if state.exists else (0,) * (len(STATES) + 2)))
        latest = 0
        for frame in frames:
            if at:
                latest = max(latest, int(frame[at].max().timestamp() * 1000))
            for sign, column in ((-1, "was"), (1, "now")):
                for s, k in frame[column].dropna().value_counts().items():
                    n[s] += sign * int(k)
            n["total"] = max(n["total"], int(frame["total_items"].max()))
        counts = {s: n[s] for s in STATES}
        status = _status(counts) if sum(counts.values()) >= n["total"] else None
        emit = status is not None and not n["done"]
        n["done"] = int(n["done"] or emit)
        state.update(tuple(n.values()))
        if n["done"]:
            dropped = max(latest, state.getCurrentWatermarkMs()) + int(remember * 1000) if at else None
            if dropped is not None:
                state.setTimeoutTimestamp(dropped)
        if emit:
            yield pd.DataFrame([{"batch_id": key[0], "status": status, **counts}])

    timeout = GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout
    timed = changes.withWatermark(at, late) if at else changes
    return timed.groupBy("batch_id").applyInPandasWithState(step, EVENTS, _COUNTS + ", total long, done long", "append", timeout)


def request_windows(requests: DataFrame, late: str = "10 seconds", limit: int = 200) -> DataFrame:
    """requests: a stream of (user_id, ts). Requests of each second and how many of them the limit allows;
    a window closes when the watermark passes it."""
    return (
        requests.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 second")).agg(F.count("*").alias("n"))
        .select("user_id", F.col("window.start").alias("window_start"), "n", F.least("n", F.lit(limit)).alias("allowed"))
    )


def exactly_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of each (batch_id, event_type) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["batch_id", "event_type"])
