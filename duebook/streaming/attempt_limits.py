"""The accepted-only limit over a live stream of attempts, keyed state per
(kind, key): at most `limit` times, dropped when the window has passed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from duebook.operators.attempts import KEY, LIMITS, AcceptedOnly, with_limits


def _decide(key, frames, state):
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("us", kind="stable")
    step = AcceptedOnly(state.get[0] if state.exists else None)
    accepted = [step.feed(r, None)[0] for r in zip(
        rows["us"].tolist(), rows["limit"].tolist(), rows["width"].tolist(),
        rows["cleared"].tolist())]
    state.update((step.tail(),))
    last = json.loads(step.tail())
    if last:
        until = (last[-1] + int(rows["width"].iloc[0])) // 1000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"kind": key[0], "key": key[1], "at": rows["at"].tolist(),
                        "accepted": accepted})


def limited(attempts: DataFrame, limits=LIMITS, lateness: str = "10 minutes") -> DataFrame:
    """Stream of (kind, key, at, accepted) for a stream of (kind, key, at)."""
    rows = with_limits(attempts.withColumn("when", attempts["at"]), limits)
    return (rows.withColumnRenamed("when", "at").withWatermark("at", lateness)
            .groupBy(*KEY)
            .applyInPandasWithState(
                _decide, "kind string, key string, at timestamp, accepted boolean",
                "accepted_times string", "append", GroupStateTimeout.EventTimeTimeout))
