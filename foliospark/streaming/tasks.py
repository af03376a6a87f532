"""Streaming twins of the task-state operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_requests(events: DataFrame, key: list[str], at: str = "ts", keep: str = "1 day") -> DataFrame:
    """Exactly-once by idempotency key: the first event of a key within the watermark."""
    return events.withWatermark(at, keep).dropDuplicatesWithinWatermark(key)


def activity(events: DataFrame, at: str = "ts", late: str = "30 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type; late ones are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def leases(events: DataFrame, minutes: int = 30, timer: bool = False) -> DataFrame:
    """(key, event_id, granted) of lease requests (key, event_id, ts): refused while another's lease runs.

    State per key is one expiry; a key's events of a micro-batch are taken in order of time.
    With ``timer``, for queries that run on, a key that is quiet for as long as a lease is
    forgotten; a query that ends when all is read (``availableNow``) must not wait for timers.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        expiry = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        granted = []
        for at in rows["at"]:
            ok = at >= expiry
            if ok:
                expiry = int(at) + minutes * 60_000_000
            granted.append(ok)
        state.update((int(expiry),))
        if timer:
            state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "granted": granted})

    rows = events.select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, event_id long, granted boolean", "expiry long", "append", GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout)


def triggers(events: DataFrame, count: int = 4, seconds: int = 21_600, timer: bool = False) -> DataFrame:
    """(key, event_id, win): a window closes with its ``count``-th event or ``seconds`` after its first.

    With ``timer``, for queries that run on, a key that is quiet for ``seconds`` has its
    window closed: a row without an event tells its number, and the next event opens the
    one after it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            win = state.get[0]
            state.update((int(win), 0, count))
            yield pd.DataFrame({"key": [key[0]], "event_id": pd.array([None], dtype="Int64"), "win": [int(win)]})
            return
        win, opened, n = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for at in rows["at"]:
            if win == 0 or n >= count or at - opened >= seconds * 1_000_000:
                win, opened, n = win + 1, int(at), 0
            n += 1
            out.append(win)
        state.update((int(win), int(opened), int(n)))
        if timer:
            state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "win": out})

    rows = events.select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, event_id long, win long", "win long, opened long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout)
