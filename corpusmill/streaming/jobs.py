"""Structured Streaming forms of the append-driven operators.

daily_counts, sessions, nonces and admissions equal their batch twins at the end of input if rows arrive in order of time
within the watermark; a row of a key that arrives later than a newer one of it is judged at the time it arrives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling one-day counts by event type with a watermark for late rows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Session windows per user; a gap of the limit or longer opens a new session."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", "n", "first_id")


def nonces(events: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """(user_id, nonce, event_id, accepted): a nonce is refused until the days have passed since its last accepted use.

    The state of a key is one time; it goes when the watermark has passed it by so much that it refuses no row any more.
    """
    ttl = 86_400 * days

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(["s", "event_id"])
        ok = []
        for t in rows["s"].tolist():
            fresh = last is None or t - last >= ttl
            last = t if fresh else last
            ok.append(fresh)
        state.update((last,))
        state.setTimeoutTimestamp(max(1000 * (last + ttl), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(user_id=key[0], nonce=key[1], accepted=ok)[["user_id", "nonce", "event_id", "accepted"]]

    rows = events.withWatermark("ts", late).where("user_id IS NOT NULL AND nonce IS NOT NULL AND ts IS NOT NULL").select("ts", "user_id", "nonce", "event_id", F.col("ts").cast("long").alias("s"))
    return rows.groupBy("user_id", "nonce").applyInPandasWithState(
        run, "user_id long, nonce long, event_id long, accepted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def admissions(events: DataFrame, cap: int = 1000, hours: int = 24, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, admitted, retry_after): a sliding limit that counts admitted requests only; the state is at most cap times."""
    span = 3600 * hours

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["s", "event_id"])
        wait = []
        for t in rows["s"].tolist():
            recent = [x for x in recent if x > t - span]
            wait.append(0 if len(recent) < cap else recent[0] + span - t)
            if not wait[-1]:
                recent.append(t)
        state.update((recent,))
        state.setTimeoutTimestamp(max(1000 * (recent[-1] + span), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "admitted": [not w for w in wait], "retry_after": wait})

    rows = events.withWatermark("ts", late).where("user_id IS NOT NULL AND ts IS NOT NULL").select("ts", "user_id", "event_id", F.col("ts").cast("long").alias("s"))
    return rows.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, event_id long, admitted boolean, retry_after long", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand every micro-batch of all available input to step(batch, number), each once; progress is kept in the checkpoint folder."""
    stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input once and return what was emitted (for tests and small reports)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
