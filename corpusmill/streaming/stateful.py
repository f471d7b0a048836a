"""Operators with state of their own as streams: admission by rate, refused replays, distinct queries of a fact, and the ingest gate.

State lives in the state store under typed names and goes when its time has passed: by a timer of event time where the rule
is one of time. Every operator equals its batch twin at the end of input if the rows of a key arrive in order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators import screening
from corpusmill.operators.snapshots import append_batch, appended
from corpusmill.streaming.jobs import each_batch

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replays(StatefulProcessor):
    """A nonce of a user is refused until the time has passed since its last accepted use."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "s long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        rows, ok = pd.concat(rows).sort_values(["s", "event_id"]), []
        for t in rows["s"].tolist():
            ok.append(last is None or t - last >= self.ttl)
            last = t if ok[-1] else last
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(1000 * (last + self.ttl))
        yield pd.DataFrame({"user_id": key[0], "nonce": key[1], "event_id": rows["event_id"].to_numpy(), "accepted": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


class Admissions(StatefulProcessor):
    """A user's requests are admitted up to a cap in a sliding span that counts admitted ones only."""

    def __init__(self, cap: int, span: int):
        self.cap, self.span = cap, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.recent = handle, handle.getListState("recent", "s long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = [r[0] for r in self.recent.get()]
        rows, wait = pd.concat(rows).sort_values(["s", "event_id"]), []
        for t in rows["s"].tolist():
            recent = [x for x in recent if x > t - self.span]
            wait.append(0 if len(recent) < self.cap else recent[0] + self.span - t)
            if not wait[-1]:
                recent.append(t)
        self.recent.put([(x,) for x in recent])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(1000 * (recent[-1] + self.span))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "admitted": [not w for w in wait], "retry_after": wait})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


class DistinctQueries(StatefulProcessor):
    """The queries that have hit a fact, as a map that never forgets; a count is given whenever it has grown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen, self.count = handle.getMapState("seen", "qhash long", "one boolean"), handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = n = self.count.get()[0] if self.count.exists() else 0
        for batch in rows:
            for q in batch["qhash"].unique().tolist():
                if not self.seen.containsKey((q,)):
                    self.seen.updateValue((q,), (True,))
                    n += 1
        if n > before:
            self.count.update((n,))
            yield pd.DataFrame({"fact_id": [key[0]], "queries": [n]})

    def close(self) -> None:
        pass


def _timed(events: DataFrame, late: str, *keys: str) -> DataFrame:
    known = events.withWatermark("ts", late).where(" AND ".join(f"{k} IS NOT NULL" for k in (*keys, "ts")))
    return known.select("ts", "event_id", *keys, F.col("ts").cast("long").alias("s"))


def _with_rocks(events: DataFrame) -> None:
    events.sparkSession.conf.set(STORE, ROCKS)  # the only store that such operators run on


def replays(events: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """(user_id, nonce, event_id, accepted) of a stream (event_id, user_id, nonce, ts); rows with a null among them are left out."""
    _with_rocks(events)
    rows = _timed(events, late, "user_id", "nonce").groupBy("user_id", "nonce")
    return rows.transformWithStateInPandas(Replays(86_400 * days), "user_id long, nonce long, event_id long, accepted boolean", "append", "eventtime")


def admissions(events: DataFrame, cap: int = 1000, hours: int = 24, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, admitted, retry_after) of a stream (event_id, user_id, ts); a user's state is at most cap times."""
    _with_rocks(events)
    rows = _timed(events, late, "user_id").groupBy("user_id")
    return rows.transformWithStateInPandas(Admissions(cap, 3600 * hours), "user_id long, event_id long, admitted boolean, retry_after long", "append", "eventtime")


def distinct_queries(reads: DataFrame) -> DataFrame:
    """(fact_id, queries) of a stream (fact_id, qhash), in update mode: a fact's count each time that it grows."""
    _with_rocks(reads)
    return reads.where("fact_id IS NOT NULL AND qhash IS NOT NULL").groupBy("fact_id").transformWithStateInPandas(DistinctQueries(), "fact_id long, queries long", "update", "none")


def gate(turns: DataFrame, text: str) -> DataFrame:
    """A stream of turns with the decision of the capture gate: no state, so that any number of tasks share it."""
    return turns.withColumn("decision", screening.capture_gate(F.col(text)))


def run_through(stream: DataFrame, path: str, mode: str = "append", step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run all available input into a table below path, batch by batch, each through step first; gives the whole table.

    Called again later with the same path it goes on where it stopped; a batch that is run twice is in the table once.
    """
    def write(batch: DataFrame, number: int) -> None:
        append_batch(step(batch) if step else batch, number, f"{path}/table")

    each_batch(stream, write, f"{path}/progress", mode)
    return appended(stream.sparkSession, f"{path}/table")
