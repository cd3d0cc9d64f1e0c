"""Online lockout over raw login attempts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.lockout import LOCK_WINDOW, MAX_FAILURES
from parley.streaming.state import needs_state_store


def stream_lockout(
    attempts: DataFrame,
    key: str = "user_id",
    max_failures: int = MAX_FAILURES,
    window: timedelta = LOCK_WINDOW,
    delay: str = "1 hour",
) -> DataFrame:
    """Decide every attempt: refused while the key is locked, else recorded or clearing.

    A refused attempt is not recorded and does not extend the lock. Attempts wait in the state until the
    watermark, ``delay`` behind the newest attempt, has passed them, and are decided in the order of their time
    (then id): the result does not depend on how they arrive, as long as none is later than the delay. They wait as
    windows of one millisecond of a key, a built-in aggregation, so no key's history is ever one value. What a micro-batch's
    watermark has passed comes out of it at once, and Python is called once for each key that has such attempts, not for
    each attempt: it reads them in order, and only the key's ``max_failures`` recorded times are carried on, until the last has
    left the window. The newest attempts are decided when later ones arrive. This kind of state needs the RocksDB store
    (``parley.streaming.state.state_store``), which the caller chooses for the session; without it this is an error before anything runs.
    """
    span = window // timedelta(microseconds=1)
    rows = attempts.select(
        F.col(key).alias("key"),
        "id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "ok",
    ).withWatermark("ts", delay)

    key_type = attempts.schema[key].dataType.simpleString()
    id_type = attempts.schema["id"].dataType.simpleString()
    needs_state_store(attempts.sparkSession)
    waiting = rows.groupBy("key", F.window("ts", "1 millisecond").alias("moment")).agg(F.collect_list(F.struct("us", "id", "ok")).alias("held"))
    passed = waiting.select("key", F.window_time("moment").alias("ts"), "held")
    decided = passed.groupBy("key").transformWithState(
        Lockout(max_failures, span),
        f"key {key_type}, id {id_type}, failures int, refused boolean",
        "Append",
        "EventTime",
    )
    return decided.withColumnRenamed("key", key)


class Lockout(StatefulProcessor):
    """The recorded failures of a key; its rows are the milliseconds that the watermark has passed since the last batch."""

    def __init__(self, max_failures: int, span: int):
        self.max_failures, self.span = max_failures, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recorded = handle.getValueState("recorded", "failures array<long>, expiry long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        attempts = sorted(((a["us"], a["id"], a["ok"]) for row in rows for a in row["held"]), key=lambda attempt: (attempt[0], attempt[1] is None, attempt[1]))
        stored = self.recorded.get()
        recorded, expiry = (list(stored[0]), stored[1]) if stored else ([], None)
        decided = []
        for us, id_, ok in attempts:
            recorded = [t for t in recorded if us - t < self.span]
            refused = len(recorded) >= self.max_failures
            if not refused:
                recorded = [] if ok else [*recorded, us]
            decided.append(Row(key=key[0], id=id_, failures=len(recorded), refused=refused))
        ends = (recorded[-1] + self.span) // 1000 + 1 if recorded else None
        if expiry != ends and expiry is not None:
            self.handle.deleteTimer(expiry)
        if ends is None:
            if stored:
                self.recorded.clear()
        else:
            if expiry != ends:
                self.handle.registerTimer(ends)
            self.recorded.update((recorded, ends))
        return iter(decided)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The last recorded failure has left the window of all attempts to come."""
        self.recorded.clear()
        return iter(())

    def close(self) -> None:
        pass
