"""Repeated-failure lockout over a log of recorded attempts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.timing import epoch_micros

# Failures that lock a key, and how long they count.
MAX_FAILURES = 5
LOCK_WINDOW = timedelta(minutes=15)


def failure_lockout(
    attempts: DataFrame,
    key: str,
    max_failures: int = MAX_FAILURES,
    window: timedelta = LOCK_WINDOW,
    slice_width: timedelta | None = None,
) -> DataFrame:
    """Flag the recorded failures at which a key has ``max_failures`` in the window.

    ``attempts``: id, ts, ``key``, ok. An attempt counts while it is younger than the window and
    no success followed it. A key is cut into time slices; the last window of a slice is also
    given to the next one, which is all the history its rows can depend on, so a key of any
    size is spread over its slices. They are twice as long as the window unless a ``slice_width`` is given: half of the
    rows are then in two slices, and no slice holds more than what a key fails in two windows.
    """
    span = window // timedelta(microseconds=1)
    width = (slice_width or 2 * window) // timedelta(microseconds=1)
    if width < span:
        raise ValueError("a slice must be at least as long as the window")
    timed = attempts.select("id", key, "ts", "ok", epoch_micros(F.col("ts")).alias("_us"))
    own = F.floor(F.col("_us") / width)
    spread = F.when(
        F.pmod(F.col("_us"), F.lit(width)) >= width - span, F.array(own, own + 1)
    ).otherwise(F.array(own))
    sliced = timed.withColumn("_own", own).withColumn("_slice", F.explode(spread))

    ordered = Window.partitionBy(key, "_slice").orderBy("_us", "id")
    cleared = F.sum(F.col("ok").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    streaks = sliced.withColumn("_streak", cleared)
    recent = Window.partitionBy(key, "_slice", "_streak").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = streaks.withColumn("failures", F.count_if(~F.col("ok")).over(recent))
    return counted.filter((F.col("_slice") == F.col("_own")) & ~F.col("ok")).select(
        "id", key, "ts", "failures", (F.col("failures") >= max_failures).alias("locked")
    )
