"""Daily sketches of the message table: distinct counts and quantiles over any range of days from one small row per day.

The exact operators stay the default. A sketch is made once per day, stored beside the table and merged over the
days of a range, so a year's distinct conversations cost as many rows as the year has days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.timing import Day, as_day

#: Binary logarithm of the registers of a distinct count, and its relative error at three standard deviations.
LOG_REGISTERS = 14
DISTINCT_BOUND = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)
#: Size of a quantile sketch, and how far the rank of a quantile may be off (at 99 % confidence).
QUANTILE_K = 400
RANK_BOUND = 0.01


def daily_sketches(messages: DataFrame) -> DataFrame:
    """``date, messages, answers, conversations, users, response_times``: a row per day, the last three are sketches.

    Partial sketches are combined before the shuffle; a NULL counts nowhere, a day without answers has no quantile sketch.
    """
    return messages.where(F.col("timestamp").isNotNull()).groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("messages"),
        F.count("response_time").alias("answers"),
        F.hll_sketch_agg("conversation_id", F.lit(LOG_REGISTERS)).alias("conversations"),
        F.hll_sketch_agg("user_id", F.lit(LOG_REGISTERS)).alias("users"),
        F.when(
            F.count("response_time") > 0, F.kll_sketch_agg_bigint(F.col("response_time").cast("long"), F.lit(QUANTILE_K))
        ).alias("response_times"),
    )


def range_from_sketches(sketches: DataFrame, start: Day, end: Day, quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row for the days from ``start`` to ``end``: total_messages, total_conversations, unique_users and ``response_q<percent>`` in seconds.

    Distinct counts are within ``DISTINCT_BOUND`` of the exact ones, a quantile's rank within ``RANK_BOUND``. Counts of an
    empty range are 0, its quantiles NULL.
    """
    chosen = sketches.where(F.col("date").between(F.lit(as_day(start)), F.lit(as_day(end))))
    merged = chosen.agg(
        F.coalesce(F.sum("messages"), F.lit(0)).alias("total_messages"),
        F.coalesce(F.sum("answers"), F.lit(0)).alias("answers"),
        F.hll_sketch_estimate(F.hll_union_agg("conversations")).alias("total_conversations"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"),
        F.kll_merge_agg_bigint("response_times").alias("response_times"),
    )
    quantile = [
        F.when(F.col("answers") > 0, F.kll_sketch_get_quantile_bigint("response_times", F.lit(float(q)))).alias(f"response_q{round(100 * q)}")
        for q in quantiles
    ]
    return merged.select("total_messages", "total_conversations", "unique_users", *quantile)
