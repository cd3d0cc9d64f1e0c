"""Counts, distributions, trends and satisfaction over the message table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.lexical import NEUTRAL_SATISFACTION, satisfaction_score
from parley.functions.timing import (
    RESPONSE_CAP,
    Day,
    as_day,
    in_business_hours,
    in_days,
    local_time,
    response_band,
)
from parley.operators.filters import date_range, last_days, null_state, one_day, response_cap

DIGITS = 6

# Impact labels (fixed wording) by the size of a correlation (limits of our own).
IMPACT_BANDS = ((0.85, "สูงมาก"), (0.7, "สูง"), (0.5, "ปานกลาง"), (0.0, "ต่ำ"))


def share_of_total(counted: DataFrame, count: str = "count", share: str = "share") -> DataFrame:
    """Percentage of the total; only for an already grouped, small frame."""
    whole = F.sum(count).over(Window.partitionBy())
    return counted.withColumn(share, F.round(100.0 * F.col(count) / whole, DIGITS))


def day_of(messages: DataFrame, tz: str | None = None) -> Column:
    return F.to_date(local_time(messages, "timestamp", tz))


# -- conversation and message counts ----------------------------------------------------


def total_conversations(messages: DataFrame, approx: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approx else F.countDistinct
    return messages.agg(counter("conversation_id").alias("total"))


def day_conversations(messages: DataFrame, day: Day, approx: bool = False) -> DataFrame:
    return total_conversations(one_day(messages, day), approx)


def _per_pair(messages: DataFrame, *by: Column | str) -> DataFrame:
    """One row per conversation and user with what the KPIs need.

    Two distinct counts in one aggregate make Spark copy every input row once per distinct
    column. Grouping first, with map-side combine, means only the much smaller result is copied.
    """
    return messages.groupBy(*by, "conversation_id", "user_id").agg(
        F.count("*").alias("_messages"),
        F.sum(F.col("response_time").cast("long")).alias("_seconds"),
        F.count("response_time").alias("_answers"),
        F.max(F.col("sender_type") == "customer").alias("_customer"),
    )


def _kpi_columns(customers_only: bool) -> list[Column]:
    user = F.when(F.col("_customer"), F.col("user_id")) if customers_only else F.col("user_id")
    minutes = F.try_divide(F.sum("_seconds"), F.sum("_answers")) / 60.0
    return [
        F.countDistinct("conversation_id").alias("total_conversations"),
        F.coalesce(F.sum("_messages"), F.lit(0)).cast("long").alias("total_messages"),
        F.countDistinct(user).alias("unique_users"),
        F.coalesce(F.round(minutes, DIGITS), F.lit(0.0)).alias("avg_response_minutes"),
    ]


def range_kpis(
    messages: DataFrame, start: Day, end: Day, tz: str | None = None, customers_only: bool = False
) -> DataFrame:
    """All four headline numbers from one scan."""
    return _per_pair(date_range(messages, start, end, tz)).agg(*_kpi_columns(customers_only))


def kpi_change(messages: DataFrame, start: Day, end: Day, customers_only: bool = False) -> DataFrame:
    """The range against the equally long range before it: one row per measure."""
    first, last = as_day(start), as_day(end)
    before = first - (last - first + timedelta(days=1))
    both = date_range(messages, before, last)
    period = F.when(in_days(both, "timestamp", first, last), "current").otherwise("previous")
    kpis = _per_pair(both.withColumn("period", period), "period").groupBy("period").agg(
        *_kpi_columns(customers_only)
    )
    measures = [
        "total_conversations", "total_messages", "unique_users", "avg_response_minutes",
    ]
    pairs = []
    for m in measures:
        for p in ("current", "previous"):
            value = F.max(F.when(F.col("period") == p, F.col(m).cast("double")))
            pairs.append(F.coalesce(value, F.lit(0.0)).alias(f"{m}_{p}"))
    rows = F.inline(F.array(*(
        F.struct(
            F.lit(m).alias("measure"),
            F.col(f"{m}_current").alias("current"),
            F.col(f"{m}_previous").alias("previous"),
        )
        for m in measures
    )))
    change = F.col("current") - F.col("previous")
    return (
        kpis.agg(*pairs)
        .select(rows)
        .withColumn("change", F.round(change, DIGITS))
        .withColumn("change_pct", F.round(F.try_divide(100.0 * change, F.col("previous")), DIGITS))
    )


def daily_conversations(
    messages: DataFrame, start: Day, end: Day, tz: str | None = None, approx: bool = False
) -> DataFrame:
    scoped = date_range(messages, start, end, tz)
    counter = F.approx_count_distinct if approx else F.countDistinct
    return (
        scoped.groupBy(day_of(scoped, tz).alias("date"))
        .agg(counter("conversation_id").alias("conversations"), F.count("*").alias("messages"))
        .orderBy("date")
    )


def message_type_distribution(messages: DataFrame, start: Day, end: Day) -> DataFrame:
    counted = date_range(messages, start, end).groupBy("message_type").agg(F.count("*").alias("count"))
    return share_of_total(counted).orderBy(F.col("count").desc(), "message_type")


# -- sentiment ----------------------------------------------------------------------------


def sentiment_distribution(messages: DataFrame, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """The date filter applies only when both ends are given."""
    scoped = date_range(messages, start, end) if start and end else messages
    return null_state(scoped, present=("sentiment",)).groupBy("sentiment").agg(F.count("*").alias("count"))


def sentiment_trend(messages: DataFrame, as_of: Day, days: int = 30) -> DataFrame:
    end = as_day(as_of)
    scoped = null_state(date_range(messages, end - timedelta(days=days), end), present=("sentiment_score",))
    return (
        scoped.groupBy(day_of(scoped).alias("date"))
        .agg(
            F.round(F.avg(F.col("sentiment_score").cast("double")), DIGITS).alias("sentiment_score"),
            F.count("*").alias("message_count"),
        )
        .orderBy("date")
    )


def negative_share(messages: DataFrame) -> DataFrame:
    counts = messages.agg(
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.count("sentiment").alias("labelled"),
    )
    share = F.try_divide(100.0 * F.col("negative"), F.col("labelled"))
    return counts.withColumn("negative_pct", F.coalesce(F.round(share, DIGITS), F.lit(0.0)))


# -- response time --------------------------------------------------------------------------


def hourly_response(messages: DataFrame, tz: str | None = None) -> DataFrame:
    scoped = null_state(messages, present=("response_time",))
    return (
        scoped.groupBy(F.hour(local_time(scoped, "timestamp", tz)).alias("hour"))
        .agg(
            F.round(F.avg("response_time") / 60, DIGITS).alias("avg_response_minutes"),
            F.count("*").alias("message_count"),
        )
        .orderBy("hour")
    )


def response_distribution(messages: DataFrame, cap: int = RESPONSE_CAP) -> DataFrame:
    """Response minutes of every answer within the cap."""
    minutes = F.round(F.col("response_time") / 60, DIGITS).alias("response_minutes")
    return response_cap(messages, cap).select("id", minutes)


def response_histogram(messages: DataFrame, bin_minutes: float = 1.0, cap: int = RESPONSE_CAP) -> DataFrame:
    bin_no = F.floor(F.col("response_time") / (60.0 * bin_minutes)).alias("bin")
    counted = response_cap(messages, cap).groupBy(bin_no).agg(F.count("*").alias("count"))
    return counted.withColumn("from_minutes", F.col("bin") * F.lit(float(bin_minutes))).orderBy("bin")


def response_percentiles(
    messages: DataFrame, fractions: tuple[float, ...] = (0.5, 0.9, 0.99), approx: bool = False
) -> DataFrame:
    """Exact percentiles count each distinct number of seconds; beyond that use ``approx``."""
    kind = F.percentile_approx if approx else F.percentile
    return messages.agg(*(
        F.round(kind("response_time", F.lit(f)) / 60.0, DIGITS).alias(f"p{round(100 * f)}_minutes")
        for f in fractions
    ))


def response_bands(messages: DataFrame) -> DataFrame:
    scoped = null_state(messages, present=("response_time",))
    counted = scoped.groupBy(response_band(F.col("response_time")).alias("band")).agg(F.count("*").alias("count"))
    return share_of_total(counted)


def business_hours_kpis(messages: DataFrame, **hours) -> DataFrame:
    """Volume and response time inside and outside business hours."""
    inside = in_business_hours(messages, **hours).alias("business_hours")
    return messages.groupBy(inside).agg(
        F.count("*").alias("messages"),
        F.round(F.avg("response_time") / 60, DIGITS).alias("avg_response_minutes"),
    )


# -- satisfaction ---------------------------------------------------------------------------


def satisfaction_overall(messages: DataFrame) -> DataFrame:
    scored = null_state(messages, present=("sentiment",))
    mean = F.avg(satisfaction_score(F.col("sentiment")))
    return scored.agg(F.coalesce(F.round(mean, DIGITS), F.lit(NEUTRAL_SATISFACTION)).alias("overall_score"))


def satisfaction_trend(messages: DataFrame, as_of: Day, days: int = 30) -> DataFrame:
    scoped = null_state(last_days(messages, as_of, days), present=("sentiment",))
    return (
        scoped.groupBy(day_of(scoped).alias("date"))
        .agg(F.round(F.avg(satisfaction_score(F.col("sentiment"))), DIGITS).alias("satisfaction_score"))
        .orderBy("date")
    )


def impact_label(correlation: Column) -> Column:
    chain = None
    for floor, label in IMPACT_BANDS:
        hit = F.abs(correlation) >= floor
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


#: What may drive a conversation's satisfaction.
FACTORS = ("response_time", "message_length", "hour", "message_count")


def driver_measures(messages: DataFrame) -> DataFrame:
    """``score`` and the factors of every conversation."""
    return messages.groupBy("conversation_id").agg(
        F.avg(F.when(F.col("sentiment").isNotNull(), satisfaction_score(F.col("sentiment")))).alias("score"),
        F.avg("response_time").alias("response_time"),
        F.avg(F.length("message")).alias("message_length"),
        F.hour(F.min("timestamp")).cast("double").alias("hour"),
        F.count("*").cast("double").alias("message_count"),
    )


def satisfaction_drivers(messages: DataFrame) -> DataFrame:
    """Correlation of a conversation's satisfaction with what may drive it, each factor on its own."""
    measured = driver_measures(messages).agg(*(F.corr("score", f).alias(f) for f in FACTORS))
    rows = F.inline(F.array(*(
        F.struct(F.lit(f).alias("factor"), F.round(F.nanvl(F.col(f), F.lit(None)), DIGITS).alias("correlation"))
        for f in FACTORS
    )))
    return measured.select(rows).withColumn("impact", impact_label(F.col("correlation")))


def satisfaction_drivers_joint(messages: DataFrame) -> DataFrame:
    """All factors in one linear model: ``factor, coefficient, beta, partial_correlation, impact``.

    ``coefficient`` is the change of satisfaction per unit of the factor with the others held fixed, ``beta`` the same in
    standard deviations, ``partial_correlation`` what is left between satisfaction and the factor once the others
    are accounted for. Conversations without a score or without one of the factors are left out.

    One pass sums the products of every two columns (with map-side combine); the normal equations of that one row are
    then solved. A factor that never varies, or is a linear combination of others, has no values (NULL).
    """
    columns = ("score", *FACTORS)
    whole = driver_measures(messages).dropna(subset=list(columns))
    gram = whole.agg(
        F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in columns),
        *(F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]),
    )
    solved = gram.mapInPandas(_solved, "factor string, coefficient double, beta double, partial_correlation double")
    rounded = [F.round(c, DIGITS).alias(c) for c in ("coefficient", "beta", "partial_correlation")]
    return solved.select("factor", *rounded).withColumn("impact", impact_label(F.col("partial_correlation")))


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model from the one row of sums and products."""
    columns = ("score", *FACTORS)
    for frame in frames:
        for row in frame.to_dict("records"):
            n = row["n"]
            out = {f: (None, None, None) for f in FACTORS}
            if n:
                mean = np.array([row[f"s_{c}"] for c in columns]) / n
                spread = np.empty((len(columns), len(columns)))
                for i, a in enumerate(columns):
                    for j, b in enumerate(columns[i:], i):
                        spread[i, j] = spread[j, i] = row[f"q_{a}_{b}"] / n - mean[i] * mean[j]
                out |= _partial(columns, spread)
            yield pd.DataFrame([(f, *out[f]) for f in FACTORS], columns=["factor", "coefficient", "beta", "partial_correlation"])


def _partial(columns: Sequence[str], spread: np.ndarray) -> dict[str, tuple[float, float, float]]:
    """Coefficient, beta and partial correlation of each factor; none for those that depend on the factors before them."""
    scale = np.sqrt(np.maximum(np.diag(spread), 0))
    kept = [0] if scale[0] > 0 else []
    for i in range(1, len(columns)):
        trial = [*kept, i]
        if scale[0] > 0 and scale[i] > 0:
            own = [k for k in trial if k]
            correlation = spread[np.ix_(own, own)] / np.outer(scale[own], scale[own])
            if np.linalg.eigvalsh(correlation)[0] > 1e-9:
                kept = trial
    if len(kept) < 2:
        return {}
    correlation = spread[np.ix_(kept, kept)] / np.outer(scale[kept], scale[kept])
    beta = np.linalg.solve(correlation[1:, 1:], correlation[1:, 0])
    found = {}
    for place, i in enumerate(kept[1:], 1):
        rest = [k for k in range(len(kept)) if k not in (0, place)]
        # what is left of the score and of the factor once the rest is accounted for
        pair = [0, place]
        left = correlation[np.ix_(pair, pair)]
        if rest:
            left = left - correlation[np.ix_(pair, rest)] @ np.linalg.solve(correlation[np.ix_(rest, rest)], correlation[np.ix_(rest, pair)])
        bound = math.sqrt(max(left[0, 0], 0) * max(left[1, 1], 0))
        partial = float(np.clip(left[0, 1] / bound, -1, 1)) if bound > 0 else None
        found[columns[i]] = (float(beta[place - 1] * scale[0] / scale[i]), float(beta[place - 1]), partial)
    return found
