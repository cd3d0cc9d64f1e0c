"""KPIs, distributions, trends, satisfaction, insights and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.lexicons import PROBE_TOPICS
from parley.operators import insights, metrics
from parley.plans.oracle import topics_of_messages, with_messages
from parley.plans.registry import query
from parley.plans.rows import AS_OF, CAP, END, RANGE, START
from parley.sources.fixtures import messages, table

SCORE = (
    "CASE sentiment WHEN 'positive' THEN 4.5::DOUBLE WHEN 'neutral' THEN 3.0::DOUBLE"
    " WHEN 'negative' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END"
)
DAY = 'CAST("timestamp" AS DATE)'


@query("total_conversations", with_messages("SELECT count(DISTINCT conversation_id) AS total FROM v"))
def _(spark, sf):
    return metrics.total_conversations(messages(spark, sf))


@query(
    "today_conversations",
    with_messages(f"SELECT count(DISTINCT conversation_id) AS total FROM v WHERE {DAY} = DATE '2024-01-05'"),
)
def _(spark, sf):
    return metrics.day_conversations(messages(spark, sf), START)


@query(
    "range_kpis",
    with_messages(
        "SELECT count(DISTINCT conversation_id) AS total_conversations, count(*) AS total_messages,"
        " count(DISTINCT user_id) AS unique_users,"
        f" coalesce(round(avg(response_time) / 60, 6), 0) AS avg_response_minutes FROM v WHERE {RANGE}"
    ),
)
def _(spark, sf):
    return metrics.range_kpis(messages(spark, sf, response_time=True), START, END)


@query(
    "range_kpis_customers",
    with_messages(
        "SELECT count(DISTINCT conversation_id) AS total_conversations, count(*) AS total_messages,"
        " count(DISTINCT CASE WHEN sender_type = 'customer' THEN user_id END) AS unique_users,"
        f" coalesce(round(avg(response_time) / 60, 6), 0) AS avg_response_minutes FROM v WHERE {RANGE}"
    ),
)
def _(spark, sf):
    return metrics.range_kpis(messages(spark, sf, response_time=True), START, END, customers_only=True)


DAILY = (
    f"SELECT {DAY} AS date, count(DISTINCT conversation_id) AS conversations, count(*) AS messages"
    f" FROM v WHERE {RANGE} GROUP BY 1"
)


@query("daily_conversations", with_messages(DAILY))
def _(spark, sf):
    return metrics.daily_conversations(messages(spark, sf), START, END)


@query(
    "daily_events",
    "SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS conversations, count(*) AS messages"
    " FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1",
)
def _(spark, sf):
    rows = table(spark, sf, "events").withColumnsRenamed({"ts": "timestamp", "user_id": "conversation_id"})
    return metrics.daily_conversations(rows, START, "2024-01-25")


@query(
    "message_type_distribution",
    with_messages(
        'SELECT message_type, "count", round(100.0 * "count" / sum("count") OVER (), 6) AS share FROM ('
        f'SELECT message_type, count(*) AS "count" FROM v WHERE {RANGE} GROUP BY 1)'
    ),
)
def _(spark, sf):
    return metrics.message_type_distribution(messages(spark, sf), START, END)


@query(
    "share_of_total",
    'SELECT event_type, "count", round(100.0 * "count" / sum("count") OVER (), 6) AS share FROM ('
    'SELECT event_type, count(*) AS "count" FROM events GROUP BY 1)',
)
def _(spark, sf):
    counted = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("count"))
    return metrics.share_of_total(counted)


@query(
    "sentiment_distribution",
    with_messages('SELECT sentiment, count(*) AS "count" FROM m WHERE sentiment IS NOT NULL GROUP BY 1'),
)
def _(spark, sf):
    return metrics.sentiment_distribution(messages(spark, sf, sentiment=True))


@query(
    "sentiment_distribution_range",
    with_messages(f'SELECT sentiment, count(*) AS "count" FROM m WHERE sentiment IS NOT NULL AND {RANGE} GROUP BY 1'),
)
def _(spark, sf):
    return metrics.sentiment_distribution(messages(spark, sf, sentiment=True), START, END)


@query(
    "sentiment_trend",
    with_messages(
        f"SELECT {DAY} AS date, round(avg(sentiment_score), 6) AS sentiment_score, count(*) AS message_count FROM m"
        f" WHERE sentiment_score IS NOT NULL AND {DAY} BETWEEN DATE '2024-01-15' - 30 AND DATE '2024-01-15' GROUP BY 1"
    ),
)
def _(spark, sf):
    return metrics.sentiment_trend(messages(spark, sf, sentiment=True), AS_OF)


@query(
    "negative_share",
    with_messages(
        "SELECT negative, labelled, coalesce(round(100.0 * negative / nullif(labelled, 0), 6), 0) AS negative_pct FROM ("
        "SELECT count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(sentiment) AS labelled FROM m)"
    ),
)
def _(spark, sf):
    return metrics.negative_share(messages(spark, sf, sentiment=True))


@query(
    "hourly_response",
    with_messages(
        'SELECT CAST(hour("timestamp") AS INT) AS hour, round(avg(response_time) / 60, 6) AS avg_response_minutes,'
        " count(*) AS message_count FROM v WHERE response_time IS NOT NULL GROUP BY 1"
    ),
)
def _(spark, sf):
    return metrics.hourly_response(messages(spark, sf, response_time=True))


@query(
    "response_distribution",
    with_messages("SELECT id, round(response_time / 60, 6) AS response_minutes FROM v WHERE response_time <= 3600"),
)
def _(spark, sf):
    return metrics.response_distribution(messages(spark, sf, response_time=True))


@query(
    "response_histogram",
    with_messages(
        "SELECT CAST(floor(response_time / 60) AS BIGINT) AS bin, count(*) AS \"count\","
        f" floor(response_time / 60)::DOUBLE AS from_minutes FROM v WHERE response_time <= {CAP} GROUP BY 1, 3"
    ),
)
def _(spark, sf):
    return metrics.response_histogram(messages(spark, sf, response_time=True), 1.0, CAP)


@query(
    "response_percentiles",
    with_messages(
        "SELECT round(quantile_cont(response_time, 0.5) / 60, 6) AS p50_minutes,"
        " round(quantile_cont(response_time, 0.9) / 60, 6) AS p90_minutes,"
        " round(quantile_cont(response_time, 0.99) / 60, 6) AS p99_minutes FROM v"
    ),
)
def _(spark, sf):
    return metrics.response_percentiles(messages(spark, sf, response_time=True))


@query(
    "response_band",
    with_messages(
        'SELECT band, "count", round(100.0 * "count" / sum("count") OVER (), 6) AS share FROM ('
        "SELECT CASE WHEN response_time <= 300 THEN 'good' WHEN response_time <= 900 THEN 'acceptable'"
        " WHEN response_time <= 1800 THEN 'poor' ELSE 'beyond' END AS band, count(*) AS \"count\""
        " FROM v WHERE response_time IS NOT NULL GROUP BY 1)"
    ),
)
def _(spark, sf):
    return metrics.response_bands(messages(spark, sf, response_time=True))


@query(
    "business_hours",
    with_messages(
        'SELECT hour("timestamp" + INTERVAL 7 HOURS) BETWEEN 9 AND 17 AS business_hours, count(*) AS messages,'
        " round(avg(response_time) / 60, 6) AS avg_response_minutes FROM v GROUP BY 1"
    ),
)
def _(spark, sf):
    return metrics.business_hours_kpis(messages(spark, sf, response_time=True))


@query(
    "satisfaction_score",
    with_messages(f"SELECT id, {SCORE} AS satisfaction FROM m"),
)
def _(spark, sf):
    from parley.functions.lexical import satisfaction_score

    rows = messages(spark, sf, sentiment=True)
    return rows.select("id", satisfaction_score(F.col("sentiment")).alias("satisfaction"))


@query(
    "satisfaction_overall",
    with_messages(f"SELECT coalesce(round(avg({SCORE}), 6), 3.0) AS overall_score FROM m WHERE sentiment IS NOT NULL"),
)
def _(spark, sf):
    return metrics.satisfaction_overall(messages(spark, sf, sentiment=True))


SATISFACTION_TREND = with_messages(
    f"SELECT {DAY} AS date, round(avg({SCORE}), 6) AS satisfaction_score FROM m"
    " WHERE sentiment IS NOT NULL AND \"timestamp\" >= DATE '2024-01-15' - 30 GROUP BY 1"
)


@query("satisfaction_trend", SATISFACTION_TREND)
def _(spark, sf):
    return metrics.satisfaction_trend(messages(spark, sf, sentiment=True), AS_OF)


@query(
    "satisfaction_drivers",
    with_messages(
        f"""SELECT factor, correlation, CASE WHEN abs(correlation) >= 0.85 THEN 'สูงมาก' WHEN abs(correlation) >= 0.7 THEN 'สูง'
              WHEN abs(correlation) >= 0.5 THEN 'ปานกลาง' WHEN abs(correlation) >= 0 THEN 'ต่ำ' END AS impact FROM (
          SELECT unnest(['response_time', 'message_length', 'hour', 'message_count']) AS factor,
                 unnest([round(corr(score, response_time), 6), round(corr(score, message_length), 6),
                         round(corr(score, hour), 6), round(corr(score, message_count), 6)]) AS correlation
          FROM (SELECT conversation_id, avg(CASE WHEN sentiment IS NOT NULL THEN {SCORE} END) AS score,
                       avg(response_time) AS response_time, avg(length(message)) AS message_length,
                       hour(min("timestamp"))::DOUBLE AS hour, count(*)::DOUBLE AS message_count
                FROM m GROUP BY conversation_id))"""
    ),
)
def _(spark, sf):
    return metrics.satisfaction_drivers(messages(spark, sf, response_time=True, sentiment=True))


_FACTORS = metrics.FACTORS


def _joint_sql() -> str:
    """The model by orthogonal residuals: of the score and each factor, once the other factors are taken out in turn."""
    parts, models = [], []
    for f in _FACTORS:
        others = [o for o in _FACTORS if o != f]
        parts.append(f"""{f}_1 AS (SELECT score, {f} AS x, {others[0]} - avg({others[0]}) OVER () AS r1, {others[1]} AS b, {others[2]} AS c FROM w),
        {f}_2 AS (SELECT *, b - avg(b) OVER () - regr_slope(b, r1) OVER () * r1 AS r2 FROM {f}_1),
        {f}_3 AS (SELECT *, c - avg(c) OVER () - regr_slope(c, r1) OVER () * r1 - regr_slope(c, r2) OVER () * r2 AS r3 FROM {f}_2),
        {f}_4 AS (SELECT score, x, score - avg(score) OVER () - regr_slope(score, r1) OVER () * r1 - regr_slope(score, r2) OVER () * r2
                         - regr_slope(score, r3) OVER () * r3 AS y_left,
                  x - avg(x) OVER () - regr_slope(x, r1) OVER () * r1 - regr_slope(x, r2) OVER () * r2 - regr_slope(x, r3) OVER () * r3 AS x_left FROM {f}_3)""")
        models.append(f"""SELECT '{f}' AS factor, round(regr_slope(y_left, x_left), 6) AS coefficient,
               round(regr_slope(y_left, x_left) * stddev_pop(x) / stddev_pop(score), 6) AS beta,
               round(corr(y_left, x_left), 6) AS partial_correlation FROM {f}_4""")
    return with_messages(
        f""", w AS (SELECT * FROM (
              SELECT conversation_id, avg(CASE WHEN sentiment IS NOT NULL THEN {SCORE} END) AS score, avg(response_time) AS response_time,
                     avg(length(message)) AS message_length, hour(min("timestamp"))::DOUBLE AS hour, count(*)::DOUBLE AS message_count
              FROM m GROUP BY conversation_id) WHERE score IS NOT NULL AND response_time IS NOT NULL AND hour IS NOT NULL),
        {", ".join(parts)}
        SELECT *, CASE WHEN abs(partial_correlation) >= 0.85 THEN 'สูงมาก' WHEN abs(partial_correlation) >= 0.7 THEN 'สูง'
              WHEN abs(partial_correlation) >= 0.5 THEN 'ปานกลาง' WHEN abs(partial_correlation) >= 0 THEN 'ต่ำ' END AS impact
        FROM ({" UNION ALL ".join(models)})"""
    )


@query("satisfaction_drivers_joint", _joint_sql())
def _(spark, sf):
    return metrics.satisfaction_drivers_joint(messages(spark, sf, response_time=True, sentiment=True))


def _kpi_pair(first: str, last: str) -> str:
    return (
        "SELECT count(DISTINCT conversation_id)::DOUBLE AS c, count(*)::DOUBLE AS n, count(DISTINCT user_id)::DOUBLE AS u,"
        f" coalesce(round(avg(response_time) / 60, 6), 0) AS r FROM v WHERE {DAY} BETWEEN DATE '{first}' AND DATE '{last}'"
    )


@query(
    "kpi_change",
    with_messages(
        f""", a AS ({_kpi_pair('2024-01-05', '2024-01-11')}), b AS ({_kpi_pair('2023-12-29', '2024-01-04')})
        SELECT measure, "current", previous, round("current" - previous, 6) AS change,
               round(100.0 * ("current" - previous) / nullif(previous, 0), 6) AS change_pct FROM (
          SELECT unnest(['total_conversations', 'total_messages', 'unique_users', 'avg_response_minutes']) AS measure,
                 unnest([a.c, a.n, a.u, a.r]) AS "current", unnest([b.c, b.n, b.u, b.r]) AS previous FROM a, b)"""
    ),
)
def _(spark, sf):
    return metrics.kpi_change(messages(spark, sf, response_time=True), START, END)


def _insights_sql(negative_percent: int) -> str:
    return with_messages(
        topics_of_messages(50)
        + f""", x AS (SELECT coalesce(avg(response_time) FILTER (WHERE {DAY} BETWEEN DATE '2024-01-08' AND DATE '2024-01-15') / 60, 0) AS minutes,
                     100.0 * count(*) FILTER (WHERE sentiment = 'negative') / nullif(count(sentiment), 0) AS negative FROM m),
        top AS (SELECT label FROM t GROUP BY label ORDER BY round(sum(confidence), 6) DESC, max({{'ts': "timestamp", 'id': id, 'r': -rank}}) DESC LIMIT 1)
        SELECT 'warning' AS type, 'เวลาตอบกลับช้า' AS title,
               'เวลาตอบกลับเฉลี่ย ' || format('{{:.1f}}', minutes) || ' นาที ควรปรับปรุง' AS description, 'high' AS priority
        FROM x WHERE minutes > 2
        UNION ALL SELECT 'alert', 'ความรู้สึกลูกค้าไม่ดี',
               'พบความรู้สึกเชิงลบ ' || format('{{:.1f}}', negative) || '% ควรตรวจสอบ', 'high' FROM x WHERE negative > {negative_percent}
        UNION ALL SELECT 'info', 'หัวข้อยอดฮิต: ' || label, 'พบการสนทนาเรื่อง' || label || 'บ่อยที่สุด', 'medium' FROM top"""
    )


@query("insights", _insights_sql(30))
def _(spark, sf):
    rows = messages(spark, sf, response_time=True, sentiment=True)
    return insights.insights(rows, AS_OF, PROBE_TOPICS, slow_minutes=2)


@query("insights_all", _insights_sql(5))
def _(spark, sf):
    """With limits at which all three rules fire."""
    rows = messages(spark, sf, response_time=True, sentiment=True)
    return insights.insights(rows, AS_OF, PROBE_TOPICS, slow_minutes=2, negative_percent=5)


@query(
    "alert_flags",
    with_messages(
        f""", d AS (SELECT {DAY} AS date, count(*) FILTER (WHERE sentiment = 'negative')::DOUBLE / nullif(count(sentiment), 0) AS share,
                   avg(response_time) AS seconds, count(*)::DOUBLE AS volume FROM m GROUP BY 1)
        SELECT date, 'high_negative_sentiment' AS alert, round(share, 6) AS value, 0.3::DOUBLE AS threshold FROM d WHERE share > 0.3::DOUBLE
        UNION ALL SELECT date, 'slow_response_time', round(seconds, 6), 120.0::DOUBLE FROM d WHERE seconds > 120
        UNION ALL SELECT date, 'high_message_volume', volume, 30.0::DOUBLE FROM d WHERE volume > 30"""
    ),
)
def _(spark, sf):
    rows = messages(spark, sf, response_time=True, sentiment=True)
    return insights.alert_flags(rows, response_seconds=120, volume=30)
