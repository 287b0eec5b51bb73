"""Checked queries: sessions by gap, change, trend, anomaly, forecast, churn, reports."""

from __future__ import annotations

import uuid

from pulsegrain.operators import insights, sessions, users
from pulsegrain.plans.catalog import check
from pulsegrain.plans.views import BASE, COMMERCE, SESSIONS, with_views
from pulsegrain.session import work_dir
from pulsegrain.sources import testbed
from pulsegrain.sources.events import write_by_user

EV = with_views(BASE, SESSIONS)
DAILY = """daily AS (SELECT project_id, cast("timestamp" AS date) AS d, count(*) AS events,
  count(DISTINCT user_id) AS users FROM base GROUP BY 1, 2)"""
BYDAY = with_views(BASE, DAILY)


def _daily(spark, sf):
    rows = testbed.base_events(spark, sf)
    return insights.daily_series(rows.withColumn("session_id", rows["user_id"]))


@check("change_vs_previous", "W-2", BYDAY + """
SELECT daily.project_id, cast(daily.d AS varchar) AS date, daily.events, daily.users,
  p.events AS previous_events, p.users AS previous_users,
  round((daily.events - p.events) / p.events * 100, 2) AS events_change,
  round((daily.users - p.users) / p.users * 100, 2) AS users_change
FROM daily LEFT JOIN daily p ON p.project_id = daily.project_id AND p.d = daily.d - 1""")
def _(spark, sf):
    return insights.vs_previous(_daily(spark, sf).drop("sessions"), ["events", "users"], "date")


@check("sessionized_events", "W-3", EV + "SELECT id, user_id, session_id FROM ev")
def _(spark, sf):
    return testbed.events(spark, sf).select("id", "user_id", "session_id")


@check("sessions_on_user_copy", "W-3 S-4", EV + "SELECT id, user_id, session_id FROM ev")
def _(spark, sf):
    """On the copy by user, where sessions need no shuffle of events."""
    copy = write_by_user(testbed.base_events(spark, sf), f"by_user_{uuid.uuid4().hex}", work_dir(spark, "by-user"), 8)
    return sessions.sessionize(copy, testbed.SESSION_GAP).select("id", "user_id", "session_id")


@check("trend", "W-4", BYDAY.rstrip() + """, m AS (
  SELECT x.project_id, x.d, avg(y.events) FILTER (y.d > x.d - 7) AS a, avg(y.events) FILTER (y.d <= x.d - 7) AS b, count(*) AS n
  FROM daily x JOIN daily y ON x.project_id = y.project_id AND y.d BETWEEN x.d - 13 AND x.d GROUP BY ALL)
SELECT project_id, cast(d AS varchar) AS date, round(a, 4) AS trailing_avg, round(b, 4) AS prior_avg,
  round((a - b) / b * 100, 2) AS change,
  CASE WHEN round((a - b) / b * 100, 2) >= 5 THEN 'up' WHEN round((a - b) / b * 100, 2) <= -5 THEN 'down' ELSE 'flat' END AS trend
FROM m WHERE n = 14""")
def _(spark, sf):
    return insights.trend(_daily(spark, sf), "events", threshold=5.0)


@check("anomalies", "W-5", BYDAY.rstrip() + """, m AS (
  SELECT x.project_id, x.d, x.events, CASE WHEN count(y.d) = 7 THEN avg(y.events) END AS a,
    CASE WHEN count(y.d) = 7 THEN stddev_samp(y.events) END AS s
  FROM daily x LEFT JOIN daily y ON x.project_id = y.project_id AND y.d BETWEEN x.d - 7 AND x.d - 1 GROUP BY ALL)
SELECT project_id, cast(d AS varchar) AS date, events AS value, round(a, 4) AS expected,
  round((events - a) / nullif(s, 0), 4) AS z_score, coalesce(abs(round((events - a) / nullif(s, 0), 4)) >= 2, FALSE) AS is_anomaly
FROM m""")
def _(spark, sf):
    return insights.anomalies(_daily(spark, sf), "events", z=2.0)


@check("forecast", "W-6", BYDAY.rstrip() + """, p AS (
  SELECT *, d - min(d) OVER (PARTITION BY project_id) AS x FROM daily),
fit AS (SELECT project_id, regr_slope(events, x) AS b, regr_intercept(events, x) AS a, max(x) AS lx, max(d) AS ld FROM p GROUP BY 1)
SELECT project_id, cast(ld + cast(h AS int) AS varchar) AS date, round(a + b * (lx + h), 4) AS forecast
FROM fit, (SELECT unnest(generate_series(1, 7)) AS h)""")
def _(spark, sf):
    return insights.forecast(_daily(spark, sf), "events")


@check("churn_risk", "W-7", with_views(COMMERCE, """gaps AS (
  SELECT user_id, "timestamp" AS t, epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", id)) AS g
  FROM commerce)""") + """
SELECT user_id, count(*) AS events, strftime(max(t), '%Y-%m-%d %H:%M:%S.%f') AS last_seen,
  round(avg(g) / 3.6e9, 2) AS mean_gap_hours,
  round((epoch_us((SELECT max("timestamp") FROM commerce)) - epoch_us(max(t))) / 3.6e9, 2) AS idle_hours,
  coalesce(epoch_us((SELECT max("timestamp") FROM commerce)) - epoch_us(max(t)) > avg(g) * 2, FALSE) AS at_risk
FROM gaps GROUP BY user_id""")
def _(spark, sf):
    return users.churn_risk(testbed.commerce_events(spark, sf), factor=2.0)


def _report(period: str) -> str:
    """Every period has the one before it in the given tables."""
    return EV.rstrip() + f""", m AS (
  SELECT project_id, cast(date_trunc('{period}', "timestamp") AS date) AS p, count(*) AS events,
    count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1, 2),
names AS (SELECT project_id, cast(date_trunc('{period}', "timestamp") AS date) AS p, event_name FROM ev GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY 1, project_id, p ORDER BY count(*) DESC, event_name) = 1)
SELECT project_id, cast(p AS varchar) AS period_start, events, users, sessions, event_name AS top_event,
  lag(events) OVER w AS previous_events, lag(users) OVER w AS previous_users, lag(sessions) OVER w AS previous_sessions,
  round((events - lag(events) OVER w) / lag(events) OVER w * 100, 2) AS events_change,
  round((users - lag(users) OVER w) / lag(users) OVER w * 100, 2) AS users_change,
  round((sessions - lag(sessions) OVER w) / lag(sessions) OVER w * 100, 2) AS sessions_change
FROM m JOIN names USING (project_id, p) WINDOW w AS (PARTITION BY project_id ORDER BY p)"""


@check("period_report", "W-8", _report("week"))
def _(spark, sf):
    return insights.period_report(testbed.events(spark, sf), "weekly")


@check("period_report_monthly", "W-8", _report("month"))
def _(spark, sf):
    return insights.period_report(testbed.events(spark, sf), "monthly")
