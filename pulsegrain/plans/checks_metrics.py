"""Checked queries: metrics, funnels, retention, rollups, users, sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsegrain.functions.props import prop
from pulsegrain.operators import funnel, metrics, retention, rollups, sessions, users
from pulsegrain.plans.catalog import check
from pulsegrain.plans.views import API_KEYS, BASE, COMMERCE, SESSIONS, USERS, with_views
from pulsegrain.sources import testbed

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
EV = with_views(BASE, SESSIONS)
NOW = '(SELECT max("timestamp") FROM base)'


def _last(days: int, project: str = "p0") -> str:
    return f"""project_id = '{project}' AND "timestamp" >= {NOW} - INTERVAL {days} DAY"""


# --- headline metrics ----------------------------------------------------------------------------

@check("overview", "A-1 X-10 X-25", EV + f"""
SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS sessions,
  count(*) FILTER (WHERE event_name = 'page_view') AS page_views,
  round(count(*) / count(DISTINCT session_id), 2) AS avg_events_per_session FROM ev WHERE {_last(30)}""")
def _(spark, sf):
    return metrics.overview(testbed.events(spark, sf), "p0", "30d", testbed.as_of(spark, sf))


@check("top_events", "A-2", with_views(BASE) + f"""
SELECT event_name, count(*) AS event_count, count(DISTINCT user_id) AS unique_users FROM base WHERE {_last(7)}
GROUP BY event_name ORDER BY event_count DESC, event_name LIMIT 10""")
def _(spark, sf):
    return metrics.top_events(testbed.base_events(spark, sf), "p0", "7d")


@check("daily_active_users", "A-3 X-1 X-8", EV + f"""
SELECT cast(cast("timestamp" AS date) AS varchar) AS date, count(DISTINCT user_id) AS active_users,
  count(DISTINCT session_id) AS sessions FROM ev WHERE {_last(30)} GROUP BY 1""")
def _(spark, sf):
    return metrics.daily_active_users(testbed.events(spark, sf), "p0", "30d", testbed.as_of(spark, sf))


def _active(unit: str) -> str:
    return EV + f"""
SELECT cast(cast(date_trunc('{unit}', "timestamp") AS date) AS varchar) AS period_start, count(*) AS events,
  count(DISTINCT user_id) AS active_users, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1"""


@check("weekly_active_users", "A-4 X-2", _active("week"))
def _(spark, sf):
    return metrics.active_users(testbed.events(spark, sf), "weekly")


@check("monthly_active_buyers", "A-4 X-3", with_views(COMMERCE) + """
SELECT cast(cast(date_trunc('month', "timestamp") AS date) AS varchar) AS period_start, count(*) AS events,
  count(DISTINCT user_id) AS active_users, count(DISTINCT session_id) AS sessions FROM commerce GROUP BY 1""")
def _(spark, sf):
    return metrics.active_users(testbed.commerce_events(spark, sf), "monthly")


STICKY = """active AS (SELECT DISTINCT project_id, user_id, cast("timestamp" AS date) AS d FROM {rows}),
days AS (SELECT project_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::date AS day FROM active GROUP BY 1)"""
STICKY_SQL = """
SELECT days.project_id, cast(day AS varchar) AS date,
  count(DISTINCT CASE WHEN d = day THEN user_id END) AS dau, count(DISTINCT user_id) AS mau,
  round(count(DISTINCT CASE WHEN d = day THEN user_id END) / greatest(count(DISTINCT user_id), 1), 4) AS stickiness
FROM days LEFT JOIN active ON active.project_id = days.project_id AND d BETWEEN day - 29 AND day GROUP BY ALL"""


@check("stickiness", "A-5", with_views(BASE, STICKY.format(rows="base")) + STICKY_SQL)
def _(spark, sf):
    return users.stickiness(testbed.base_events(spark, sf))


@check("stickiness_sparse", "A-5", with_views(COMMERCE, "shop AS (SELECT 'shop' AS project_id, * FROM commerce WHERE event_name = 'order')",
                                             STICKY.format(rows="shop")) + STICKY_SQL)
def _(spark, sf):
    return users.stickiness(testbed.commerce_events(spark, sf).filter("event_name = 'order'"))


@check("funnel", "A-6 X-21", with_views(BASE, f"""steps AS (
  SELECT step, name, count(id) AS events, count(DISTINCT user_id) AS users
  FROM (VALUES (1, 'page_view'), (2, 'click'), (3, 'purchase'), (4, 'absent')) s(step, name)
  LEFT JOIN (SELECT * FROM base WHERE {_last(7)}) b ON b.event_name = name GROUP BY ALL)""") + """
SELECT cast(step AS bigint) AS step, name AS event_name, events, users,
  CASE WHEN coalesce(lag(users) OVER w, users) = 0 THEN 0 ELSE round(users / coalesce(lag(users) OVER w, users) * 100, 2) END AS conversion_rate,
  round(users / first(users) OVER w * 100, 2) AS overall_conversion
FROM steps WINDOW w AS (ORDER BY step)""")
def _(spark, sf):
    return funnel.funnel(testbed.base_events(spark, sf), ["page_view", "click", "purchase", "absent"], "p0", "7d")


def _ordered_sql(source: str, steps: tuple[str, str, str], hours: int, order: str) -> str:
    a, b, c = steps
    near = f"<= INTERVAL {hours} HOUR"
    return f""", s1 AS (SELECT * FROM {source} WHERE event_name = '{a}'),
s2 AS (SELECT DISTINCT s1.user_id, s1."timestamp" AS t0, x."timestamp" AS t, x.id FROM s1 JOIN {source} x
  ON x.user_id = s1.user_id AND x.event_name = '{b}' AND {order.format(a='s1."timestamp", s1.id', b='x."timestamp", x.id')}
  AND x."timestamp" - s1."timestamp" {near}),
s3 AS (SELECT DISTINCT s2.user_id FROM s2 JOIN {source} x ON x.user_id = s2.user_id AND x.event_name = '{c}'
  AND {order.format(a='s2.t, s2.id', b='x."timestamp", x.id')} AND x."timestamp" - s2.t0 {near}),
steps AS (SELECT 1 AS step, '{a}' AS event_name, count(DISTINCT user_id) AS users FROM s1
  UNION ALL SELECT 2, '{b}', count(DISTINCT user_id) FROM s2 UNION ALL SELECT 3, '{c}', count(*) FROM s3)
SELECT cast(step AS bigint) AS step, event_name, users,
  round(users / coalesce(lag(users) OVER w, users) * 100, 2) AS conversion_rate,
  round(users / first(users) OVER w * 100, 2) AS overall_conversion FROM steps WINDOW w AS (ORDER BY step)"""


ORDERED = "({a}) < ({b})"


@check("ordered_funnel_4h", "A-7", with_views(BASE).rstrip() + _ordered_sql("base", ("page_view", "click", "purchase"), 4, ORDERED))
def _(spark, sf):
    return funnel.ordered_funnel(testbed.base_events(spark, sf), ["page_view", "click", "purchase"], dt.timedelta(hours=4))


@check("ordered_funnel_48h", "A-7", with_views(BASE).rstrip() + _ordered_sql("base", ("page_view", "click", "purchase"), 48, ORDERED))
def _(spark, sf):
    return funnel.ordered_funnel(testbed.base_events(spark, sf), ["page_view", "click", "purchase"], dt.timedelta(hours=48))


@check("ordered_funnel_commerce", "A-7", with_views(COMMERCE).rstrip() + _ordered_sql("commerce", ("order", "ship", "return"), 30 * 24, ORDERED))
def _(spark, sf):
    return funnel.ordered_funnel(testbed.commerce_events(spark, sf), ["order", "ship", "return"], dt.timedelta(days=30))


def _retention_sql(unit: str, days: int, view: str, where: str, back: int | None) -> str:
    span = "" if back is None else f""" AND "timestamp" >= (SELECT max("timestamp") FROM {view}) - INTERVAL {back} DAY"""
    return f""", act AS (SELECT DISTINCT user_id, cast(date_trunc('{unit}', "timestamp") AS date) AS d FROM {view}
  WHERE {where}{span}),
firsts AS (SELECT user_id, min(d) AS f FROM act GROUP BY 1)
SELECT cast(f AS varchar) AS first_seen_date, count(DISTINCT user_id) AS cohort_size,
  count(DISTINCT CASE WHEN d - f = {days} THEN user_id END) AS retained_users,
  round(count(DISTINCT CASE WHEN d - f = {days} THEN user_id END) / count(DISTINCT user_id) * 100, 2) AS retention_rate
FROM firsts LEFT JOIN act USING (user_id) GROUP BY f ORDER BY f DESC LIMIT 20"""


@check("retention_daily", "A-8 X-7", with_views(BASE).rstrip() + _retention_sql("day", 1, "base", "project_id = 'p0'", 90))
def _(spark, sf):
    return retention.retention(testbed.base_events(spark, sf), "p0", "daily", newest=20)


@check("retention_weekly", "A-8", with_views(BASE).rstrip() + _retention_sql("week", 7, "base", "project_id = 'p1'", 90))
def _(spark, sf):
    return retention.retention(testbed.base_events(spark, sf), "p1", "weekly", newest=20)


@check("retention_monthly", "A-8", with_views(COMMERCE).rstrip() + _retention_sql("month", 30, "commerce", "TRUE", None))
def _(spark, sf):
    return retention.retention(testbed.commerce_events(spark, sf), "shop", "monthly", lookback_days=None, newest=20)


@check("retention_by_join", "J-2", with_views(BASE).rstrip() + _retention_sql("day", 1, "base", "project_id = 'p0'", 90))
def _(spark, sf):
    return retention.retention_by_join(testbed.base_events(spark, sf), "p0", "daily", newest=20)


@check("cohort_matrix", "A-9", with_views(COMMERCE, """act AS (
  SELECT DISTINCT user_id, date_trunc('month', "timestamp") AS m FROM commerce),
firsts AS (SELECT user_id, min(m) AS f FROM act GROUP BY 1),
cells AS (SELECT f, (year(m) * 12 + month(m)) - (year(f) * 12 + month(f)) AS i, count(*) AS users
  FROM act JOIN firsts USING (user_id) GROUP BY 1, 2)""") + """
SELECT cast(cast(f AS date) AS varchar) AS cohort, i AS period_index, users,
  round(users / max(CASE WHEN i = 0 THEN users END) OVER (PARTITION BY f) * 100, 2) AS retention_rate FROM cells""")
def _(spark, sf):
    return retention.cohort_matrix(testbed.commerce_events(spark, sf), "shop", "monthly")


@check("top_pages", "A-10 X-11 X-13", EV + f"""
SELECT page, count(*) AS page_views, count(DISTINCT user_id) AS unique_visitors, count(DISTINCT session_id) AS sessions,
  round(avg(value), 2) AS avg_load_time, count(*) OVER () > 20 AS has_more
FROM ev WHERE event_name = 'page_view' AND page <> '' AND {_last(30)}
GROUP BY page ORDER BY page_views DESC, page LIMIT 20""")
def _(spark, sf):
    return metrics.top_pages(testbed.events(spark, sf), "p0", "30d", testbed.as_of(spark, sf))


@check("realtime_snapshot", "A-11 A-14", EV.rstrip() + f""", recent AS (
  SELECT * FROM ev WHERE project_id = 'p0' AND "timestamp" >= {NOW} - INTERVAL 300 MINUTE),
names AS (SELECT event_name, count(*) AS n FROM recent GROUP BY 1 ORDER BY n DESC, event_name LIMIT 5)
SELECT count(*) AS events_last_5min, count(DISTINCT user_id) AS active_users_last_5min,
  count(DISTINCT session_id) AS active_sessions_last_5min,
  (SELECT coalesce(string_agg(event_name, '|' ORDER BY n DESC, event_name), '') FROM names) AS top_events_last_5min
FROM recent""")
def _(spark, sf):
    return metrics.realtime_snapshot(testbed.events(spark, sf), "p0", testbed.as_of(spark, sf), dt.timedelta(minutes=300))


@check("common_events", "A-12", with_views(BASE) + f"""
SELECT event_name, count(*) AS cnt FROM base WHERE {_last(7, 'p1')} GROUP BY 1 ORDER BY cnt DESC, event_name LIMIT 10""")
def _(spark, sf):
    return metrics.common_events(testbed.base_events(spark, sf), "p1")


@check("total_events", "A-13", with_views(BASE) + f"SELECT count(*) AS total_events FROM base WHERE {_last(7)}")
def _(spark, sf):
    return metrics.total_events(testbed.base_events(spark, sf), "p0", "7d")


@check("top_pages_per_platform", "A-14", with_views(BASE, """counts AS (
  SELECT platform, page, count(*) AS n FROM base GROUP BY platform, page
  QUALIFY row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, page) <= 5)""") + """
SELECT platform, string_agg(page, '|' ORDER BY n DESC, page) AS top FROM counts GROUP BY platform""")
def _(spark, sf):
    return metrics.top_k_values(testbed.base_events(spark, sf).withColumn("page", prop("page")), "page", 5, ["platform"])


@check("top_events_approx", "A-14", with_views(BASE, "counts AS (SELECT project_id, event_name, count(*) AS n FROM base GROUP BY ALL)") + """
SELECT project_id, string_agg(event_name, '|' ORDER BY event_name) AS names FROM counts GROUP BY 1""")
def _(spark, sf):
    top = metrics.top_k_approx(testbed.base_events(spark, sf), "event_name", 10, ["project_id"])
    return top.select("project_id", F.array_sort("top").alias("names"))


@check("conditional_counts", "A-15 X-12", with_views(BASE) + """
SELECT platform, count(*) FILTER (WHERE event_name = 'click') AS clicks,
  count(DISTINCT CASE WHEN event_name = 'purchase' THEN user_id END) AS buyers FROM base GROUP BY 1""")
def _(spark, sf):
    return testbed.base_events(spark, sf).groupBy("platform").agg(
        metrics.count_where(F.col("event_name") == "click").alias("clicks"),
        metrics.distinct_where("user_id", F.col("event_name") == "purchase").alias("buyers"))


@check("approx_daily_users", "A-16")
def _(spark, sf):
    return metrics.daily_active_users(testbed.events(spark, sf), "p0", "30d", testbed.as_of(spark, sf), exact=False)


@check("approx_users_error", "A-16", with_views(BASE) + f"""
SELECT {'cast(cast("timestamp" AS date) AS varchar) AS date'}, count(DISTINCT user_id) AS users, TRUE AS within_bound
FROM base GROUP BY 1""")
def _(spark, sf):
    per_day = testbed.base_events(spark, sf).groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count_distinct("user_id").alias("users"), metrics.approx_users().alias("_approx"))
    return per_day.select("date", "users", (F.abs(F.col("_approx") - F.col("users")) <= 0.1 * F.col("users")).alias("within_bound"))


@check("sessions_with_purchase", "A-17 X-14", EV + """
SELECT session_id, bool_or(event_name = 'purchase') AS has_event FROM ev GROUP BY 1""")
def _(spark, sf):
    return metrics.session_has(testbed.events(spark, sf), "purchase")


# --- rollups ---------------------------------------------------------------------------------------

DAY = 'cast(cast("timestamp" AS date) AS varchar) AS date'


@check("rollup_page_views", "A-18", EV + f"""
SELECT project_id, {DAY}, page, count(*) AS views, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT session_id) AS unique_sessions FROM ev WHERE event_name = 'page_view' GROUP BY ALL""")
def _(spark, sf):
    return rollups.rollup_page_views(testbed.events(spark, sf))


@check("rollup_sessions", "A-19", EV + f"""
SELECT project_id, user_id, session_id, platform, country, city, {TS.format('min("timestamp")')} AS session_start,
  {TS.format('max("timestamp")')} AS session_end, count(*) AS events_count,
  count(DISTINCT CASE WHEN event_name = 'page_view' THEN page END) AS pages_visited FROM ev
GROUP BY project_id, user_id, session_id, platform, country, city""")
def _(spark, sf):
    return rollups.rollup_sessions(testbed.events(spark, sf))


@check("rollup_daily", "A-20", EV + f"""
SELECT project_id, {DAY}, count(*) AS total_events, count(DISTINCT user_id) AS active_users,
  count(DISTINCT session_id) AS sessions FROM ev GROUP BY ALL""")
def _(spark, sf):
    return rollups.rollup_daily(testbed.events(spark, sf))


@check("rollup_event_names", "A-21", with_views(BASE) + f"""
SELECT project_id, event_name, {DAY}, count(*) AS event_count, count(DISTINCT user_id) AS unique_users
FROM base GROUP BY ALL""")
def _(spark, sf):
    return rollups.rollup_event_names(testbed.base_events(spark, sf))


@check("rollup_hourly", "A-22 X-4", EV + f"""
SELECT project_id, {TS.format('date_trunc(' + "'hour'" + ', "timestamp")')} AS hour, event_name, count(*) AS event_count,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions FROM ev GROUP BY ALL""")
def _(spark, sf):
    return rollups.rollup_hourly(testbed.events(spark, sf))


@check("merged_rollup_counts", "A-23", with_views(BASE) + """
SELECT project_id, cast(cast(date_trunc('week', "timestamp") AS date) AS varchar) AS period_start,
  count(*) AS total_events FROM base GROUP BY ALL""")
def _(spark, sf):
    events = testbed.base_events(spark, sf).withColumn("session_id", F.col("user_id"))
    daily = rollups.rollup_partial(events, "daily")
    return rollups.active_users_from_rollup(daily, "weekly").select("project_id", "period_start", "total_events")


@check("merged_rollup_estimates", "A-23")
def _(spark, sf):
    events = testbed.base_events(spark, sf).withColumn("session_id", F.col("user_id"))
    return rollups.active_users_from_rollup(rollups.rollup_partial(events, "daily"), "monthly")


@check("merged_rollup_error", "A-23", with_views(BASE) + """
SELECT project_id, cast(cast(date_trunc('month', "timestamp") AS date) AS varchar) AS period_start,
  count(DISTINCT user_id) AS users, TRUE AS within_bound FROM base GROUP BY ALL""")
def _(spark, sf):
    events = testbed.base_events(spark, sf).withColumn("session_id", F.col("user_id"))
    estimate = rollups.active_users_from_rollup(rollups.rollup_partial(events, "daily"), "monthly")
    exact = metrics.counts_users_sessions(
        events.select("project_id", F.trunc(F.to_date("timestamp"), "month").alias("period_start"), "user_id", "session_id"),
        ["project_id", "period_start"])
    return exact.join(estimate, ["project_id", "period_start"]).select(
        "project_id", "period_start", "users",
        (F.abs(F.col("approx_users") - F.col("users")) <= 0.05 * F.col("users")).alias("within_bound"))


# --- users and sessions ------------------------------------------------------------------------------

@check("user_profile", "A-24", with_views(BASE) + f"""
SELECT user_id, {TS.format('min("timestamp")')} AS first_seen, {TS.format('max("timestamp")')} AS last_seen,
  count(*) AS events_count, max("timestamp") >= {NOW} - INTERVAL 2 DAY AS is_active FROM base GROUP BY 1""")
def _(spark, sf):
    return users.user_profile(testbed.base_events(spark, sf), active_days=2)


@check("key_last_used", "A-25", with_views(BASE) + f"""
SELECT sha256(api_key) AS key_hash, {TS.format('max("timestamp")')} AS last_used_at, count(*) AS uses FROM base GROUP BY 1""")
def _(spark, sf):
    return users.key_last_used(testbed.base_events(spark, sf))


@check("touched_users", "A-24", with_views(BASE, USERS, """seen AS (
  SELECT user_id, min("timestamp") AS a, max("timestamp") AS b FROM base GROUP BY 1)""") + f"""
SELECT id, {TS.format("CASE WHEN a < TIMESTAMP '2024-01-10' THEN a ELSE TIMESTAMP '2024-01-10' END")} AS first_seen,
  {TS.format('b')} AS last_seen FROM users LEFT JOIN seen ON user_id = id""")
def _(spark, sf):
    # All users were first seen on one day, and not again.
    known = testbed.users(spark, sf).select("id", F.lit(dt.datetime(2024, 1, 10)).alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"))
    return users.touch_users(known, users.user_profile(testbed.base_events(spark, sf)))


@check("touched_keys", "A-25", with_views(BASE, API_KEYS, """used AS (SELECT sha256(api_key) AS h, max("timestamp") AS t FROM base GROUP BY 1)""") + f"""
SELECT id, {TS.format("greatest(t, TIMESTAMP '2024-01-15')")} AS last_used_at, may_write FROM keys LEFT JOIN used ON h = key_hash""")
def _(spark, sf):
    known = testbed.api_keys(spark, sf).withColumn("last_used_at", F.lit(dt.datetime(2024, 1, 15)))
    return users.touch_keys(known, users.key_last_used(testbed.base_events(spark, sf))).select(
        "id", "last_used_at", F.col("permissions")["write"].alias("may_write"))


@check("events_tracked", "A-26", with_views(BASE) + """
SELECT project_id, event_name, count(*) AS events_tracked_total FROM base GROUP BY ALL""")
def _(spark, sf):
    return users.events_tracked(testbed.base_events(spark, sf))


@check("session_stats", "A-29 X-27", EV.rstrip() + """, s AS (
  SELECT session_id, count(*) AS n, count(*) FILTER (WHERE event_name = 'page_view') AS v, any_value(project_id) AS p,
    cast(round((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6) AS bigint) AS d FROM ev GROUP BY 1)
SELECT count(*) AS sessions, round(avg(d), 2) AS avg_duration_seconds, max(d) AS max_duration_seconds,
  round(avg(n), 2) AS avg_events, round(avg(v), 2) AS avg_page_views,
  round(count(*) FILTER (WHERE n = 1) / count(*) * 100, 2) AS bounce_rate FROM s""")
def _(spark, sf):
    return sessions.session_stats(sessions.session_table(testbed.events(spark, sf)))


@check("bounce_rate", "A-30", EV.rstrip() + """, entry AS (
  SELECT session_id, arg_min(page, ("timestamp", id)) AS page, count(*) AS n FROM ev WHERE event_name = 'page_view' GROUP BY 1)
SELECT page, count(*) AS entries, count(*) FILTER (WHERE n = 1) AS bounces,
  round(count(*) FILTER (WHERE n = 1) / count(*) * 100, 2) AS bounce_rate FROM entry GROUP BY page""")
def _(spark, sf):
    return sessions.bounce_rate(testbed.events(spark, sf))


@check("conversion_by_platform", "A-31", with_views(BASE) + f"""
SELECT platform, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_name = 'purchase' THEN user_id END) AS converted,
  round(count(DISTINCT CASE WHEN event_name = 'purchase' THEN user_id END) / count(DISTINCT user_id) * 100, 2) AS conversion_rate
FROM base WHERE "timestamp" >= {NOW} - INTERVAL 1 DAY GROUP BY 1""")
def _(spark, sf):
    from pulsegrain.operators.filters import in_range
    return metrics.conversion_by(in_range(testbed.base_events(spark, sf), "1d"), "purchase", "platform")


@check("inactive_users", "A-32", with_views(BASE) + f"""
SELECT user_id, {TS.format('max("timestamp")')} AS last_seen,
  cast({NOW} AS date) - cast(max("timestamp") AS date) AS days_inactive
FROM base GROUP BY 1 HAVING max("timestamp") < {NOW} - INTERVAL 1 DAY""")
def _(spark, sf):
    return users.inactive_users(testbed.base_events(spark, sf), 1)


@check("inactive_buyers", "A-32", with_views(COMMERCE) + f"""
SELECT user_id, {TS.format('max("timestamp")')} AS last_seen,
  cast((SELECT max("timestamp") FROM commerce) AS date) - cast(max("timestamp") AS date) AS days_inactive
FROM commerce GROUP BY 1 HAVING max("timestamp") < (SELECT max("timestamp") FROM commerce) - INTERVAL 7 DAY""")
def _(spark, sf):
    return users.inactive_users(testbed.commerce_events(spark, sf), 7)


@check("event_engagement", "A-33", with_views(BASE) + """
SELECT event_name, count(*) AS event_count, count(DISTINCT user_id) AS unique_users,
  round(count(*) / count(DISTINCT user_id), 2) AS events_per_user FROM base GROUP BY 1""")
def _(spark, sf):
    return metrics.event_engagement(testbed.base_events(spark, sf))


@check("breakdown_totals", "A-34", EV + """
SELECT platform, event_name, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions
FROM ev GROUP BY ROLLUP (platform, event_name)""")
def _(spark, sf):
    return metrics.breakdown(testbed.events(spark, sf), ["platform", "event_name"], totals=True)


@check("breakdown_of_series", "A-34", EV + """
SELECT project_id, platform, cast(cast("timestamp" AS date) AS varchar) AS date, count(*) AS events, count(DISTINCT user_id) AS users,
  count(DISTINCT session_id) AS sessions FROM ev GROUP BY ALL""")
def _(spark, sf):
    from pulsegrain.operators.insights import daily_series
    return metrics.breakdown_by(daily_series, testbed.events(spark, sf), "platform")


@check("breakdown_by_segment", "A-34 J-3", with_views(BASE, SESSIONS, USERS) + """
SELECT segment AS user_segment, region AS user_region, count(*) AS events, count(DISTINCT user_id) AS users,
  count(DISTINCT session_id) AS sessions FROM ev LEFT JOIN users ON users.id = user_id GROUP BY ALL""")
def _(spark, sf):
    from pulsegrain.operators.joins import with_user
    rows = with_user(testbed.events(spark, sf), testbed.users(spark, sf))
    return metrics.breakdown(rows, ["user_segment", "user_region"])


@check("experiment_readout", "A-35", with_views(BASE, f"""t AS (
  SELECT experiment AS variant, count(DISTINCT user_id) AS n,
    count(DISTINCT CASE WHEN event_name = 'purchase' THEN user_id END) AS x FROM base
  WHERE "timestamp" >= {NOW} - INTERVAL 1 DAY GROUP BY 1)""", """c AS (SELECT n AS n0, x AS x0 FROM t WHERE variant = 'control')""") + """
SELECT variant, n AS users, x AS converted, round(x / n * 100, 2) AS conversion_rate,
  round((x / n - x0 / n0) * 100, 2) AS difference,
  CASE WHEN variant = 'control' THEN 0 ELSE round((x / n - x0 / n0) /
    sqrt((x + x0) / (n + n0) * (1 - (x + x0) / (n + n0)) * (1 / n + 1 / n0)), 4) END AS z_score FROM t, c""")
def _(spark, sf):
    from pulsegrain.operators.filters import in_range
    return metrics.experiment_readout(in_range(testbed.base_events(spark, sf), "1d"), "purchase", "control")
