"""Checked queries: metrics answered by stored partials and their sketches, against the events themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrain.operators import querylog, retention, rollups
from pulsegrain.plans.catalog import check
from pulsegrain.plans.checks_metrics import _retention_sql
from pulsegrain.plans.views import BASE, COMMERCE, QUERY_LOG, with_views
from pulsegrain.session import work_dir
from pulsegrain.sources import testbed

SMALL_TOP = 64  # fewer entries than there are pages, so that counts are estimates
LAST_DAY = """(SELECT max(cast("timestamp" AS date)) FROM base)"""
HALVES = 2


def _partials(spark: SparkSession, events: DataFrame, name: str, **size: int) -> DataFrame:
    """The rollup's partials of several batches, stored and read again: a key has a row in each."""
    path = work_dir(spark, "partials")
    for i in range(HALVES):
        rollups.rollup_partial(events.filter(F.crc32("id") % HALVES == i), name, **size).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _own_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.base_events(spark, sf).withColumn("session_id", F.col("user_id"))


@check("top_events_from_rollup", "A-2 A-23", with_views(BASE) + f"""
SELECT event_name, count(*) AS event_count FROM base
WHERE project_id = 'p0' AND cast("timestamp" AS date) > {LAST_DAY} - 7 GROUP BY 1 ORDER BY event_count DESC, event_name LIMIT 3""")
def _(spark, sf):
    return rollups.top_events_from_rollup(_partials(spark, _own_sessions(spark, sf), "top_lists"), "p0", "7d", n=3)


PAGES = f"""SELECT page, count(*) AS page_views FROM base
WHERE project_id = 'p0' AND event_name = 'page_view' AND page <> '' AND cast("timestamp" AS date) > {LAST_DAY} - 30 GROUP BY 1"""


@check("top_pages_from_rollup", "A-10 A-23", with_views(BASE) + PAGES + " ORDER BY page_views DESC, page LIMIT 20")
def _(spark, sf):
    return rollups.top_pages_from_rollup(_partials(spark, _own_sessions(spark, sf), "top_lists"), "p0", "30d", n=20)


@check("top_pages_rollup_error", "A-10 A-14 A-23", with_views(BASE) + f"SELECT *, TRUE AS within_bound FROM ({PAGES})")
def _(spark, sf):
    """Every page with its true count, and whether a list with too few entries is within its bound."""
    events = _own_sessions(spark, sf)
    few = rollups.top_pages_from_rollup(_partials(spark, events, "top_lists", top_items=SMALL_TOP), "p0", "30d", n=SMALL_TOP, top_items=SMALL_TOP)
    days = F.col("date").between(*rollups.day_range(events.withColumn("date", F.to_date("timestamp")), "30d", None))
    views = rollups.rollup_page_views(events).filter(days & (F.col("project_id") == "p0") & (F.col("page") != ""))
    exact = views.groupBy("page").agg(F.sum("views").alias("page_views"))
    total = exact.agg(F.sum("page_views")).scalar()
    missing = F.coalesce("estimate", F.lit(0))
    # A value that the list dropped had no more than the bound; one it keeps is off by no more.
    return exact.join(few.withColumnRenamed("page_views", "estimate"), "page", "left").select(
        "page", "page_views", (F.abs(missing - F.col("page_views")) <= F.ceil(total * 3.5 / SMALL_TOP)).alias("within_bound"))


@check("realtime_from_rollup", "A-11 A-14 A-23", with_views(BASE, f"""recent AS (SELECT * FROM base WHERE project_id = 'p0'
  AND date_trunc('minute', "timestamp") > (SELECT max(date_trunc('minute', "timestamp")) FROM base) - INTERVAL 600 MINUTE),
names AS (SELECT event_name, count(*) AS n FROM recent GROUP BY 1 ORDER BY n DESC, event_name LIMIT 3)""") + """
SELECT count(*) AS events, TRUE AS users_near, TRUE AS sessions_near,
  (SELECT coalesce(string_agg(event_name, '|' ORDER BY n DESC, event_name), '') FROM names) AS top_events FROM recent""")
def _(spark, sf):
    # Ten hours: the given events are too sparse for five minutes.
    events = _own_sessions(spark, sf)
    end = F.date_trunc("minute", testbed.as_of(spark, sf))
    exact = events.filter((F.col("project_id") == "p0") & (F.date_trunc("minute", F.col("timestamp")) > end - F.make_interval(mins=F.lit(600)))).agg(
        F.count_distinct("user_id")).scalar()
    near = lambda c: F.abs(F.col(c) - exact) <= F.ceil(0.05 * exact)
    answer = rollups.realtime_from_rollup(_partials(spark, events, "minutes"), "p0", last=600, k=3)
    return answer.select(
        "events", near("approx_users").alias("users_near"), near("approx_sessions").alias("sessions_near"), "top_events")


def _all(unit: str, days: int, view: str, where: str) -> str:
    return _retention_sql(unit, days, view, where, None).removesuffix(" ORDER BY f DESC LIMIT 20")


@check("retention_from_sketches", "A-8 A-23", with_views(COMMERCE).rstrip() + _all("month", 30, "commerce", "TRUE"))
def _(spark, sf):
    return retention.retention_from_sketches(_partials(spark, testbed.commerce_events(spark, sf), "activity"), "shop", "monthly")


@check("retention_sketch_error", "A-8 A-23", with_views(BASE).rstrip() + ", exact AS (WITH none AS (SELECT 1)" + _all("day", 1, "base", "project_id = 'p0'")
       + ") SELECT first_seen_date, cohort_size, retained_users, TRUE AS within_bound FROM exact")
def _(spark, sf):
    """Sketches of 256 entries: the true numbers, and whether the estimates are within four standard errors."""
    events = _own_sessions(spark, sf)
    rough = retention.retention_from_sketches(_partials(spark, events, "activity", lg_k=8), "p0", "daily")
    exact = retention.retention(events, "p0", "daily", lookback_days=None)
    bound = F.ceil(F.lit(4 / 16) * events.filter("project_id = 'p0'").agg(F.count_distinct("user_id")).scalar())
    rough = rough.select("first_seen_date", F.col("cohort_size").alias("size"), F.col("retained_users").alias("back"))
    near = lambda a, b: F.abs(F.coalesce(a, F.lit(0)) - F.col(b)) <= bound
    return exact.join(rough, "first_seen_date", "left").select(
        "first_seen_date", "cohort_size", "retained_users", (near("size", "cohort_size") & near("back", "retained_users")).alias("within_bound"))


@check("cohort_matrix_from_sketches", "A-9 A-23", with_views(BASE, """act AS (
  SELECT DISTINCT user_id, date_trunc('week', "timestamp") AS w FROM base),
firsts AS (SELECT user_id, min(w) AS f FROM act GROUP BY 1),
cells AS (SELECT f, date_diff('day', f, w) // 7 AS i, count(*) AS users FROM act JOIN firsts USING (user_id) GROUP BY 1, 2)""") + """
SELECT cast(cast(f AS date) AS varchar) AS cohort, i AS period_index, users,
  round(users / max(CASE WHEN i = 0 THEN users END) OVER (PARTITION BY f) * 100, 2) AS retention_rate FROM cells""")
def _(spark, sf):
    return retention.cohort_matrix_from_sketches(_partials(spark, _own_sessions(spark, sf), "activity"), None, "weekly")


@check("cohort_grid", "A-9", with_views(COMMERCE, """act AS (
  SELECT DISTINCT user_id, date_trunc('month', "timestamp") AS m FROM commerce),
firsts AS (SELECT user_id, min(m) AS f FROM act GROUP BY 1),
cells AS (SELECT f, (year(m) * 12 + month(m)) - (year(f) * 12 + month(f)) AS i, count(*) AS users
  FROM act JOIN firsts USING (user_id) GROUP BY 1, 2)""") + """
SELECT cast(cast(f AS date) AS varchar) AS cohort, max(users) FILTER (WHERE i = 0) AS "0", max(users) FILTER (WHERE i = 1) AS "1",
  max(users) FILTER (WHERE i = 2) AS "2", string_agg(i || '=' || users, ',' ORDER BY i) FILTER (WHERE i > 2) AS later FROM cells GROUP BY f""")
def _(spark, sf):
    grid = retention.cohort_grid(retention.cohort_matrix(testbed.commerce_events(spark, sf), "shop", "monthly"), 3)
    entries = F.array_sort(F.map_entries("later"))
    return grid.withColumn("later", F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ","))


@check("query_latency_merged", "A-27 A-23", with_views(QUERY_LOG) + """
SELECT project_id, error_message IS NULL AS success, count(*) AS queries, TRUE AS p50_near, TRUE AS p95_near,
  max(execution_time_ms) AS max_ms, round(avg(result_count), 2) AS avg_rows,
  round(count(*) / sum(count(*)) OVER (PARTITION BY project_id) * 100, 2) AS share FROM qlog GROUP BY 1, 2""")
def _(spark, sf):
    """From stored partials by day; ``_near`` tells whether the rank of a percentile is within the sketch's bound."""
    log, path = testbed.query_log(spark, sf), work_dir(spark, "latency")
    querylog.latency_partial(log).write.parquet(path)
    answer = querylog.latency_from_partials(spark.read.parquet(path))
    ms = F.col("execution_time_ms")
    ranks = log.withColumn("success", F.col("error_message").isNull()).join(answer.select("project_id", "success", "p50_ms", "p95_ms"), ["project_id", "success"])
    ranks = ranks.groupBy("project_id", "success").agg(F.count(ms).alias("n"), *[
        F.count_if(ms < F.col(p)).alias(f"below_{p}") for p in ("p50_ms", "p95_ms")], *[F.count_if(ms <= F.col(p)).alias(f"upto_{p}") for p in ("p50_ms", "p95_ms")])

    def near(p: str, q: float):
        slack = 0.0165 * F.col("n") + 1
        return (F.col(f"below_{p}") <= q * F.col("n") + slack) & (F.col(f"upto_{p}") >= q * F.col("n") - slack)

    return answer.join(ranks, ["project_id", "success"]).select(
        "project_id", "success", "queries", near("p50_ms", 0.5).alias("p50_near"), near("p95_ms", 0.95).alias("p95_near"), "max_ms", "avg_rows", "share")
