"""Metrics from stored partials: kept up day by day, close to the exact ones, defined where nothing is stored."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrain.operators import querylog, retention, rollups
from pulsegrain.session import work_dir

T0 = dt.datetime(2024, 3, 1)
EVENT = "id string, project_id string, user_id string, session_id string, event_name string, properties map<string,string>, timestamp timestamp"


def event(n, user, day=0, name="page_view", page=None, minute=0, project="p"):
    return (str(n), project, user, user, name, {"page": page} if page else {}, T0 + dt.timedelta(days=day, minutes=minute))


@pytest.fixture(scope="module")
def days(spark):
    """Users u0 to u59; user n is active on days d with d % (n % 5 + 1) == 0, after a start on day n % 4."""
    rows = [event(100 * n + d, f"u{n}", d) for n in range(60) for d in range(12) if d >= n % 4 and (d - n % 4) % (n % 5 + 1) == 0]
    return spark.createDataFrame(rows, EVENT).cache()


def table(df):
    return sorted(map(tuple, df.collect()))


def test_a_new_day_adds_partials_and_reads_no_old_events(spark, days):
    path = work_dir(spark, "activity")
    for d in range(12):
        today = days.filter(F.to_date("timestamp") == (T0 + dt.timedelta(days=d)).date())
        rollups.rollup_partial(today, "activity").write.mode("append").parquet(path)
        stored = spark.read.parquet(path)
        so_far = days.filter(F.col("timestamp") < T0 + dt.timedelta(days=d + 1))
        if d in (0, 5, 11):
            for period in ("daily", "weekly"):
                exact = retention.retention(so_far, "p", period, lookback_days=None)
                assert table(retention.retention_from_sketches(stored, "p", period)) == table(exact)
                assert table(retention.cohort_matrix_from_sketches(stored, "p", period)) == table(retention.cohort_matrix(so_far, "p", period))


def test_cohorts_count_from_the_first_day_asked_for(spark, days):
    since = (T0 + dt.timedelta(days=6)).date()
    later = days.filter(F.to_date("timestamp") >= since)
    made = retention.retention_from_sketches(rollups.rollup_partial(days, "activity"), "p", "daily", since)
    assert table(made) == table(retention.retention(later, "p", "daily", lookback_days=None))


def test_retention_returns_every_cohort(spark):
    rows = spark.createDataFrame([event(d, f"u{d}", d) for d in range(40)], EVENT)
    assert retention.retention(rows, "p", "daily").count() == 40
    assert retention.retention(rows, "p", "daily", newest=20).count() == 20


def test_the_grid_keeps_later_periods(spark, days):
    matrix = retention.cohort_matrix(days, "p", "daily")
    grid = retention.cohort_grid(matrix, 3).collect()
    seen = {(r.cohort, i): u for r in grid for i, u in [*((i, r[str(i)]) for i in range(3)), *(r.later or {}).items()] if u is not None}
    assert seen == {(r.cohort, r.period_index): r.users for r in matrix.collect()}


def test_top_lists_of_days_minutes_and_nothing(spark):
    rows = [event(n, f"u{n % 7}", n % 3, ("page_view", "click", "buy")[n % 3 if n % 5 else 0], f"/{n % 8}", n % 30) for n in range(300)]
    rows += [event(1000, "x", 2, "page_view", "", 5), event(1001, "x", 2, "other", "/hidden", 5, "q")]
    events = spark.createDataFrame(rows, EVENT)
    partials = rollups.rollup_partial(events.filter("id % 2 = 0"), "top_lists").union(rollups.rollup_partial(events.filter("id % 2 = 1"), "top_lists"))
    views = events.filter("project_id = 'p' and event_name = 'page_view' and properties['page'] <> ''")
    today = views.filter(F.to_date("timestamp") == (T0 + dt.timedelta(days=2)).date()).groupBy(F.col("properties.page").alias("page")).count()
    assert table(rollups.top_pages_from_rollup(partials, "p", "1d", n=100)) == table(today)
    exact = views.groupBy(F.col("properties.page").alias("page")).count().orderBy(F.desc("count"), "page").limit(4)
    assert rollups.top_pages_from_rollup(partials, "p", "30d", n=4).collect() == [tuple(r) for r in exact.collect()]
    assert rollups.top_events_from_rollup(partials, "p", "30d", n=1).first().event_name == "page_view"
    assert rollups.top_events_from_rollup(partials, "nobody", "30d").collect() == []
    minutes = rollups.rollup_partial(events, "minutes")
    last = events.filter("project_id = 'p'").filter(F.col("timestamp") >= T0 + dt.timedelta(days=2, minutes=25)).filter("timestamp < '2024-03-03 00:30:00'")
    row = rollups.realtime_from_rollup(minutes, "p", T0 + dt.timedelta(days=2, minutes=29), 5, 2).first()
    assert row.events == last.count() and row.approx_users == last.select("user_id").distinct().count()
    names = [r.event_name for r in last.groupBy("event_name").count().orderBy(F.desc("count"), "event_name").limit(2).collect()]
    assert row.top_events == names
    none = rollups.realtime_from_rollup(minutes, "nobody", T0).first()
    assert (none.events, none.approx_users, none.top_events) == (0, 0, [])


def test_latency_from_days_is_that_of_the_log(spark):
    rows = [(f"p{n % 2}", "late" if n % 10 == 3 else None, None if n % 4 == 3 and n % 10 == 3 else n * 7 % 1000, n % 6 if n % 3 else None, T0 + dt.timedelta(hours=n)) for n in range(400)]
    rows.append(("q", "late", None, None, T0))
    log = spark.createDataFrame(rows, "project_id string, error_message string, execution_time_ms int, result_count int, created_at timestamp")
    exact = {(r.project_id, r.success): r for r in querylog.query_log_stats(log).collect()}
    made = {(r.project_id, r.success): r for r in querylog.latency_from_partials(querylog.latency_partial(log)).collect()}
    assert made.keys() == exact.keys()
    for key, row in made.items():
        assert (row.queries, row.max_ms, row.avg_rows, row.share) == (exact[key].queries, exact[key].max_ms, exact[key].avg_rows, exact[key].share)
        if key != ("q", False):
            assert abs(row.p50_ms - exact[key].p50_ms) <= 40 and abs(row.p95_ms - exact[key].p95_ms) <= 40
    assert (made["q", False].p50_ms, made["q", False].p95_ms) == (None, None)


def test_the_log_is_scanned_once(spark, small_dir):
    from pulsegrain.sources import testbed
    text = querylog.query_log_stats(testbed.query_log(spark, small_dir))._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1
