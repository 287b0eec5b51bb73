"""Shapes of physical plans that must hold at scale."""

import datetime as dt

import pytest

from pulsegrain.operators import dedupe, funnel, paging, retention, sessions
from pulsegrain.plans.catalog import load
from pulsegrain.sources import testbed

ENTRIES = load()
# These write, or run a stream, while the frame is built.
BUILT_BY_RUNNING = {n for n, e in ENTRIES.items()
                    if n.startswith("stream_") or n in ("event_table_scan", "ingest_json_lines", "dimension_scan", "erased_from_store",
                                                        "page_after_cursor", "date_range_stored", "sessions_on_user_copy")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ENTRIES) - BUILT_BY_RUNNING))
def test_no_python_and_no_cross_products(spark, small_dir, name):
    text = plan(ENTRIES[name].run(spark, small_dir))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_group_limit_runs_before_the_shuffle(spark, small_dir):
    rows = testbed.base_events(spark, small_dir)
    # Before and after each of the two shuffles: by project and lane, then by project.
    assert plan(paging.recent_per_project(rows)).count("WindowGroupLimit") == 4
    deduped = plan(dedupe.dedupe_events(rows.withColumn("session_id", rows["user_id"])))
    assert deduped.count("WindowGroupLimit") == 2


def test_ordered_funnel_sorts_users_only_by_slices(spark, small_dir):
    text = plan(funnel.ordered_funnel(testbed.base_events(spark, small_dir), ["page_view", "click", "purchase"], dt.timedelta(hours=4)))
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    assert len(exchanges) == 3  # by user and slice, by user (one row per slice), single total
    assert sum("hashpartitioning(user_id" in e and "_slice" in e for e in exchanges) == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp,user_id:bigint,event_type:string>" in text
    assert "Join" not in text


def test_sessionize_does_not_sort_events(spark, small_dir):
    text = plan(sessions.sessionize(testbed.base_events(spark, small_dir), dt.timedelta(hours=12)))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("_slice" in w for w in windows)
    assert "HashAggregate(keys=[user_id" in text


def test_retention_scans_once(spark, small_dir):
    text = plan(retention.retention(testbed.base_events(spark, small_dir), "p0", as_of=dt.datetime(2024, 2, 1)))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_time_range_reaches_the_scan(spark, small_dir):
    from pulsegrain.operators.filters import in_range
    text = plan(in_range(testbed.base_events(spark, small_dir), "7d", dt.datetime(2024, 1, 20)).select("id"))
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp>" in text
