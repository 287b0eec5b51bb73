"""Counts of events, users and sessions against plain counting; experiments against one control row."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrain.operators import dedupe, metrics
from pulsegrain.sources import testbed

ROWS = [("a", "u1", "s1", 1), ("a", "u1", "s1", 2), ("a", "u2", "s2", None), ("a", None, "s3", 4), ("b", "u1", None, 5),
        (None, "u3", "s4", None), (None, "u3", "s5", 7), ("b", None, None, 8)]
SCHEMA = "k string, user_id string, session_id string, v long"


@pytest.mark.parametrize("sessions", ["sessions", None])
def test_counts_are_those_of_plain_counting(spark, sessions):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.k: r for r in metrics.counts_users_sessions(df, ["k"], sessions=sessions, sums={"total": F.col("v")}).collect()}
    expected = defaultdict(list)
    for row in ROWS:
        expected[row[0]].append(row)
    assert set(got) == set(expected)
    for k, rows in expected.items():
        assert got[k].events == len(rows)
        assert got[k].users == len({r[1] for r in rows} - {None})
        assert got[k].total == sum(r[3] or 0 for r in rows)
        if sessions:
            assert got[k].sessions == len({r[2] for r in rows} - {None})
        else:
            assert "sessions" not in got[k].asDict()


def test_counts_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [tuple(r) for r in metrics.counts_users_sessions(df, []).collect()] == [(8, 3, 5)]
    assert [tuple(r) for r in metrics.counts_users_sessions(df.limit(0), []).collect()] == [(0, 0, 0)]
    assert metrics.counts_users_sessions(df.limit(0), ["k"]).count() == 0
    by_expression = metrics.counts_users_sessions(df, [F.upper("k")]).collect()
    assert sorted((r["_k0"] or "", r.events) for r in by_expression) == [("", 2), ("A", 4), ("B", 2)]


def test_distinct_counts_take_two_shuffles(spark, small_dir):
    rows = testbed.base_events(spark, small_dir).withColumn("session_id", F.col("id"))
    text = metrics.active_users(rows)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and text.count("FileScan") == 1


EVENTS = "user_id string, event_name string, properties map<string,string>"


def _tried(variant, users, goal):
    return [(f"{variant}{i}", name, {"experiment": variant}) for i in range(users) for name in ["view"] + ["buy"] * (i < goal)]


def test_experiment_against_its_control(spark):
    df = spark.createDataFrame(_tried("control", 40, 10) + _tried("new", 50, 25) + [("x", "buy", {}), ("x", "buy", None)], EVENTS)
    out = metrics.experiment_readout(df, "buy", "control")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.variant: r for r in out.collect()}
    assert {v: (r.users, r.converted, r.conversion_rate, r.difference) for v, r in got.items()} == {
        "control": (40, 10, 25.0, 0.0), "new": (50, 25, 50.0, 25.0)}
    pooled = 35 / 90
    assert got["new"].z_score == pytest.approx(0.25 / (pooled * (1 - pooled) * (1 / 50 + 1 / 40)) ** 0.5, abs=1e-4)


def test_repeated_deliveries_differ_by_long_properties(spark):
    long = "x" * 100_000
    rows = [(i, "u", "s", "e", dt.datetime(2024, 1, 1), p) for i, p in enumerate(
        [{"a": long, "b": "1"}, {"b": "1", "a": long}, {"a": long + "y", "b": "1"}, {}, {}, None, None])]
    df = spark.createDataFrame(rows, "id long, user_id string, session_id string, event_name string, timestamp timestamp, properties map<string,string>")
    assert sorted(r.id for r in dedupe.dedupe_events(df).select("id").collect()) == [0, 2, 3, 5]
