"""Results where one user holds most rows, against plain algorithms on the driver."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from pulsegrain.operators.funnel import funnel_depth
from pulsegrain.operators.sessions import sessionize
from pulsegrain.operators.shaping import active_time

STEPS = ["a", "b", "c", "d"]
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def history(spark):
    """60 users over 12 days; one of them has half of all rows. Many equal timestamps."""
    rng = random.Random(7)
    rows = []
    for user in range(60):
        for _ in range(900 if user == 0 else rng.randint(1, 30)):
            rows.append((f"u{user}", rng.choice(STEPS + ["noise"]), T0 + dt.timedelta(minutes=10 * rng.randint(0, 1700))))
    rows = [(f"{i:05d}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "id string, user_id string, event_name string, timestamp timestamp").cache()


def brute_depth(rows, within):
    rows = sorted(rows, key=lambda r: (r.timestamp, r.id))
    best = 0
    for i, start in enumerate(rows):
        if start.event_name != STEPS[0]:
            continue
        depth = 1
        for row in rows[i + 1:]:
            if depth < len(STEPS) and row.event_name == STEPS[depth] and row.timestamp - start.timestamp <= within:
                depth += 1
        best = max(best, depth)
    return best


@pytest.mark.parametrize("hours,slice_hours", [(2, 24), (10, 1), (48, 6), (480, 24)])
def test_funnel_depth_equals_brute_force(history, hours, slice_hours):
    within = dt.timedelta(hours=hours)
    per_user = {}
    for row in history.collect():
        per_user.setdefault(row.user_id, []).append(row)
    expected = {u: d for u, d in ((u, brute_depth(r, within)) for u, r in per_user.items())
                if any(x.event_name in STEPS for x in per_user[u])}
    got = {r.user_id: r.depth for r in funnel_depth(history, STEPS, within, dt.timedelta(hours=slice_hours)).collect()}
    assert got == expected


@pytest.mark.parametrize("minutes", [10, 30, 600])
def test_sessionize_equals_plain_window(history, minutes):
    gap = dt.timedelta(minutes=minutes)
    w = Window.partitionBy("user_id").orderBy("timestamp", "id")
    new = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(w) > F.lit(gap), F.lit(True)).cast("int")
    plain = history.withColumn("_new", new).select(
        "id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    assert {(r.id, r.n) for r in plain.collect()} == {(r.id, r.session_no) for r in sessionize(history, gap).collect()}


@pytest.mark.parametrize("slice_hours", [1, 24, 1000])
def test_active_time_does_not_depend_on_the_slices(history, slice_hours):
    rows = history.select("id", F.col("user_id").alias("session_id"), F.lit("/p").alias("page"), "timestamp",
                          F.col("event_name").isin("a", "b").alias("visible"))
    w = Window.partitionBy("session_id").orderBy("timestamp", "id")
    span = F.unix_seconds(F.lead("timestamp").over(w)) - F.unix_seconds("timestamp")
    plain = rows.withColumn("_s", F.when(F.col("visible"), span)).groupBy("session_id").agg(
        F.coalesce(F.sum("_s"), F.lit(0)).alias("n")).filter("n > 5")
    got = active_time(rows, slice_width=dt.timedelta(hours=slice_hours))
    assert {tuple(r) for r in plain.collect()} == {(r.session_id, r.active_seconds) for r in got.collect()}


@pytest.fixture()
def tiny_thresholds(spark):
    """Sizes at which Spark treats partitions as skewed, lowered to suit test data; no broadcasts."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
               "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
               "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hot(spark):
    """200000 events, 40 percent of them of one user; half of those inside one minute."""
    return spark.range(0, 200000, 1, 8).selectExpr(
        "string(id) AS id", "'p' AS project_id", "if(id % 5 < 2, 'hot', concat('u', id % 997)) AS user_id",
        "'x' AS event_name", "map('k', string(id)) AS properties",
        "timestamp_seconds(1704067200 + if(id % 5 = 0, id % 60, id * 7)) AS timestamp")


@pytest.mark.parametrize("job", ["with_user", "anonymize", "erase", "segment", "sessionize", "stitch", "lookup"])
def test_hot_join_keys_are_split(spark, tiny_thresholds, job):
    from pulsegrain.operators.filters import in_segment
    from pulsegrain.operators.joins import with_user
    from pulsegrain.operators.privacy import anonymize_events, erase
    from pulsegrain.operators.shaping import stitch_identity
    from pulsegrain.sources.dimensions import resolve_fk
    rows = _hot(spark)
    users = spark.range(998).selectExpr("if(id = 997, 'hot', concat('u', id)) AS id", "'s' AS segment")
    out = {"with_user": lambda: with_user(rows, users), "anonymize": lambda: anonymize_events(rows, users.select("id")),
           "erase": lambda: erase({"events": rows}, users.filter("id <> 'hot'").select("id"))["events"],
           "segment": lambda: in_segment(rows, users, F.col("segment") == "s"),
           "stitch": lambda: stitch_identity(rows.withColumn("session_id", F.col("user_id"))),
           "lookup": lambda: resolve_fk(rows, users.withColumnRenamed("id", "user_id"), "user_id", "segment", "s"),
           "sessionize": lambda: sessionize(rows, dt.timedelta(minutes=30))}[job]()
    expected = 80000 if job == "erase" else 200000
    assert len(out.collect()) == expected
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
