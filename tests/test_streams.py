"""Replayed batches, late rows, and streams against their batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrain.operators import rollups as batch_rollups
from pulsegrain.operators.paging import recent_per_project
from pulsegrain.schemas import EVENTS
from pulsegrain.session import work_dir
from pulsegrain.sources import testbed
from pulsegrain.sources.events import conform, read_events
from pulsegrain.sources.ingest import parse_events
from pulsegrain.streaming import ingest, live, rollups
from pulsegrain.streaming.sources import LateRows, micro_batch, read_late, stream_events, stream_late

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, small_dir):
    return conform(testbed.events(spark, small_dir)).cache()


def run(writer):
    query = writer.trigger(**micro_batch(available_now=True)).start()
    query.awaitTermination()
    return query


def feed(spark, frames):
    """A folder of files arriving one per batch, in this order."""
    path = work_dir(spark, "feed")
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return path


@pytest.mark.parametrize("name", ["daily", "page_views", "event_names", "hourly", "sessions"])
def test_rollup_written_twice_counts_once(spark, events, name):
    path = work_dir(spark, "partials")
    halves = [events.filter(F.crc32("id") % 2 == i) for i in (0, 1)]
    for attempt in range(2):
        for i, half in enumerate(halves):
            rollups.store_partial(half, name, path, i, "run")
    merged = rollups.read_rollup(spark, path, name)
    exact = batch_rollups.rollup_sessions(events) if name == "sessions" else batch_rollups.rollup_exact(events, name)
    count = "events_count" if name == "sessions" else batch_rollups.rollup_specs()[name].count
    keys = list(batch_rollups.SESSION_KEYS) if name == "sessions" else list(batch_rollups.rollup_specs()[name].keys)
    assert {tuple(r) for r in merged.select(*keys, count).collect()} == {tuple(r) for r in exact.select(*keys, count).collect()}
    for generation in (1, 1):
        assert rollups.compact_rollup(spark, path, name) == generation
        again = rollups.read_rollup(spark, path, name)
        assert {tuple(r) for r in again.select(*keys, count).collect()} == {tuple(r) for r in exact.select(*keys, count).collect()}


def test_merged_sketches_are_close_where_sums_are_not(spark, events):
    daily = batch_rollups.rollup_partial(events, "daily")
    monthly = batch_rollups.active_users_from_rollup(daily, "monthly").agg(F.sum("approx_users").alias("n")).first().n
    true = events.select("user_id").distinct().count()
    summed = batch_rollups.rollup_daily(events).agg(F.sum("active_users")).first()[0]
    assert abs(monthly - true) <= 0.05 * true < summed


def test_recent_equals_batch_and_survives_replay(spark, events):
    path, checkpoint = work_dir(spark, "recent"), work_dir(spark, "offsets")
    frames = [events.filter(F.day("timestamp") <= 10), events.filter(F.day("timestamp").between(11, 20)),
              events.filter(F.day("timestamp") > 20)]
    source = feed(spark, frames)
    stream = stream_events(spark, f"{source}/*", 1).drop("properties")
    run(live.stream_recent(stream, path, checkpoint, n=20))
    expected = {r.id for r in recent_per_project(events, 20).collect()}
    assert {r.id for r in live.read_recent(spark, path).collect()} == expected


def test_late_rows_are_counted_over_restarts_and_kept(spark):
    rows = [("p", "u", T0 + dt.timedelta(minutes=m)) for m in range(9)]
    schema = "project_id string, user_id string, timestamp timestamp"
    early = spark.createDataFrame(rows, schema)
    far = spark.createDataFrame([("p", "u", T0 + dt.timedelta(hours=5)), ("p", "u", None)], schema)
    late = spark.createDataFrame([("p", "u", T0)], schema)
    path, out, beside, totals = (work_dir(spark, n) for n in ("arrivals", "out", "late", "totals"))
    checkpoint, other = work_dir(spark, "offsets"), work_dir(spark, "offsets")
    for frame in (early, far, late, late):
        frame.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        listener = LateRows(spark, totals)  # as after a restart of the driver
        spark.streams.addListener(listener)
        query = run(live.rate_audit(stream, "user_id", 0, "1 hour", "10 minutes").writeStream.format("parquet")
                    .option("path", out).option("checkpointLocation", checkpoint))
        dropped = listener.dropped(query.id)
        spark.streams.removeListener(listener)
        run(stream_late(stream, beside, other))
    assert dropped == 2
    assert [r.requests for r in spark.read.parquet(out).collect()] == [9]
    assert [r.timestamp for r in read_late(spark, beside, early.schema).collect()] == [T0, T0]


def test_reports_of_many_batches_add_up_once(spark):
    path = work_dir(spark, "totals")
    first = LateRows(spark, path)
    for batch in range(150):
        first.count("q", batch, [batch % 3, 1])
    again = LateRows(spark, path)
    again.count("q", 149, [5])
    again.count("q", 150, [4])
    assert again.dropped("q") == sum(b % 3 + 1 for b in range(150)) + 4 and again.dropped("other") == 0


def test_dedupe_across_batches(spark, events):
    rows = events.filter("user_id IS NOT NULL")
    again = rows.filter(F.crc32("id") % 10 == 0).withColumn("id", F.concat("id", F.lit("-again")))
    stream = stream_events(spark, f"{feed(spark, [rows, again])}/*", 1)
    out = work_dir(spark, "out")
    run(ingest.stream_dedupe(stream, "400 days").writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", work_dir(spark, "offsets")))
    assert spark.read.parquet(out).count() == rows.count()


def test_stream_ingest_equals_batch_and_compaction_repeats_safely(spark, small_dir):
    source, landing, rejected = (work_dir(spark, n) for n in ("raw", "landing", "rejected"))
    testbed.raw_json(spark, small_dir).repartition(3).write.parquet(source)

    def raw(reader):
        return parse_events(reader.schema("id string, value string").option("maxFilesPerTrigger", 1).parquet(source)).withColumn(
            "api_key", F.concat(F.lit("key_"), F.col("user_id")))

    keys, projects = testbed.api_keys(spark, small_dir), testbed.projects(spark, small_dir)
    run(ingest.stream_ingest(raw(spark.readStream), keys, projects, landing, rejected, work_dir(spark, "o"), testbed.KEY_AS_OF))
    stored = spark.read.parquet(landing)
    assert stored.select("batch_id").distinct().count() == 3
    _bad = spark.read.parquet(rejected).count()
    from pulsegrain.operators.validation import validate_events
    valid, refused = validate_events(raw(spark.read))
    assert _bad == refused.count() and stored.count() <= valid.count()
    table, unique = work_dir(spark, "table"), stored.count()
    assert stored.select("id").distinct().count() == unique
    for taken in (3, 0):
        assert ingest.compact_landing(spark, landing, table) == taken
        assert read_events(spark, table).count() == unique
    assert set(EVENTS.names) < set(read_events(spark, table).columns)


def test_metric_updates_and_feed(spark, events):
    path = feed(spark, [events])
    out = work_dir(spark, "out")
    updates = live.metric_updates(stream_events(spark, f"{path}/*"), "1 day", "400 days")
    run(updates.writeStream.outputMode("complete").option("checkpointLocation", work_dir(spark, "o"))
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)))
    total = spark.read.parquet(out).filter("metric = 'events'").agg(F.sum("value")).first()[0]
    assert total == events.count()
    assert live.live_feed(events, "p0", {"platform": "web", "k": "1"}).count() == events.filter(
        "project_id = 'p0' AND platform = 'web' AND properties['k'] = '1'").count()


def test_a_new_checkpoint_on_the_same_landing_loses_nothing(spark):
    schema = "user_id string, event_name string, properties string, timestamp string, session_id string, platform string, api_key string"
    landing, rejected, table = (work_dir(spark, n) for n in ("landing", "rejected", "table"))
    keys = spark.createDataFrame([("p1", "k", True, dt.datetime(2999, 1, 1))], "project_id string, raw string, is_active boolean, expires_at timestamp").withColumn(
        "key_hash", F.sha2("raw", 256))
    projects = spark.createDataFrame([("p1", "one")], "id string, name string")
    for start, name in enumerate(("a", "b")):
        source = work_dir(spark, "raw")
        spark.createDataFrame([(f"u{i}", name, None, "2024-01-05T00:00:00Z", "s", "web", "k") for i in range(3 - start)], schema).coalesce(1).write.parquet(source)
        raw = spark.readStream.schema(schema).parquet(source)
        run(ingest.stream_ingest(raw, keys, projects, landing, rejected, work_dir(spark, "offsets")))  # each counts from batch 0
        assert ingest.compact_landing(spark, landing, table) == 1
    assert sorted((r.user_id, r.event_name) for r in read_events(spark, table).collect()) == [("u0", "a"), ("u0", "b"), ("u1", "a"), ("u1", "b"), ("u2", "a")]
    # A call that was cut short after it had stored its rows is made up for without storing them twice.
    from pulsegrain.sources.ledger import mark, read_ledger
    ledger = work_dir(spark, "ledger")
    mark(read_ledger(spark, f"{table}-landed").select("unit").distinct(), ledger, done=False)
    assert ingest.compact_landing(spark, landing, table, ledger) == 2 and read_events(spark, table).count() == 5


def test_rollup_is_compacted_in_the_middle_of_a_stream(spark, events):
    frames = [events.filter(F.crc32("id") % 6 == i) for i in range(6)]
    moved = [f.withColumn("timestamp", F.col("timestamp") + F.make_interval(months=F.lit(i // 3))) for i, f in enumerate(frames)]
    path, checkpoint, source = work_dir(spark, "rollup"), work_dir(spark, "offsets"), work_dir(spark, "feed")
    total, seen = 0, []
    for i, frame in enumerate(moved):
        frame.coalesce(1).write.parquet(f"{source}/part={i}")
        if i == 0:
            schema = spark.read.parquet(f"{source}/part=0").schema
        run(rollups.stream_rollup(stream_events(spark, f"{source}/*", 1, schema), "daily", path, checkpoint))
        total += frame.count()
        open_read = rollups.read_rollup(spark, path, "daily")
        if i % 2:
            seen.append(rollups.compact_rollup(spark, path, "daily"))
        assert open_read.agg(F.sum("total_events")).first()[0] == total  # planned before the compaction
        assert rollups.read_rollup(spark, path, "daily").agg(F.sum("total_events")).first()[0] == total
    assert seen == [1, 2, 3]
    months = sorted({r.m for r in rollups.read_rollup(spark, path, "daily").select(F.date_format("date", "yyyyMM").alias("m")).collect()})
    for month in months:
        part = rollups.read_rollup(spark, path, "daily", [month])
        assert part.count() == rollups.read_rollup(spark, path, "daily").filter(F.date_format("date", "yyyyMM") == month).count()
        assert all(f"month={month}" in f for f in part.inputFiles())
    assert rollups.read_rollup(spark, path, "daily", ["199901"]).count() == 0


def test_a_batch_that_is_not_whole_is_not_read(spark, events):
    path = work_dir(spark, "rollup")
    rollups.store_partial(events, "daily", path, 0, "run")
    from pulsegrain.streaming.batches import replace_batch
    partial = rollups.partial_of(events, "daily").withColumn("month", F.date_format("date", "yyyyMM"))
    replace_batch(partial, f"{path}/live", 1, "run", ["month"])  # and then the driver died
    for _ in range(2):
        assert rollups.read_rollup(spark, path, "daily").agg(F.sum("total_events")).first()[0] == events.count()
        rollups.compact_rollup(spark, path, "daily")
    rollups.store_partial(events, "daily", path, 1, "run")
    assert rollups.read_rollup(spark, path, "daily").agg(F.sum("total_events")).first()[0] == 2 * events.count()


def test_lists_of_idle_projects_end(spark):
    schema = "project_id string, id string, timestamp timestamp"
    path, checkpoint, source = work_dir(spark, "recent"), work_dir(spark, "offsets"), work_dir(spark, "feed")
    at = lambda batch: T0 + dt.timedelta(minutes=40 * batch)
    with pytest.raises(ValueError):
        live.read_recent(spark, path)
    for batch, rows in enumerate(([("idle", "a"), ("live", "b")], [("live", "c")], [("live", "d")])):
        spark.createDataFrame([(p, i, T0 - dt.timedelta(days=batch)) for p, i in rows], schema).coalesce(1).write.mode("append").parquet(source)
        run(live.stream_recent(spark.readStream.schema(schema).parquet(source), path, checkpoint, n=2, now=at))
        ids = lambda when: sorted(r.id for r in live.read_recent(spark, path, when).collect())  # noqa: E731, B023
        if batch == 1:
            assert ids(at(1)) == ["a", "b", "c"] and ids(T0 + dt.timedelta(minutes=61)) == ["b", "c"]
    assert ids(at(2)) == ["b", "c"] and ids(at(4)) == []  # the newest two by time; and nothing an hour after the last push
