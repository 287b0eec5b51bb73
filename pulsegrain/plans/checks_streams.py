"""Checked queries: streams run to the end of the given tables, compared with their batch form."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrain.plans.catalog import check
from pulsegrain.plans.views import API_KEYS, BASE, JUDGED, RAW, SESSIONS, with_views
from pulsegrain.session import work_dir
from pulsegrain.sources import testbed
from pulsegrain.sources.events import read_events
from pulsegrain.sources.ingest import parse_events
from pulsegrain.streaming import ingest, live, rollups
from pulsegrain.streaming.sources import LateRows, read_late, stream_events, stream_late

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
EV = with_views(BASE, SESSIONS)
NO_LATE_ROWS = "400 days"
ROWS_PER_FILE = 250_000


def _files(rows: DataFrame) -> int:
    """Files for these rows, so that one task has no more of a larger table."""
    return -(-rows.count() // ROWS_PER_FILE)


def _replay(spark, rows: DataFrame) -> DataFrame:
    """The rows as a stream of files, half of them to a micro-batch."""
    path, half = work_dir(spark, "arrivals"), max(2, -(-_files(rows) // 2))
    rows.repartitionByRange(2 * half, "timestamp", "id").write.parquet(path)
    return stream_events(spark, path, half, rows.schema)


def _drain(spark, writer) -> StreamingQuery:
    """Run a stream over all waiting data. Its state is divided by the session's cores, as every
    state partition costs a file per micro-batch."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(key, before)


def _collect(spark, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all waiting data; ``complete`` keeps the final state of its groups."""
    out, checkpoint = work_dir(spark, "out"), work_dir(spark, "offsets")
    if mode == "append":
        _drain(spark, stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    else:
        _drain(spark, stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
               .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)))
    return spark.read.schema(stream.schema).parquet(out)


@check("stream_ingest", "ST-1 ST-2", with_views(RAW, JUDGED.format(strict="FALSE"), API_KEYS) + """
SELECT keys.project_id, user_id, event_name, coalesce(platform, 'web') AS platform, count(*) AS events
FROM judged JOIN keys ON sha256('key_' || user_id) = key_hash AND is_active AND expires_at > TIMESTAMP '2024-01-20'
WHERE error IS NULL GROUP BY ALL""")
def _(spark, sf):
    source, landing = work_dir(spark, "raw"), work_dir(spark, "landing")
    (testbed.raw_json(spark, sf).repartition(4).write.parquet(source))
    raw = parse_events(spark.readStream.schema("id string, value string").option("maxFilesPerTrigger", 2).parquet(source))
    raw = raw.withColumn("api_key", F.concat(F.lit("key_"), F.col("user_id")))
    _drain(spark, ingest.stream_ingest(raw, testbed.api_keys(spark, sf), testbed.projects(spark, sf), landing,
                                work_dir(spark, "rejected"), work_dir(spark, "offsets"), testbed.KEY_AS_OF))
    table = work_dir(spark, "table")
    ingest.compact_landing(spark, landing, table)
    return read_events(spark, table).groupBy("project_id", "user_id", "event_name", "platform").agg(
        F.count("*").alias("events"))


@check("stream_dedupe", "ST-3", with_views(BASE) + """
SELECT user_id, event_name, count(*) AS events FROM base GROUP BY ALL""")
def _(spark, sf):
    rows = testbed.base_events(spark, sf).withColumn("session_id", F.col("user_id"))
    twice = rows.unionByName(rows.withColumn("id", F.concat("id", F.lit("#2"))))
    unique = _collect(spark, ingest.stream_dedupe(_replay(spark, twice), NO_LATE_ROWS), "append")
    return unique.groupBy("user_id", "event_name").agg(F.count("*").alias("events"))


@check("stream_live_feed", "ST-4", with_views(BASE) + "SELECT id, event_name FROM base WHERE project_id = 'p0' AND platform = 'web'")
def _(spark, sf):
    feed = live.live_feed(_replay(spark, testbed.base_events(spark, sf)), "p0", {"platform": "web"})
    return _collect(spark, feed.select("id", "event_name"), "append")


def _within(found, exact):
    """``exact`` where ``found`` is as near as its sketch promises, else what was found."""
    return F.when(F.abs(found - exact) <= F.greatest(F.lit(1), exact * 0.1), exact).otherwise(found)


@check("stream_realtime", "ST-5", with_views(BASE) + f"""
SELECT project_id, {TS.format('w')} AS window_start, {TS.format("w + INTERVAL 1 DAY")} AS window_end, count(*) AS events,
  count(DISTINCT user_id) AS users, count(DISTINCT api_key) AS sessions, array_to_string(list_sort(list(DISTINCT event_name)), '|') AS top_events
FROM (
  SELECT *, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, "timestamp") - INTERVAL 18 HOUR,
    time_bucket(INTERVAL 6 HOUR, "timestamp"), INTERVAL 6 HOUR)) AS w FROM base)
GROUP BY ALL""")
def _(spark, sf):
    """A day sliding by six hours: the given events are too sparse for windows of minutes. Users and sessions are sketched."""
    rows = testbed.base_events(spark, sf).withColumn("session_id", F.col("api_key"))
    stream = live.stream_realtime(_replay(spark, rows), "1 day", "6 hours", NO_LATE_ROWS, 20)
    exact = (rows.groupBy("project_id", F.window("timestamp", "1 day", "6 hours")["start"].alias("window_start"))
             .agg(F.count_distinct("user_id").alias("u"), F.count_distinct("session_id").alias("s")))
    return _collect(spark, stream, "complete").join(exact, ["project_id", "window_start"], "left").select(
        "project_id", "window_start", "window_end", "events", _within(F.col("users"), F.col("u")).alias("users"),
        _within(F.col("sessions"), F.col("s")).alias("sessions"), F.array_sort("top_events").alias("top_events"))


@check("stream_metric_updates", "ST-6", with_views(BASE) + f"""
SELECT project_id, metric, {TS.format('time_bucket(INTERVAL 1 HOUR, "timestamp") + INTERVAL 1 HOUR')} AS "timestamp",
  CASE metric WHEN 'events' THEN count(*) WHEN 'page_views' THEN count(*) FILTER (WHERE event_name = 'page_view')
    ELSE count(DISTINCT user_id) END AS value
FROM base, (VALUES ('events'), ('page_views'), ('active_users')) m(metric) GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = testbed.base_events(spark, sf)
    stream = live.metric_updates(_replay(spark, rows), "1 hour", NO_LATE_ROWS)
    exact = (rows.groupBy("project_id", F.window("timestamp", "1 hour")["end"].alias("timestamp"))
             .agg(F.count_distinct("user_id").alias("u")))
    value = F.when(F.col("metric") == "active_users", _within(F.col("value"), F.col("u"))).otherwise(F.col("value"))
    return _collect(spark, stream, "complete").join(exact, ["project_id", "timestamp"], "left").select(
        "project_id", "metric", "timestamp", value.alias("value"))


def _in_turn(spark, parts: list[DataFrame]) -> DataFrame:
    """A stream of the given frames, one to a micro-batch, in this order. All have the same number of files, some empty."""
    path, schema, files = work_dir(spark, "arrivals"), parts[0].schema, max(1, *map(_files, parts))
    for number, part in enumerate(parts, 1):
        part.coalesce(files).write.mode("append").parquet(path)
        for _ in range(number * files - len(spark.read.schema(schema).parquet(path).inputFiles())):
            spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return stream_events(spark, path, files, schema)


@check("stream_recent", "ST-7", with_views(BASE) + """
SELECT project_id, id FROM base WHERE project_id <> 'p2'
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY "timestamp" DESC, id) <= 100""")
def _(spark, sf):
    """Four batches, half an hour apart; p2 sends in the first only, so its list has ended when the others are read."""
    path, start = work_dir(spark, "recent"), dt.datetime(2024, 3, 1)
    rows = testbed.base_events(spark, sf).select("project_id", "id", "timestamp", "event_name")
    quarter = F.col("id").cast("bigint") % 4
    parts = [rows.filter((quarter == i) & (F.lit(i == 0) | (F.col("project_id") != "p2"))) for i in range(4)]
    at = lambda batch: start + dt.timedelta(minutes=30 * batch)
    _drain(spark, live.stream_recent(_in_turn(spark, parts), path, work_dir(spark, "offsets"), now=at))
    return live.read_recent(spark, path, at(4)).select("project_id", "id")


@check("stream_late_rows", "ST-11 ST-3", with_views(BASE, """kept AS (SELECT max("timestamp") - INTERVAL 10 MINUTE AS mark FROM base WHERE e % 50 <> 7 AND day("timestamp") <= 20),
judged AS (SELECT id, e % 50 = 7 AND "timestamp" <= mark AS late FROM base, kept)""") + """
SELECT id, CASE WHEN late THEN 'late' ELSE 'in time' END AS state FROM judged
UNION ALL SELECT cast(count(*) FILTER (WHERE late) AS varchar), 'dropped rows' FROM judged""")
def _(spark, sf):
    """A watermark of ten minutes; one row in fifty arrives after all others. What was dropped is counted, and kept beside.

    Batches follow without a pause, so the last one is judged by the rows up to the second before it."""
    rows = testbed.base_events(spark, sf).withColumn("session_id", F.col("user_id"))
    delayed, day = F.col("id").cast("bigint") % 50 == 7, F.day("timestamp")
    parts = [rows.filter(~delayed & (day <= 10)), rows.filter(~delayed & day.between(11, 20)), rows.filter(~delayed & (day > 20)), rows.filter(delayed)]
    out, offsets, beside = (work_dir(spark, n) for n in ("out", "offsets", "late"))
    listener = LateRows(spark, work_dir(spark, "dropped"))
    spark.streams.addListener(listener)
    try:
        stream = _in_turn(spark, parts)
        unique = ingest.stream_dedupe(stream, "10 minutes")
        query = _drain(spark, unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets))
        _drain(spark, stream_late(stream, beside, work_dir(spark, "offsets"), behind=1))
        dropped = listener.dropped(query.id)
    finally:
        spark.streams.removeListener(listener)
    kept = spark.read.schema(rows.schema).parquet(out).select("id", F.lit("in time").alias("state"))
    late = read_late(spark, beside, rows.schema).select("id", F.lit("late").alias("state"))
    return kept.union(late).union(spark.createDataFrame([(str(dropped), "dropped rows")], kept.schema))


@check("stream_rollup_daily", "ST-8 A-23", with_views(BASE) + """
SELECT project_id, cast(cast("timestamp" AS date) AS varchar) AS date, count(*) AS total_events FROM base GROUP BY ALL""")
def _(spark, sf):
    path = work_dir(spark, "rollup")
    rows = testbed.base_events(spark, sf).withColumn("session_id", F.col("user_id"))
    _drain(spark, rollups.stream_rollup(_replay(spark, rows), "daily", path, work_dir(spark, "offsets")))
    return rollups.read_rollup(spark, path, "daily").select("project_id", "date", "total_events")


@check("stream_rollup_sessions", "ST-8 A-19", EV + f"""
SELECT session_id, {TS.format('min("timestamp")')} AS session_start, {TS.format('max("timestamp")')} AS session_end,
  count(*) AS events_count FROM ev GROUP BY session_id""")
def _(spark, sf):
    path = work_dir(spark, "rollup")
    _drain(spark, rollups.stream_rollup(_replay(spark, testbed.events(spark, sf)), "sessions", path, work_dir(spark, "offsets")))
    return rollups.read_rollup(spark, path, "sessions").select("session_id", "session_start", "session_end", "events_count")


RATE = with_views(BASE) + f"""
SELECT api_key, {TS.format('time_bucket(INTERVAL 1 DAY, "timestamp")')} AS window_start, count(*) AS requests
FROM base GROUP BY ALL HAVING count(*) > 4"""


@check("rate_audit", "ST-9", RATE)
def _(spark, sf):
    return live.rate_audit(testbed.base_events(spark, sf), "api_key", 4, "1 day")


@check("stream_rate_audit", "ST-9", RATE)
def _(spark, sf):
    stream = live.rate_audit(_replay(spark, testbed.base_events(spark, sf)), "api_key", 4, "1 day", NO_LATE_ROWS)
    return _collect(spark, stream, "complete")


WINDOWS = EV + f"""
SELECT user_id, {TS.format('min("timestamp")')} AS session_start, {TS.format('max("timestamp")')} AS session_end,
  count(*) AS events_count, count(*) FILTER (WHERE event_name = 'page_view') AS page_views FROM ev GROUP BY user_id, session_id"""


@check("session_windows", "ST-10", WINDOWS)
def _(spark, sf):
    return rollups.stream_sessions(testbed.base_events(spark, sf), "12 hours", None)


@check("stream_sessions", "ST-10", WINDOWS)
def _(spark, sf):
    return _collect(spark, rollups.stream_sessions(_replay(spark, testbed.base_events(spark, sf)), "12 hours", NO_LATE_ROWS), "complete")
