"""Cases found in review: duplicate key hashes, line breaks in names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrain.operators import insights
from pulsegrain.operators.joins import resolve_project
from pulsegrain.operators.paging import recent_events
from pulsegrain.operators.querylog import query_history
from pulsegrain.operators.shaping import mask_pii, scroll_milestones
from pulsegrain.schemas import STRICT_NAME_PATTERN
from pulsegrain.session import work_dir
from pulsegrain.sources.events import read_events
from pulsegrain.sources.ingest import content_id
from pulsegrain.streaming import ingest
from pulsegrain.streaming.batches import batch_instant


def test_one_project_per_event_with_duplicate_hashes(spark):
    later = dt.datetime(2030, 1, 1)
    keys = spark.createDataFrame([("p2", "k", True, later), ("p1", "k", True, later)], "project_id string, raw string, is_active boolean, expires_at timestamp")
    projects = spark.createDataFrame([("p1", "one"), ("p2", "two")], "id string, name string")
    events = spark.createDataFrame([(1, "k")], "id int, api_key string")
    out = resolve_project(events, keys.withColumn("key_hash", F.sha2("raw", 256)), projects, dt.datetime(2024, 1, 1)).collect()
    assert [(r.id, r.project_id, r.project_name) for r in out] == [(1, "p1", "one")]


def test_names_with_a_last_line_break_are_rejected(spark):
    rows = spark.createDataFrame([("abc",), ("abc\n",)], "name string")
    assert [r[0] for r in rows.select(F.col("name").rlike(STRICT_NAME_PATTERN)).collect()] == [True, False]


RAW = "user_id string, event_name string, properties string, timestamp string, session_id string, platform string, api_key string"


def test_equal_events_without_a_time_are_all_stored(spark):
    source, landing, rejected, checkpoint, table = (work_dir(spark, n) for n in ("raw", "landing", "rejected", "offsets", "table"))
    click = ("u", "click", None, None, "s", "web", "k")
    timed = ("u", "click", None, "2024-01-05T00:00:00Z", "s", "web", "k")
    for rows in ([click, click, timed], [click, timed]):
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(source)
    keys = spark.createDataFrame([("p1", "k", True, dt.datetime(2999, 1, 1)), ("p1", "old", True, dt.datetime(2024, 1, 1))],
                                 "project_id string, raw string, is_active boolean, expires_at timestamp").withColumn("key_hash", F.sha2("raw", 256))
    projects = spark.createDataFrame([("p1", "one")], "id string, name string")
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.stream_ingest(raw, keys, projects, landing, rejected, checkpoint).trigger(availableNow=True).start().awaitTermination()
    for _ in range(2):
        ingest.compact_landing(spark, landing, table)
        stored = read_events(spark, table).collect()
        assert len(stored) == len({r.id for r in stored}) == 5
    assert len({r.timestamp for r in stored}) == 3  # one instant a batch, and the client's own time
    assert batch_instant(spark, f"{checkpoint}/received", 1) in {r.timestamp for r in stored}


def test_ids_keep_fields_apart(spark):
    rows = spark.createDataFrame([("p", "u|s", None), ("p", "u", "s"), ("p", "u", None), ("p", "u", "")], "project_id string, user_id string, session_id string")
    rows = rows.withColumns({"event_name": F.lit("e"), "timestamp": F.lit(dt.datetime(2024, 1, 1)), "properties": F.lit(None).cast("map<string,string>")})
    assert rows.select(content_id().alias("id")).distinct().count() == 4


def test_series_go_by_the_calendar(spark):
    day = lambda d: dt.date(2024, 1, d)
    daily = spark.createDataFrame([("p", day(d), d) for d in (1, 2, 3, 4, 5, 6, 7, 8, 10, 30)], "project_id string, date date, events long")
    before = {r.date.day: r.previous_events for r in insights.vs_previous(daily, ["events"], "date").collect()}
    assert before[2] == 1 and before[8] == 7 and before[10] is None and before[30] is None
    scored = {r.date.day: r.expected for r in insights.anomalies(daily, "events").collect()}
    assert {d for d, m in scored.items() if m is not None} == {8}
    assert insights.trend(daily, "events").count() == 0
    weeks = spark.createDataFrame([("p", day(1), 5), ("p", day(8), 6), ("p", day(22), 7)], "project_id string, period_start date, events long")
    assert [r.previous_events for r in insights.vs_previous(weeks, ["events"], "period_start", period="weekly").orderBy("period_start").collect()] == [None, 5, None]


def test_scroll_percent_is_rounded_first(spark):
    rows = spark.createDataFrame([("s", "/", 24.6), ("t", "/", 24.4)], "session_id string, page string, scroll_percent double")
    rows = rows.withColumn("timestamp", F.lit(dt.datetime(2024, 1, 1)))
    assert [(r.session_id, r.depth_percent) for r in scroll_milestones(rows).collect()] == [("s", 25)]


def test_dates_are_no_phone_numbers(spark):
    rows = spark.createDataFrame([("on 2024-01-30 12:30 call +49 30 1234567 or 555-123-4567",), (None,), ("",)], "text string")
    out = [r.text for r in mask_pii(rows, "text").collect()]
    assert out == ["on 2024-01-30 12:30 call [phone] or [phone]", None, ""]


def test_limits_above_the_maximum_are_errors(spark):
    rows = spark.createDataFrame([], "id string, project_id string, user_id string, timestamp timestamp, created_at timestamp")
    with pytest.raises(ValueError):
        recent_events(rows, "p", 500)
    with pytest.raises(ValueError):
        query_history(rows, "u", "p", 101)


def test_masking_beside_dates_leaves_no_part_and_nothing_foreign(spark):
    texts = ["bob-2024-01-30@x.com", "call +1 2024-01-30 5551234", "555 1234567 2024-01-30", "2024-01-30 555-123-4567", "1.2.3.4 a@b.co 2024-13-30 12", "x" * 9]
    out = [r.text for r in mask_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text").orderBy("i").collect()]
    assert out == ["[email]", texts[1], "[phone] 2024-01-30", "2024-01-30 [phone]", "[ip] [email] [phone]", texts[5]]


def test_anonymized_sessions_do_not_tell_the_user(spark):
    from pulsegrain.operators.privacy import anonymize_events
    rows = spark.createDataFrame([("u1", "u1-1"), ("u1", "u1-2"), ("u2", "u2-1"), ("u1", None)], "user_id string, session_id string")
    out = anonymize_events(rows, spark.createDataFrame([("u1",)], "id string"), "secret").collect()
    assert not any("u1" in (r.user_id + (r.session_id or "")) for r in out if r.user_id != "u2")
    assert len({r.session_id for r in out}) == 4 and len({r.user_id for r in out}) == 2
