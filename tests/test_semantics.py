"""Hand-computed cases for rules that are easy to get wrong."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pulsegrain.functions import props, text
from pulsegrain.functions.numbers import percent, ratio
from pulsegrain.operators import dedupe, filters, funnel, metrics, paging, retention, sessions, shaping, users, validation
from pulsegrain.operators.joins import resolve_project
from pulsegrain.schemas import RAW_EVENT
from pulsegrain.sources import dimensions, ingest

T0 = dt.datetime(2024, 1, 1)
EVENT = ("id string, project_id string, user_id string, session_id string, event_name string, "
         "timestamp timestamp, properties map<string,string>")


def at(**kw):
    return T0 + dt.timedelta(**kw)


def events(spark, rows):
    """Rows of (user, name, time[, properties[, session]])."""
    full = [(str(i), "p", r[0], r[4] if len(r) > 4 else f"s-{r[0]}", r[1], r[2], r[3] if len(r) > 3 else {})
            for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_missing_empty_and_non_numeric_properties(spark):
    df = events(spark, [("a", "page_view", T0, {"load_time": "x"}), ("a", "page_view", T0, {"page": "", "load_time": "3"}),
                        ("a", "page_view", T0, {"page": "/x"})])
    got = values(df.select(props.prop("page").alias("p"), props.prop_num("load_time").alias("l")), "p", "l")
    assert got == [("", None), ("", 3.0), ("/x", None)]
    assert filters.has_prop(df, "page").count() == 1


def test_zero_denominator(spark):
    row = spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("r"), percent(F.lit(3), F.lit(0)).alias("p")).first()
    assert (row.r, row.p) == (0.0, 0.0)


def test_range_is_inclusive_at_both_ends_and_unknown_preset_is_thirty_days(spark):
    now = at(days=60)
    df = events(spark, [("a", "x", now - dt.timedelta(days=7)), ("a", "x", now - dt.timedelta(days=7, seconds=1)),
                        ("a", "x", now), ("a", "x", now + dt.timedelta(seconds=1))])
    assert filters.in_range(df, "7d", now).count() == 2
    assert filters.in_range(df, "nonsense", now).count() == 3


def funnel_numbers(df):
    return values(df.orderBy("step"), "users", "conversion_rate", "overall_conversion")


def test_funnel_sample_numbers(spark):
    sizes = {"page_view": 1000, "add_to_cart": 300, "purchase": 45}
    df = events(spark, [(str(u), n, T0) for n, k in sizes.items() for u in range(k)])
    got = funnel_numbers(funnel.funnel(df, list(sizes), "p", as_of=at(days=1)))
    assert got == [(1000, 100.0, 100.0), (300, 30.0, 30.0), (45, 15.0, 4.5)]


def test_unordered_funnel_can_exceed_hundred_percent_and_handles_no_rows(spark):
    df = events(spark, [("a", "one", T0), ("a", "two", T0), ("b", "two", T0)])
    assert funnel_numbers(funnel.funnel(df, ["one", "two"], "p", as_of=T0)) == [(1, 100.0, 100.0), (2, 200.0, 200.0)]
    assert funnel_numbers(funnel.funnel(df, ["none", "two"], "p", as_of=T0))[1] == (2, 0.0, 0.0)
    assert funnel_numbers(funnel.funnel(df, ["one", "two"], "other", as_of=T0)) == [(0, 0.0, 0.0)] * 2
    with pytest.raises(ValueError, match="At least 2 events"):
        funnel.funnel(df, ["one"], "p")


def test_funnel_segment(spark):
    df = events(spark, [("a", "one", T0), ("a", "two", T0), ("b", "two", T0)])
    chosen = spark.createDataFrame([("b",)], "id string")
    assert [r[0] for r in funnel_numbers(funnel.funnel(df, ["one", "two"], "p", as_of=T0, segment=chosen))] == [0, 1]


def test_retention_counts_exact_distance_only(spark):
    df = events(spark, [("a", "x", at(days=d)) for d in (0, 1, 7, 30)] + [("b", "x", at(days=d)) for d in (0, 2)])
    daily = values(retention.retention(df, "p", "daily"), "cohort_size", "retained_users", "retention_rate")
    assert daily == [(2, 1, 50.0)]
    # January has 31 days: month starts are never 30 days apart, while the matrix sees month 1.
    assert values(retention.retention(df, "p", "monthly"), "cohort_size", "retained_users") == [(2, 0)]
    april = events(spark, [("a", "x", dt.datetime(2024, 4, 3)), ("a", "x", dt.datetime(2024, 5, 3))])
    assert values(retention.retention(april, "p", "monthly"), "retained_users") == [(1,)]


def test_retention_lookback_restarts_cohorts(spark):
    df = events(spark, [("a", "x", T0), ("a", "x", at(days=100)), ("a", "x", at(days=101))])
    assert values(retention.retention(df, "p"), "cohort_size", "retained_users") == [(1, 1)]
    assert retention.retention(df, "p", lookback_days=None).first().first_seen_date == T0.date()
    joined = retention.retention_by_join(df, "p")
    assert joined.collect() == retention.retention(df, "p").collect()


def test_duplicate_deliveries_with_other_key_order(spark):
    one, other = {"a": "1", "b": "2"}, {"b": "2", "a": "1"}
    df = events(spark, [("u", "x", T0, one), ("u", "x", T0, other), ("u", "x", T0, one), ("u", "x", T0, other)])
    once = dedupe.dedupe_events(df)
    assert values(once, "id") == [("0",)]
    assert dedupe.dedupe_events(once).count() == 1
    assert dedupe.dedupe_events(events(spark, [("u", "x", T0, one), ("u", "x", T0, {"a": "1"})])).count() == 2


def test_event_properties_win_over_defaults(spark):
    df = events(spark, [("u", "x", T0, {"k": "own"})])
    merged = shaping.merge_props(df, F.create_map(F.lit("k"), F.lit("default"), F.lit("lang"), F.lit("en")))
    assert merged.first().properties == {"k": "own", "lang": "en"}


def test_full_last_page_has_no_more(spark):
    df = spark.range(40)
    pages = [paging.paginate(df, [F.col("id")], page=n, limit=20) for n in (1, 2, 3)]
    assert [(p.count(), {r.has_more for r in p.collect()}) for p in pages] == [(20, {True}), (20, {False}), (0, set())]
    with pytest.raises(ValueError):
        paging.cap(df, 10001)


def test_keys_expired_without_expiry_or_inactive_are_refused(spark):
    keys = spark.createDataFrame(
        [("h1", T0, True), ("h2", None, True), ("h3", at(days=9), False), ("h4", at(days=9), True)],
        "key string, expires_at timestamp, is_active boolean")
    keys = keys.select(F.sha2("key", 256).alias("key_hash"), F.lit("p").alias("project_id"), "expires_at", "is_active")
    projects = spark.createDataFrame([("p", "Demo")], "id string, name string")
    sent = spark.createDataFrame([(k,) for k in ("h1", "h2", "h3", "h4", "h5")], "api_key string").withColumn("project_id", F.lit(None))
    assert values(resolve_project(sent, keys, projects, at(days=1)), "api_key", "project_name") == [("h4", "Demo")]


def test_sql_out_of_replies(spark):
    replies = ["Here:\n```sql\nSELECT 1;\n```\nbye", "```\nselect 2\n```", "Sure. SELECT 3 FROM t;", " no query; "]
    df = spark.createDataFrame([(r,) for r in replies], "reply string").select(text.extract_sql("reply").alias("s"))
    assert [r.s for r in df.collect()] == ["SELECT 1", "select 2", "SELECT 3 FROM t", "no query"]


def test_sql_audit_substring_and_word_rules(spark):
    sql = ["SELECT created_at FROM e WHERE project_id = 1", "DROP TABLE e", "SELECT 1 FROM e LIMIT 5"]
    df = spark.createDataFrame([(s,) for s in sql], "sql string")
    loose = [r.e for r in df.select(text.sql_errors("sql").alias("e")).collect()]
    strict = [r.e for r in df.select(text.sql_errors("sql", True).alias("e")).collect()]
    assert loose[0] == ["Dangerous operation detected: CREATE"] and strict[0] == []
    assert len(loose[1]) == 3 and loose[2] == ["Query must include project_id filter for security"]
    assert df.select(F.size(text.sql_warnings("sql")).alias("n")).collect()[2].n == 1


def test_scroll_milestones_take_first_crossing(spark):
    rows = [("s", "/a", at(seconds=i), p) for i, p in enumerate((10, 30, 80, 100))]
    df = spark.createDataFrame(rows, "session_id string, page string, timestamp timestamp, scroll_percent int")
    got = sorted(values(shaping.scroll_milestones(df), "depth_percent", "timestamp"))
    assert got == [(25, at(seconds=1)), (50, at(seconds=2)), (75, at(seconds=2)), (100, at(seconds=3))]


@pytest.mark.parametrize("slice_width", [dt.timedelta(seconds=2), dt.timedelta(hours=1)])
def test_active_time_sums_visible_parts(spark, slice_width):
    rows = [("1", "s", "/a", 0, True), ("2", "s", "/a", 4, False), ("3", "s", "/a", 64, True), ("4", "s", "/a", 67, False),
            ("5", "s", "/b", 0, True), ("6", "s", "/b", 5, False)]
    df = spark.createDataFrame([(i, s, p, at(seconds=t), v) for i, s, p, t, v in rows],
                               "id string, session_id string, page string, timestamp timestamp, visible boolean")
    assert values(shaping.active_time(df, slice_width=slice_width), "page", "active_seconds") == [("/a", 7)]


def test_identity_is_stitched_within_a_session(spark):
    df = events(spark, [(None, "x", T0, {}, "s1"), ("u", "x", at(hours=1), {}, "s1"), ("anonymous_s2", "x", T0, {}, "s2")])
    got = sorted(values(shaping.stitch_identity(df), "id", "stitched_user_id"))
    assert got == [("0", "u"), ("1", "u"), ("2", "anonymous_s2")]


def test_typed_properties(spark):
    df = events(spark, [("u", "purchase", T0, {"order_id": "o", "total": "99.99", "quantity": "x"})])
    row = shaping.typed_props(df, shaping.COMMERCE_SPEC).first()
    assert (row.order_id, row.value, row.quantity, row.currency) == ("o", 99.99, None, None)


def raw(spark, *bodies):
    df = spark.createDataFrame([(json.dumps(b) if not isinstance(b, str) else b,) for b in bodies], "value string")
    return ingest.parse_events(df)


def test_validation_first_error_and_both_spellings(spark):
    good = {"user_id": "u", "event_name": "x", "properties": {"n": 1, "b": True, "s": "t"}, "timestamp": "2024-01-01T00:00:00Z"}
    mobile = {"userId": "u", "eventName": "x", "timestamp": 1704067200000, "platform": "android"}
    bad = [{**good, "user_id": None}, {**good, "event_name": "y" * 101}, {**good, "properties": {"a": {"b": 1}}},
           {**good, "properties": {"a": None}}, {**good, "timestamp": "yesterday"}, {**good, "platform": "tv"}, "not json"]
    valid, rejected = validation.validate_events(raw(spark, good, mobile, *bad))
    rows = validation.apply_defaults(valid, at(days=1)).collect()
    assert [r.timestamp for r in rows] == [T0, T0]
    assert rows[0].properties == {"n": "1", "b": "true", "s": "t"}
    assert (rows[1].properties, rows[1].platform) == ({}, "android")
    assert sorted(r.field for r in rejected.collect()) == [
        "event_name", "platform", "properties", "properties", "timestamp", "user_id", "user_id"]


def test_uuid_mode_and_whole_batch_rejection(spark):
    uid = "123e4567-e89b-42d3-a456-426614174000"
    df = raw(spark, {"user_id": uid, "event_name": "x"}, {"user_id": "anonymous_1", "event_name": "x"}).withColumn("batch_id", F.lit("b"))
    assert validation.validate_events(df, id_pattern="uuid")[0].count() == 1
    assert validation.validate_events(df)[0].count() == 2
    valid, rejected = validation.validate_events(df, id_pattern="uuid", all_or_nothing="batch_id")
    assert (valid.count(), rejected.count()) == (0, 2)


def test_strict_limits(spark):
    many = {f"k{i}": 1 for i in range(51)}
    df = raw(spark, {"user_id": "u", "event_name": "a b"}, {"user_id": "u", "event_name": "a", "properties": many},
             {"user_id": "u", "event_name": "a", "properties": {"t": "x" * 10000}}, {"user_id": "u", "event_name": "a-b_1"})
    _valid, rejected = validation.validate_events(df, strict=True)
    assert sorted(r.error for r in rejected.collect()) == ["Invalid event name format", "Properties too large", "Too many properties"]


def test_envelopes_of_wrong_size_are_refused_whole(spark):
    event = {"user_id": "u", "event_name": "x"}
    df = spark.createDataFrame([("one", json.dumps({"events": [event]})), ("none", json.dumps({"events": []})),
                                ("many", json.dumps({"events": [event] * 101})), ("junk", "{}")], "batch_id string, value string")
    rows, rejected = ingest.explode_batches(df)
    assert values(rows, "batch_id", "user_id") == [("one", "u")]
    assert sorted(r.batch_id for r in rejected.collect()) == ["junk", "many", "none"]
    assert set(RAW_EVENT.names) - {"userId", "eventName", "sessionId"} <= set(rows.columns)


def test_seeds_twice_add_nothing_and_lookups_resolve(spark):
    people = [("john.doe@company.com", "John"), ("jane.smith@company.com", "Jane"), ("bob.wilson@company.com", "Bob")]
    seed = spark.createDataFrame(people, "email string, first_name string").withColumn("id", F.substring("first_name", 1, 1))
    first = dimensions.insert_absent(seed.limit(0), seed, "email")
    assert first.count() == 3 and dimensions.insert_absent(first, seed, "email").count() == 3
    nulls = spark.createDataFrame([(None, "N", "n")] * 2, "email string, first_name string, id string")
    assert dimensions.insert_absent(first, nulls, "email").count() == 5
    found = spark.createDataFrame([("jane.smith@company.com",), ("nobody",)], "email string")
    assert sorted(values(dimensions.resolve_fk(found, first, "email", "id", "user_id"), "email", "user_id")) == [
        ("jane.smith@company.com", "J"), ("nobody", None)]


def test_sessions_break_only_above_the_gap(spark):
    times = [0, 30, 60, 91, 200]
    df = events(spark, [("u", "x", at(minutes=m)) for m in times] + [(None, "x", T0)])
    got = sorted(values(sessions.sessionize(df), "id", "session_id"))
    assert got == [("0", "u-1"), ("1", "u-1"), ("2", "u-1"), ("3", "u-2"), ("4", "u-3"), ("5", None)]


def test_stickiness_counts_trailing_days(spark):
    df = events(spark, [("a", "x", at(days=0)), ("a", "x", at(days=2)), ("b", "x", at(days=1)), ("c", "x", at(days=40))])
    got = {str(d): (n, m) for d, n, m in values(users.stickiness(df), "date", "dau", "mau")}
    assert got["2024-01-01"] == (1, 1) and got["2024-01-02"] == (1, 2) and got["2024-01-03"] == (1, 2)
    # The 30 days up to 31 January begin on the 2nd (b and a), up to 1 February on the 3rd (a).
    assert got["2024-01-31"] == (0, 2) and got["2024-02-01"] == (0, 1) and got["2024-02-02"] == (0, 0)
    assert got["2024-02-10"] == (1, 1)
    assert len(got) == 41


def test_overview_of_nothing(spark):
    row = metrics.overview(events(spark, [("a", "x", T0)]), "absent", as_of=T0).first()
    assert tuple(row) == (0, 0, 0, 0, 0.0)
    snap = metrics.realtime_snapshot(events(spark, [("a", "x", T0)]), "absent", T0).first()
    assert tuple(snap) == (0, 0, 0, [])


def test_breakdown_of_any_metric(spark):
    df = events(spark, [("a", "x", T0), ("b", "y", T0)])
    out = metrics.breakdown_of(lambda d: metrics.overview(d, "p", as_of=T0), df, "event_name", ["x", "y"])
    assert sorted(values(out, "event_name", "total_events")) == [("x", 1), ("y", 1)]
