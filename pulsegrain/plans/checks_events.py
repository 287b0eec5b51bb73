"""Checked queries: sources, validation, shaping, filters, joins, paging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsegrain.functions.props import prop, prop_num
from pulsegrain.operators import dedupe, filters, joins, paging, sessions, shaping, validation
from pulsegrain.operators.metrics import top_pages
from pulsegrain.plans.catalog import check
from pulsegrain.plans.views import (
    API_KEYS, BASE, COMMERCE, JUDGED, PROJECTS, QUERY_LOG, RAW, SESSIONS, USERS, with_views)
from pulsegrain.session import work_dir
from pulsegrain.sources import dimensions, ingest, testbed
from pulsegrain.sources import events as event_table

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
T = TS.format('"timestamp"')
LENIENT, STRICT = JUDGED.format(strict="FALSE"), JUDGED.format(strict="TRUE")


# --- sources and sinks ---------------------------------------------------------------------

@check("event_table_scan", "S-1 S-4", with_views(BASE) + f"""
SELECT id, user_id, event_name, {T} AS "timestamp", strftime("timestamp", '%Y%m') AS event_month, page
FROM base WHERE strftime("timestamp", '%Y%m') = '202401'""")
def _(spark, sf):
    path = work_dir(spark, "events")
    event_table.write_events(testbed.base_events(spark, sf), path)
    return event_table.read_events(spark, path, ["202401"]).select(
        "id", "user_id", "event_name", "timestamp", "event_month", prop("page").alias("page"))


@check("ingest_json_lines", "S-2 V-1 V-3 P-1", with_views(RAW, LENIENT) + """
SELECT user_id, event_name, platform, count(*) AS events,
  min(CASE WHEN time_state = 'good' THEN strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f')
      ELSE '2024-03-01 00:00:00.000000' END) AS first_time
FROM (SELECT user_id, event_name, coalesce(platform, 'web') AS platform, time_state, ts FROM judged WHERE error IS NULL)
GROUP BY ALL""")
def _(spark, sf):
    source, sink = work_dir(spark, "raw"), work_dir(spark, "ingested")
    testbed.raw_json(spark, sf).select("value").write.text(source)
    for _run in range(2):  # the second run finds nothing new
        ingest.ingest(spark, source, {"project_id": "p0", "ip": "10.0.0.1", "user_agent": "check"}, sink,
                      as_of=dt.datetime(2024, 3, 1))
    return event_table.read_events(spark, sink).groupBy("user_id", "event_name", "platform").agg(
        F.count("*").alias("events"), F.min("timestamp").alias("first_time"))


@check("batch_envelopes", "S-3", with_views(RAW) + """
SELECT 'b-' || cast(e // 20 AS varchar) AS batch_id, count(*) AS events, count(user_id) AS with_user,
  cast(sum(e % 20) AS bigint) AS positions
FROM raw WHERE (e // 200) % 5 <> 0 GROUP BY 1""")
def _(spark, sf):
    rows, _rejected = ingest.explode_batches(testbed.envelopes(spark, sf))
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("events"), F.count("user_id").alias("with_user"), F.sum("position").alias("positions"))


@check("batch_envelopes_rejected", "S-3", with_views(RAW) + """
SELECT 'big-' || cast(e // 200 AS varchar) AS batch_id,
  '"events" must contain less than or equal to 100 items' AS error
FROM raw WHERE (e // 200) % 5 = 0 GROUP BY 1 HAVING count(*) > 100
""")
def _(spark, sf):
    _rows, rejected = ingest.explode_batches(testbed.envelopes(spark, sf))
    return rejected.select("batch_id", "error")


@check("json_rows", "S-5", """
SELECT json_object('event_id', event_id, 'ts', strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ'), 'user_id', user_id,
  'event_type', event_type, 'value', value, 'props', props)::varchar AS value
FROM events""")
def _(spark, sf):
    return event_table.to_json_rows(testbed.table(spark, sf, "events"))


@check("dimension_scan", "S-6", with_views(USERS) + """
SELECT id, email, first_name, last_name FROM users""")
def _(spark, sf):
    path = work_dir(spark, "users")
    testbed.users(spark, sf).write.parquet(path)
    return dimensions.read_dim(spark, "users", path).select("id", "email", "first_name", "last_name")


@check("insert_if_absent", "S-7", """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'new' ELSE 'stored' END AS origin FROM customer""")
def _(spark, sf):
    # All customers arrive twice; those of one segment are not stored yet.
    customers = testbed.table(spark, sf, "customer")
    rows = customers.select("c_custkey", "c_name")
    stored = customers.filter("c_mktsegment <> 'MACHINERY'").select(
        "c_custkey", "c_name", F.lit("stored").alias("origin"))
    new = rows.unionByName(rows).withColumn("origin", F.lit("new"))
    return dimensions.insert_absent(stored, new, "c_custkey")


@check("key_lookup", "S-8", """
SELECT c_custkey, c_name, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def _(spark, sf):
    nation = testbed.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return dimensions.resolve_fk(testbed.table(spark, sf, "customer"), nation, "c_nationkey", "n_name", "nation").select(
        "c_custkey", "c_name", "nation")


# --- validation and repeated rows ----------------------------------------------------------

@check("validation_verdicts", "V-1", with_views(RAW, LENIENT) + "SELECT id, field, error FROM judged")
def _(spark, sf):
    return validation.judge_events(testbed.raw_events(spark, sf)).select("id", "field", "error")


@check("validated_events", "V-1", with_views(RAW, LENIENT) + """
SELECT id, user_id, event_name, properties->>'k' AS k,
  CASE WHEN time_state = 'good' THEN strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') END AS "timestamp"
FROM judged WHERE error IS NULL""")
def _(spark, sf):
    valid, _rejected = validation.validate_events(testbed.raw_events(spark, sf))
    return valid.select("id", "user_id", "event_name", F.col("properties")["k"].alias("k"), "timestamp")


@check("validation_strict", "V-2", with_views(RAW, STRICT) + "SELECT id, field, error FROM judged WHERE error IS NOT NULL")
def _(spark, sf):
    _valid, rejected = validation.validate_events(testbed.raw_events(spark, sf), strict=True)
    return rejected.select("id", "field", "error")


@check("validation_defaults", "V-3", with_views(RAW, LENIENT) + """
SELECT id, coalesce(platform, 'web') AS platform, coalesce(json_array_length(json_keys(properties)), 0)::bigint AS n_props,
  CASE WHEN time_state = 'good' THEN strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f')
       ELSE '2024-03-01 00:00:00.000000' END AS "timestamp"
FROM (SELECT * FROM judged WHERE error IS NULL)""")
def _(spark, sf):
    valid, _rejected = validation.validate_events(testbed.raw_events(spark, sf))
    return validation.apply_defaults(valid, dt.datetime(2024, 3, 1)).select(
        "id", "platform", F.size("properties").alias("n_props"), "timestamp")


@check("validation_summary", "V-4", with_views(RAW, LENIENT) + """
SELECT coalesce(field, '') AS field, coalesce(error, '') AS error, count(*) AS events,
  round(count(*) / (SELECT count(*) FROM judged), 4) AS share FROM judged GROUP BY 1, 2""")
def _(spark, sf):
    return validation.validation_summary(testbed.raw_events(spark, sf))


@check("dedupe_deliveries", "D-1", with_views(BASE, SESSIONS) + f"""
SELECT min(id) || '#1' AS id, user_id, session_id, event_name, {T} AS "timestamp"
FROM ev GROUP BY user_id, session_id, event_name, "timestamp", k, page, value, experiment""")
def _(spark, sf):
    return dedupe.dedupe_events(testbed.deliveries(spark, sf)).select(
        "id", "user_id", "session_id", "event_name", "timestamp")


@check("latest_per_user_event", "D-2", with_views(BASE) + f"""
SELECT user_id, event_name, id, {T} AS "timestamp", page FROM base
QUALIFY row_number() OVER (PARTITION BY user_id, event_name ORDER BY "timestamp" DESC, id DESC) = 1""")
def _(spark, sf):
    rows = testbed.base_events(spark, sf).select("user_id", "event_name", "id", "timestamp", prop("page").alias("page"))
    return dedupe.latest_per_key(rows, ["user_id", "event_name"], ["timestamp", "id"])


# --- shaping ---------------------------------------------------------------------------------

@check("enriched_events", "P-1 X-9", with_views(BASE) + """
SELECT id, project_id, '10.1.1.' || cast(e % 250 AS varchar) AS ip, 'sdk/1' AS user_agent,
  strftime(date_trunc('millisecond', "timestamp"), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso_time FROM base""")
def _(spark, sf):
    from pulsegrain.functions.periods import iso_text
    ip = F.concat(F.lit("10.1.1."), (F.col("id").cast("bigint") % 250).cast("string"))
    rows = testbed.base_events(spark, sf).drop("user_agent")
    return shaping.enrich(rows, {"ip": ip, "user_agent": "sdk/1"}).select(
        "id", "project_id", "ip", "user_agent", iso_text("timestamp").alias("iso_time"))


@check("merged_properties", "P-2", with_views(BASE) + """
SELECT id, 'k=' || k || ';language=en;load_time=' || CASE WHEN e % 2 = 0 THEN 'x' ELSE 'own' END AS merged FROM base""")
def _(spark, sf):
    defaults = F.create_map(F.lit("language"), F.lit("en"), F.lit("load_time"), F.lit("x"), F.lit("k"), F.lit("default"))
    own = F.when(F.col("id").cast("bigint") % 2 == 0, F.create_map(F.lit("k"), prop("k"))).otherwise(
        F.create_map(F.lit("k"), prop("k"), F.lit("load_time"), F.lit("own")))
    rows = testbed.base_events(spark, sf).withColumn("properties", own)
    pairs = F.array_sort(F.map_entries("properties"))
    return shaping.merge_props(rows, defaults).select("id", F.array_join(
        F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@check("property_reads", "P-3 P-4 F-4", with_views(BASE) + """
SELECT id, '' AS missing, page, value AS load_time, try_cast(page AS double) AS page_number FROM base WHERE page <> ''""")
def _(spark, sf):
    return filters.has_prop(testbed.base_events(spark, sf), "page").select(
        "id", prop("nothing").alias("missing"), prop("page").alias("page"), prop_num("load_time").alias("load_time"),
        prop_num("page").alias("page_number"))


ANON = """anon AS (SELECT * REPLACE (CASE WHEN e % 4 = 0 THEN NULL WHEN e % 7 = 0 THEN '' ELSE user_id END AS user_id) FROM ev)"""


def _anonymous(spark, sf):
    e = F.col("id").cast("bigint")
    return testbed.events(spark, sf).withColumn(
        "user_id", F.when(e % 4 == 0, None).when(e % 7 == 0, "").otherwise(F.col("user_id")))


@check("anonymous_fallback", "P-5", with_views(BASE, SESSIONS, ANON) + """
SELECT id, coalesce(nullif(user_id, ''), 'anonymous_' || session_id) AS user_id FROM anon""")
def _(spark, sf):
    return _anonymous(spark, sf).select("id", shaping.effective_user_id().alias("user_id"))


def _param(key: str) -> str:
    return f"regexp_extract(split_part(url, '#', 1), '[?&]{key}=([^&]*)', 1) AS {key}"


@check("campaign_fields", "P-6", f"""
SELECT page_id, {', '.join(_param(k) for k in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term'))},
  regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS referrer_host FROM pages""")
def _(spark, sf):
    return shaping.with_utm(testbed.table(spark, sf, "pages"), "url", "url").select(
        "page_id", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "referrer_host")


@check("device_fields", "P-7", """
WITH a AS (SELECT event_id % 7 AS n FROM events)
SELECT CASE WHEN n = 2 OR n = 3 THEN 'mobile' WHEN n = 4 THEN 'tablet' ELSE 'desktop' END AS device_type,
  ['Chrome', 'Safari', 'Safari', 'Chrome', 'Chrome', 'Firefox', 'Edge'][n + 1] AS browser,
  ['Windows', 'macOS', 'iOS', 'Android', 'Android', 'Linux', 'Windows'][n + 1] AS os, count(*) AS events
FROM a GROUP BY ALL""")
def _(spark, sf):
    return shaping.with_device(testbed.base_events(spark, sf)).groupBy("device_type", "browser", "os").agg(
        F.count("*").alias("events"))


@check("scroll_milestones", "P-8", with_views(BASE, SESSIONS) + f"""
SELECT session_id, page, m AS depth_percent, {TS.format('min("timestamp")')} AS "timestamp"
FROM ev, (SELECT unnest([25, 50, 75, 100])::bigint AS m) WHERE least(floor(value + 0.5), 100) >= m GROUP BY session_id, page, m""")
def _(spark, sf):
    rows = testbed.events(spark, sf).withColumn("page", prop("page"))
    return shaping.scroll_milestones(rows, "value")


@check("stitched_identity", "P-9", with_views(BASE, SESSIONS, ANON, """known AS (
  SELECT session_id, arg_min(user_id, ("timestamp", user_id)) AS known_id FROM anon
  WHERE user_id IS NOT NULL AND user_id <> '' GROUP BY session_id)""") + """
SELECT id, CASE WHEN coalesce(user_id, '') = '' THEN coalesce(known_id, 'anonymous_' || session_id)
  ELSE user_id END AS stitched_user_id
FROM anon LEFT JOIN known USING (session_id)""")
def _(spark, sf):
    return shaping.stitch_identity(_anonymous(spark, sf)).select("id", "stitched_user_id")


@check("active_time", "P-10", with_views(BASE, """spans AS (
  SELECT user_id, event_name IN ('page_view', 'click') AS visible, "timestamp",
    lead("timestamp") OVER (PARTITION BY user_id, project_id ORDER BY "timestamp", id) AS until_ts, project_id FROM base)""") + """
SELECT * FROM (SELECT user_id AS session_id, project_id AS page,
  cast(round(coalesce(sum(CASE WHEN visible THEN epoch_us(until_ts) - epoch_us("timestamp") END), 0) / 1e6) AS bigint) AS active_seconds
FROM spans GROUP BY ALL) WHERE active_seconds > 5""")
def _(spark, sf):
    rows = testbed.base_events(spark, sf).select(
        "id", F.col("user_id").alias("session_id"), F.col("project_id").alias("page"), "timestamp",
        F.col("event_name").isin("page_view", "click").alias("visible"))
    return shaping.active_time(rows)


@check("sanitized_text", "P-11 X-20", """
SELECT doc_id, regexp_replace(text, '[<>''"&]', '', 'g') AS text FROM documents""")
def _(spark, sf):
    return shaping.sanitize(testbed.table(spark, sf, "documents"), "text").select("doc_id", "text")


@check("typed_commerce_events", "P-12", with_views(COMMERCE) + """
SELECT id, event_name, order_id, product_id, currency, quantity, value FROM commerce""")
def _(spark, sf):
    return shaping.typed_props(testbed.commerce_events(spark, sf), shaping.COMMERCE_SPEC).select(
        "id", "event_name", "order_id", "product_id", "currency", "quantity", "value")


# --- filters -----------------------------------------------------------------------------------

@check("project_scope", "F-1", with_views(BASE) + "SELECT id, event_name FROM base WHERE project_id = 'p1'")
def _(spark, sf):
    return filters.for_project(testbed.base_events(spark, sf), "p1").select("id", "event_name")


@check("date_range_week", "F-2 X-6", with_views(BASE) + f"""
SELECT id, {T} AS "timestamp" FROM base
WHERE "timestamp" BETWEEN (SELECT max("timestamp") FROM base) - INTERVAL 7 DAY AND (SELECT max("timestamp") FROM base)""")
def _(spark, sf):
    return filters.in_range(testbed.base_events(spark, sf), "7d").select("id", "timestamp")


@check("date_range_stored", "F-2 F-7 S-4", with_views(BASE) + f"""
SELECT id, {T} AS "timestamp" FROM base
WHERE "timestamp" BETWEEN (SELECT max("timestamp") FROM base) - INTERVAL 7 DAY AND (SELECT max("timestamp") FROM base)""")
def _(spark, sf):
    """On the stored table, where the newest instant comes from the newest month alone."""
    path = work_dir(spark, "events")
    event_table.write_events(testbed.base_events(spark, sf), path)
    stored = event_table.read_events(spark, path)
    return filters.in_range(stored, "7d", event_table.newest_instant(spark, path)).select("id", "timestamp")


@check("named_events", "F-3", with_views(BASE) + "SELECT id FROM base WHERE event_name IN ('click', 'signup')")
def _(spark, sf):
    return filters.named(testbed.base_events(spark, sf), "click", "signup").select("id")


@check("filter_map", "F-5", with_views(BASE) + """
SELECT id FROM base WHERE platform = 'web' AND experiment = 'control'""")
def _(spark, sf):
    return filters.apply_filters(testbed.base_events(spark, sf), {"platform": "web", "experiment": "control"}).select("id")


@check("segment_events", "F-6", with_views(BASE, USERS) + """
SELECT id, user_id FROM base WHERE user_id IN (SELECT id FROM users WHERE segment = 'MACHINERY' AND region = 'ASIA')""")
def _(spark, sf):
    return filters.in_segment(testbed.base_events(spark, sf), testbed.users(spark, sf),
                              (F.col("segment") == "MACHINERY") & (F.col("region") == "ASIA")).select("id", "user_id")


@check("trailing_hours", "F-7", with_views(BASE) + """
SELECT id FROM base WHERE "timestamp" >= (SELECT max("timestamp") FROM base) - INTERVAL 36 HOUR""")
def _(spark, sf):
    return filters.trailing(testbed.base_events(spark, sf), dt.timedelta(hours=36)).select("id")


@check("active_keys", "F-8", with_views(API_KEYS) + """
SELECT id FROM keys WHERE is_active AND expires_at > TIMESTAMP '2024-01-20'""")
def _(spark, sf):
    return filters.active_rows(testbed.api_keys(spark, sf), testbed.KEY_AS_OF).select("id")


# --- joins -------------------------------------------------------------------------------------

@check("key_to_project", "J-1 X-17", with_views(BASE, API_KEYS, PROJECTS) + """
SELECT base.id, keys.project_id, projects.name AS project_name, may_write FROM base
JOIN keys ON sha256(api_key) = key_hash AND is_active AND expires_at > TIMESTAMP '2024-01-20'
JOIN projects ON projects.id = keys.project_id""")
def _(spark, sf):
    return joins.resolve_project(testbed.base_events(spark, sf), testbed.api_keys(spark, sf),
                                 testbed.projects(spark, sf), testbed.KEY_AS_OF).select(
        "id", "project_id", "project_name", F.col("permissions")["write"].alias("may_write"))


@check("events_with_user", "J-3", with_views(BASE, USERS) + """
SELECT base.id, user_id, segment AS user_segment, region AS user_region FROM base LEFT JOIN users ON users.id = user_id""")
def _(spark, sf):
    return joins.with_user(testbed.base_events(spark, sf), testbed.users(spark, sf)).select(
        "id", "user_id", "user_segment", "user_region")


@check("sessions_with_user", "J-4", with_views(BASE, SESSIONS, USERS) + f"""
SELECT session_id, {TS.format('min("timestamp")')} AS session_start, count(*) AS events_count,
  any_value(segment) AS user_segment FROM ev JOIN users ON users.id = user_id GROUP BY session_id""")
def _(spark, sf):
    table = sessions.session_table(testbed.events(spark, sf))
    return joins.sessions_with_user(table, testbed.users(spark, sf)).select(
        "session_id", "session_start", "events_count", "user_segment")


@check("project_activity", "J-5", with_views(API_KEYS, PROJECTS, QUERY_LOG) + f"""
SELECT id AS project_id, name,
  (SELECT count(*) FROM keys k WHERE k.project_id = p.id) AS api_keys,
  (SELECT count(*) FROM keys k WHERE k.project_id = p.id AND is_active) AS active_keys,
  (SELECT count(*) FROM supplier WHERE 'p' || cast(s_suppkey % 3 AS varchar) = p.id) AS dashboards,
  (SELECT count(*) FROM qlog q WHERE q.project_id = p.id) AS queries,
  (SELECT {TS.format('max(created_at)')} FROM qlog q WHERE q.project_id = p.id) AS last_query_at
FROM projects p""")
def _(spark, sf):
    return joins.project_activity(testbed.projects(spark, sf), testbed.api_keys(spark, sf),
                                  testbed.dashboards(spark, sf), testbed.query_log(spark, sf))


# --- sorted slices -------------------------------------------------------------------------------

@check("recent_events", "L-1", with_views(BASE) + f"""
SELECT id, event_name, {T} AS "timestamp" FROM base WHERE project_id = 'p0' ORDER BY base."timestamp" DESC, id LIMIT 100""")
def _(spark, sf):
    return paging.recent_events(testbed.base_events(spark, sf), "p0", paging.MAX_RECENT).select("id", "event_name", "timestamp")


@check("top_users", "L-2", with_views(BASE) + """
SELECT user_id, count(*) AS events FROM base GROUP BY user_id ORDER BY events DESC, user_id LIMIT 25""")
def _(spark, sf):
    return paging.top_n(testbed.base_events(spark, sf).groupBy("user_id").agg(F.count("*").alias("events")),
                        "events", 25, "user_id")


@check("page_list_second", "L-3", with_views(BASE, SESSIONS) + """
SELECT page, count(*) AS page_views, count(DISTINCT user_id) AS unique_visitors, count(DISTINCT session_id) AS sessions,
  round(avg(value), 2) AS avg_load_time, count(*) OVER () > 40 AS has_more
FROM ev WHERE event_name = 'page_view' AND project_id = 'p0' GROUP BY page
ORDER BY page_views DESC, page LIMIT 20 OFFSET 20""")
def _(spark, sf):
    return top_pages(testbed.events(spark, sf), "p0", "30d", testbed.as_of(spark, sf), page=2)


@check("page_after_cursor", "L-3", with_views(BASE) + f"""
SELECT id, user_id, {T} AS "timestamp", count(*) OVER () > 90 AS has_more FROM base ORDER BY base."timestamp" DESC, id LIMIT 30 OFFSET 60""")
def _(spark, sf):
    """The third page of the stored table: each cursor is read off the last row of the page before."""
    path, order, cursor = work_dir(spark, "events"), ["-timestamp", "id"], None
    event_table.write_events(testbed.base_events(spark, sf), path)
    stored = event_table.read_events(spark, path)
    for _page in range(2):
        page = paging.page_after(stored.select("timestamp", "id", "event_month"), order, cursor, 30)
        cursor = page.orderBy("timestamp", F.col("id").desc()).select("cursor").first()[0]
    return paging.page_after(stored, order, cursor, 30).select("id", "user_id", "timestamp", "has_more")


@check("capped_rows", "L-4", with_views(BASE) + "SELECT id, user_id FROM base ORDER BY e LIMIT 500")
def _(spark, sf):
    return paging.cap(testbed.base_events(spark, sf), 500, [F.col("id").cast("bigint")]).select("id", "user_id")


@check("recent_per_project", "W-1", with_views(BASE) + f"""
SELECT project_id, id, {T} AS "timestamp" FROM base
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY base."timestamp" DESC, id) <= 100""")
def _(spark, sf):
    return paging.recent_per_project(testbed.base_events(spark, sf)).select("project_id", "id", "timestamp")
