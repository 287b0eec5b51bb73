"""Checked queries: privacy jobs, query-log jobs, saved templates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsegrain.functions.text import normalise_question
from pulsegrain.operators import privacy, querylog, shaping
from pulsegrain.plans.catalog import check
from pulsegrain.plans.templates import run_template
from pulsegrain.plans.views import BASE, QUERY_LOG, REPLIES, SESSIONS, USERS, with_views
from pulsegrain.session import work_dir
from pulsegrain.sources import events as event_table
from pulsegrain.sources import testbed

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
IDS = "ids AS (SELECT cast(c_custkey AS varchar) AS id FROM customer WHERE c_mktsegment = 'MACHINERY')"


def _ids(spark, sf):
    return testbed.users(spark, sf).filter("segment = 'MACHINERY'").select("id")


# --- privacy --------------------------------------------------------------------------------------

@check("anonymized_events", "G-1 X-15 X-16 W-3", with_views(BASE, SESSIONS, IDS) + """
SELECT id, CASE WHEN user_id IN (SELECT id FROM ids) THEN 'anonymous_' || sha256('s' || user_id) ELSE user_id END AS user_id,
  CASE WHEN user_id IN (SELECT id FROM ids) THEN 'anonymous_' || sha256('s' || session_id) ELSE session_id END AS session_id,
  event_name FROM ev""")
def _(spark, sf):
    return privacy.anonymize_events(testbed.events(spark, sf), _ids(spark, sf), "s").select("id", "user_id", "session_id", "event_name")


@check("anonymized_users", "G-1", with_views(USERS, IDS) + """
SELECT id, CASE WHEN id IN (SELECT id FROM ids) THEN 'anonymized@example.com' ELSE email END AS email,
  CASE WHEN id IN (SELECT id FROM ids) THEN 'Anonymous' ELSE first_name END AS first_name,
  CASE WHEN id IN (SELECT id FROM ids) THEN 'User' ELSE last_name END AS last_name FROM users""")
def _(spark, sf):
    return privacy.anonymize_users(testbed.users(spark, sf), _ids(spark, sf)).select("id", "email", "first_name", "last_name")


@check("exported_users", "G-2", with_views(BASE, USERS, IDS) + """
SELECT user_id, 'event' AS kind, json_object('user_id', user_id, 'id', id, 'event_name', event_name,
  'timestamp', strftime(date_trunc('millisecond', "timestamp"), '%Y-%m-%dT%H:%M:%S.%gZ'))::varchar AS data
FROM base WHERE user_id IN (SELECT id FROM ids)
UNION ALL
SELECT id, 'profile', json_object('id', id, 'email', email, 'segment', segment)::varchar FROM users
WHERE id IN (SELECT id FROM ids)""")
def _(spark, sf):
    # The key order of the JSON is the column order.
    events = testbed.base_events(spark, sf).select("user_id", "id", "event_name", "timestamp")
    return privacy.export_user(events, testbed.users(spark, sf).select("id", "email", "segment"), _ids(spark, sf))


@check("erased_everywhere", "G-3 J-6", with_views(BASE, SESSIONS, USERS, QUERY_LOG, IDS) + """
SELECT 'events' AS name, count(*) AS rows FROM base WHERE user_id NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'users', count(*) FROM users WHERE id NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM ev WHERE user_id NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'ai_queries', count(*) FROM qlog WHERE user_id NOT IN (SELECT id FROM ids)""")
def _(spark, sf):
    from pulsegrain.operators.sessions import session_table
    left = privacy.erase({
        "events": testbed.base_events(spark, sf), "users": testbed.users(spark, sf),
        "sessions": session_table(testbed.events(spark, sf)), "ai_queries": testbed.query_log(spark, sf)}, _ids(spark, sf))
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in left.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@check("erased_events", "G-3", with_views(BASE, IDS) + "SELECT id, user_id FROM base WHERE user_id NOT IN (SELECT id FROM ids)")
def _(spark, sf):
    return privacy.erase({"events": testbed.base_events(spark, sf)}, _ids(spark, sf))["events"].select("id", "user_id")


@check("erased_from_store", "G-3 S-4", with_views(BASE, IDS) + """
SELECT id, user_id, strftime("timestamp", '%Y%m') AS event_month FROM base WHERE user_id NOT IN (SELECT id FROM ids)""")
def _(spark, sf):
    path = work_dir(spark, "stored")
    event_table.write_events(testbed.base_events(spark, sf), path)
    privacy.erase_stored(spark, path, _ids(spark, sf))
    return event_table.read_events(spark, path).select("id", "user_id", "event_month")


# Phone numbers are masked in the pieces between dates.
DATES = r"'\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b'"
MASK = rf"""WITH first AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[email]', 'g'),
  '\b[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\b', '[ip]', 'g') AS text FROM documents),
cut AS (SELECT doc_id, string_split_regex(text, {DATES}) AS pieces, regexp_extract_all(text, {DATES}) AS dates FROM first)
SELECT doc_id, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i:
  regexp_replace(pieces[i], '\+?[0-9][0-9 ().-]{{7,}}[0-9]', '[phone]', 'g') || coalesce(dates[i], '')), '') AS text FROM cut"""


@check("masked_text", "G-4", MASK)
def _(spark, sf):
    return shaping.mask_pii(testbed.table(spark, sf, "documents"), "text").select("doc_id", "text")


# --- query log ------------------------------------------------------------------------------------

@check("query_log_stats", "A-27", with_views(QUERY_LOG) + """
SELECT project_id, error_message IS NULL AS success, count(*) AS queries,
  round(quantile_cont(execution_time_ms, 0.5), 2) AS p50_ms, round(quantile_cont(execution_time_ms, 0.95), 2) AS p95_ms,
  max(execution_time_ms) AS max_ms, round(avg(result_count), 2) AS avg_rows,
  round(count(*) / sum(count(*)) OVER (PARTITION BY project_id) * 100, 2) AS share FROM qlog GROUP BY 1, 2""")
def _(spark, sf):
    return querylog.query_log_stats(testbed.query_log(spark, sf))


@check("query_latency_histogram", "A-27", with_views(QUERY_LOG) + """
SELECT error_message IS NULL AS success, le, count(*) FILTER (WHERE execution_time_ms / 1000 <= bound) AS queries
FROM qlog, (VALUES ('0.005', 0.005::double), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25),
  ('0.5', 0.5), ('1.0', 1), ('2.5', 2.5), ('5.0', 5), ('10.0', 10), ('+Inf', 1e300)) b(le, bound) GROUP BY 1, 2""")
def _(spark, sf):
    return querylog.latency_histogram(testbed.query_log(spark, sf))


@check("query_history", "A-28", with_views(QUERY_LOG) + f"""
SELECT id, natural_language_query, {TS.format('created_at')} AS created_at FROM qlog
WHERE user_id = '1' AND project_id = 'p1' ORDER BY qlog.created_at DESC, id LIMIT 20""")
def _(spark, sf):
    return querylog.query_history(testbed.query_log(spark, sf), "1", "p1").select("id", "natural_language_query", "created_at")


@check("extracted_sql", "T-1 X-20", with_views(REPLIES) + "SELECT id, sql FROM extracted")
def _(spark, sf):
    return querylog.extract_sql(testbed.model_replies(spark, sf)).select("id", "sql")


def _audit(hit: str) -> str:
    words = ", ".join(f"CASE WHEN {hit.format(w=w)} THEN 'Dangerous operation detected: {w.upper()}' END"
                      for w in ("drop", "delete", "update", "insert", "alter", "create"))
    return with_views(REPLIES, f"""audited AS (
  SELECT id, concat_ws('|', CASE WHEN NOT contains(lower(sql), 'select') THEN 'Query must be a SELECT statement' END,
    CASE WHEN NOT contains(sql, 'project_id') THEN 'Query must include project_id filter for security' END, {words}) AS errors,
  concat_ws('|', CASE WHEN NOT contains(lower(sql), 'limit') THEN 'Consider adding LIMIT clause for better performance' END,
    CASE WHEN NOT contains(lower(sql), 'timestamp >=') AND NOT contains(lower(sql), 'timestamp between')
      THEN 'Consider adding timestamp filter for better performance' END) AS warnings FROM extracted)""") + """
SELECT id, errors, warnings, errors = '' AS is_valid FROM audited"""


@check("audited_sql", "T-2 X-19", _audit("contains(lower(sql), '{w}')"))
def _(spark, sf):
    found = querylog.extract_sql(testbed.model_replies(spark, sf))
    return querylog.audit_sql(found).select("id", "errors", "warnings", "is_valid")


@check("audited_sql_strict", "T-2", _audit(r"regexp_matches(lower(sql), '\b{w}\b')"))
def _(spark, sf):
    found = querylog.extract_sql(testbed.model_replies(spark, sf))
    return querylog.audit_sql(found, strict=True).select("id", "errors", "warnings", "is_valid")


NORMAL = r"trim(regexp_replace(regexp_replace(lower(natural_language_query), '[.,;:!?]', '', 'g'), '\s+', ' ', 'g'))"


@check("common_questions", "T-4", with_views(QUERY_LOG) + f"""
SELECT question, count(*) AS asked FROM (
  SELECT {NORMAL} AS question FROM qlog UNION ALL SELECT {NORMAL} FROM qlog WHERE error_message IS NOT NULL)
GROUP BY 1 ORDER BY asked DESC, question LIMIT 20""")
def _(spark, sf):
    # Questions that failed are asked once more, with other blanks and punctuation. (Not in
    # capitals: a sharp s has no single capital letter, so it would not come back.)
    log = testbed.query_log(spark, sf)
    again = log.filter("error_message IS NOT NULL").withColumn(
        "natural_language_query", F.concat(F.lit("  "), F.regexp_replace("natural_language_query", " ", "  "), F.lit(" ?!")))
    return querylog.common_questions(log.unionByName(again), 20)


@check("normalised_questions", "T-4 X-24", with_views(QUERY_LOG) + r"""
SELECT id, trim(regexp_replace(regexp_replace(lower(natural_language_query), '[.,;:!?]', '', 'g'), '\s+', ' ', 'g')) AS question
FROM qlog""")
def _(spark, sf):
    return testbed.query_log(spark, sf).select("id", normalise_question("natural_language_query").alias("question"))


# --- saved templates ------------------------------------------------------------------------------

AS_OF = dt.datetime(2024, 1, 30)


def _template(spark, sf, name, **args):
    return run_template(spark, name, testbed.base_events(spark, sf), project_id="p0", **args)


@check("template_total_events", "T-3", with_views(BASE) + """
SELECT count(*) AS total_events FROM base WHERE project_id = 'p0'
  AND "timestamp" BETWEEN TIMESTAMP '2024-01-30' - INTERVAL 30 DAY AND TIMESTAMP '2024-01-30'""")
def _(spark, sf):
    return _template(spark, sf, "total_events", as_of=AS_OF)


@check("template_daily_active_users", "T-3", with_views(BASE) + """
SELECT cast(cast("timestamp" AS date) AS varchar) AS date, count(DISTINCT user_id) AS daily_active_users
FROM base WHERE project_id = 'p0' GROUP BY 1""")
def _(spark, sf):
    return _template(spark, sf, "daily_active_users")


@check("template_event_counts", "T-3", with_views(BASE) + """
SELECT event_name, count(*) AS event_count FROM base WHERE project_id = 'p0' GROUP BY 1""")
def _(spark, sf):
    return _template(spark, sf, "event_counts")


@check("template_page_views", "T-3", with_views(BASE) + """
SELECT page, count(*) AS page_views FROM base WHERE project_id = 'p0' AND event_name = 'page_view' GROUP BY 1""")
def _(spark, sf):
    return _template(spark, sf, "page_views")


@check("template_top_engagement", "T-3", with_views(BASE) + """
SELECT event_name, round(count(*) / count(DISTINCT user_id), 2) AS events_per_user FROM base
WHERE project_id = 'p0' GROUP BY 1 ORDER BY events_per_user DESC, event_name LIMIT 5""")
def _(spark, sf):
    return _template(spark, sf, "top_engagement")


@check("template_conversion_by_platform", "T-3", with_views(BASE) + """
SELECT platform, round(count(DISTINCT CASE WHEN event_name = 'purchase' THEN user_id END) / count(DISTINCT user_id) * 100, 2)
  AS conversion_rate FROM base WHERE project_id = 'p0' GROUP BY 1""")
def _(spark, sf):
    return _template(spark, sf, "conversion_by_platform", goal="purchase")


@check("template_inactive_users", "T-3", with_views(BASE) + f"""
SELECT user_id, {TS.format('max("timestamp")')} AS last_seen FROM base WHERE project_id = 'p0' GROUP BY 1
HAVING max("timestamp") < TIMESTAMP '2024-02-05' - INTERVAL 7 DAY""")
def _(spark, sf):
    return _template(spark, sf, "inactive_users", as_of=dt.datetime(2024, 2, 5))
