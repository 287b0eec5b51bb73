"""SQL text of the testbed views, for the second engine that checks our results."""

from __future__ import annotations

BASE = """base AS (
  SELECT cast(event_id AS varchar) AS id, event_id AS e, 'p' || cast(user_id % 3 AS varchar) AS project_id,
    cast(user_id AS varchar) AS user_id,
    CASE event_type WHEN 'view' THEN 'page_view' ELSE event_type END AS event_name,
    ts AS "timestamp", value, props->>'k' AS k, '/p/' || (props->>'k') AS page,
    CASE WHEN user_id % 2 = 0 THEN 'variant_a' ELSE 'control' END AS experiment,
    CASE (user_id // 3) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'android' ELSE 'ios' END AS platform,
    'N' || cast(user_id % 25 AS varchar) AS country, 'C' || cast(user_id % 100 AS varchar) AS city,
    'key_' || cast(user_id AS varchar) AS api_key
  FROM events)"""

SESSIONS = """gaps AS (
  SELECT *, CASE WHEN "timestamp" - lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", id)
    <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS is_new FROM base),
ev AS (
  SELECT *, user_id || '-' || cast(sum(is_new) OVER (PARTITION BY user_id ORDER BY "timestamp", id
    ROWS UNBOUNDED PRECEDING) AS varchar) AS session_id FROM gaps)"""

USERS = """users AS (
  SELECT cast(c_custkey AS varchar) AS id, lower(c_name || '@example.org') AS email, c_name AS first_name,
    n_name AS last_name, c_mktsegment AS segment, n_name AS nation, r_name AS region, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

COMMERCE = """commerce AS (
  SELECT 'o' || cast(o_orderkey AS varchar) AS id, cast(o_custkey AS varchar) AS user_id, 'order' AS event_name,
    o_orderdate AS "timestamp", cast(o_orderkey AS varchar) AS session_id, cast(o_orderkey AS varchar) AS order_id,
    'USD' AS currency, NULL AS product_id, CAST(NULL AS bigint) AS quantity, o_totalprice AS value FROM orders
  UNION ALL
  SELECT 'l-' || cast(l_orderkey AS varchar) || '-' || cast(l_linenumber AS varchar) || '-' || cast(l_partkey AS varchar)
    || '-' || cast(l_suppkey AS varchar), cast(o_custkey AS varchar),
    CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'ship' END, l_shipdate, cast(l_orderkey AS varchar),
    cast(l_orderkey AS varchar), NULL, cast(l_partkey AS varchar), cast(l_quantity AS bigint), l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

RAW = """raw AS (
  SELECT cast(event_id AS varchar) AS id, event_id AS e, ts,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN '' ELSE cast(user_id AS varchar) END AS user_id,
    CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 83 = 0 THEN repeat('x', 120)
      WHEN event_id % 79 = 0 THEN 'bad name!' ELSE event_type END AS event_name,
    CASE WHEN event_id % 73 = 0 THEN '{"a":{"b":1}}' WHEN event_id % 71 = 0 THEN '[1]' WHEN event_id % 70 = 0 THEN NULL
      ELSE props END AS properties,
    CASE WHEN event_id % 67 = 0 THEN 'bad' WHEN event_id % 61 = 0 THEN NULL ELSE 'good' END AS time_state,
    CASE WHEN event_id % 59 = 0 THEN 'desktop' WHEN event_id % 3 = 0 THEN NULL
      ELSE CASE (user_id // 3) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'android' ELSE 'ios' END END AS platform
  FROM events)"""

JUDGED = """judged AS (
  SELECT *, CASE
      WHEN user_id IS NULL THEN '"user_id" is required'
      WHEN user_id = '' THEN '"user_id" is not allowed to be empty'
      WHEN event_name = '' THEN '"event_name" is not allowed to be empty'
      WHEN length(event_name) > 100 THEN '"event_name" length must be less than or equal to 100 characters long'
      WHEN {strict} AND NOT regexp_full_match(event_name, '[a-zA-Z0-9_-]+') THEN 'Invalid event name format'
      WHEN properties IS NOT NULL AND json_type(properties) <> 'OBJECT' THEN '"properties" must be of type object'
      WHEN properties IS NOT NULL AND e % 73 = 0 THEN '"properties" values must be one of [string, number, boolean]'
      WHEN time_state = 'bad' THEN '"timestamp" must be in ISO 8601 date format'
      WHEN platform = 'desktop' THEN '"platform" must be one of [web, android, ios]' END AS error,
    CASE WHEN error IS NULL THEN NULL WHEN starts_with(error, 'Invalid event') THEN 'event_name'
      ELSE split_part(error, '"', 2) END AS field
  FROM raw)"""

API_KEYS = """keys AS (
  SELECT cast(c_custkey AS varchar) AS id, 'p' || cast(c_custkey % 3 AS varchar) AS project_id,
    sha256('key_' || cast(c_custkey AS varchar)) AS key_hash,
    CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '2024-01-10' + to_days(cast(c_custkey % 40 AS int)) END AS expires_at,
    c_acctbal > 0 AS is_active, cast(c_custkey % 2 = 0 AS varchar) AS may_write FROM customer)"""

PROJECTS = """projects AS (
  SELECT DISTINCT 'p' || cast(c_custkey % 3 AS varchar) AS id, 'Project p' || cast(c_custkey % 3 AS varchar) AS name
  FROM customer)"""

QUERY_LOG = """qlog AS (
  SELECT cast(conv_id AS varchar) || '-' || cast(turn AS varchar) AS id, cast(conv_id % 20 AS varchar) AS user_id,
    'p' || cast(conv_id % 3 AS varchar) AS project_id, text AS natural_language_query,
    (length(text) * 37) % 12000 AS execution_time_ms, length(text) % 500 AS result_count,
    CASE WHEN length(text) % 7 = 0 THEN 'timeout' END AS error_message,
    TIMESTAMP '2024-01-01' + to_minutes(cast(conv_id * 7 + turn AS int)) AS created_at
  FROM conversations WHERE role = 'user')"""

REPLIES = r"""parts AS (
  SELECT *, cast(conv_id AS varchar) || '-' || cast(turn AS varchar) || '-' || role AS id,
    CASE WHEN length(text) % 11 = 0 THEN 'DROP TABLE events; SELECT' ELSE 'SELECT' END || ' count(*) FROM events WHERE '
    || CASE WHEN length(text) % 5 = 0 THEN 'user_id' ELSE 'project_id' END || ' = ''p' || cast(conv_id % 3 AS varchar) || ''''
    || CASE WHEN length(text) % 2 = 0 THEN ' AND timestamp >= now() LIMIT 10'
            WHEN length(text) % 3 = 0 THEN ' AND created_at > 0' ELSE '' END AS stmt FROM conversations),
replies AS (
  SELECT id, CASE turn % 4
    WHEN 0 THEN text || chr(10) || '```sql' || chr(10) || stmt || ';' || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 1 THEN '```' || chr(10) || stmt || chr(10) || '```' || chr(10) || text
    WHEN 2 THEN stmt || ';' ELSE '  ' || text || ' ' END AS reply FROM parts),
extracted AS (
  SELECT id, reply, regexp_replace(regexp_replace(CASE
    WHEN regexp_matches(reply, '(?is)```sql\n(.*?)\n```') THEN regexp_extract(reply, '(?is)```sql\n(.*?)\n```', 1)
    WHEN regexp_matches(reply, '(?is)```\n(.*?)\n```') THEN regexp_extract(reply, '(?is)```\n(.*?)\n```', 1)
    WHEN regexp_matches(reply, '(?is)(SELECT.*)') THEN regexp_extract(reply, '(?is)(SELECT.*)', 1)
    ELSE reply END, '^\s+|\s+$', '', 'g'), ';$', '') AS sql FROM replies)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
