"""The driver's tables bound to the engine's data model.

Everything is derived by Spark from the given Parquet tables, so its size follows theirs.
``plans/views.py`` holds the same definitions in SQL, for the second engine.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrain.functions.periods import as_of_column
from pulsegrain.operators.sessions import sessionize
from pulsegrain.session import configure
from pulsegrain.sources.ingest import parse_events

# The given time columns carry no zone; read as UTC instants, filters on them reach the scan.
TABLES = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
SESSION_GAP = dt.timedelta(hours=12)
KEY_AS_OF = dt.datetime(2024, 1, 20)

# Fixed sample user agents, chosen by event id.
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_2) AppleWebKit/605.1 Version/17.2 Safari/605.1",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 7) AppleWebKit/537.36 Chrome/120.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Linux; Android 13; SM-X906C) AppleWebKit/537.36 Chrome/119.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def shape_events(raw: DataFrame) -> DataFrame:
    """Rows of the ``events`` table as canonical events, without session ids."""
    agents = ", ".join(f"'{a}'" for a in AGENTS)
    return raw.selectExpr(
        "string(event_id) AS id",
        "concat('p', user_id % 3) AS project_id",
        "string(user_id) AS user_id",
        "if(event_type = 'view', 'page_view', event_type) AS event_name",
        "map('k', get_json_object(props, '$.k'), 'page', concat('/p/', get_json_object(props, '$.k')), "
        "'load_time', string(value), 'experiment', if(user_id % 2 = 0, 'variant_a', 'control')) AS properties",
        "ts AS timestamp",
        "value",
        "CASE (user_id div 3) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'android' ELSE 'ios' END AS platform",
        f"element_at(array({agents}), int(event_id % {len(AGENTS)} + 1)) AS user_agent",
        "concat('N', user_id % 25) AS country",
        "concat('C', user_id % 100) AS city",
        "concat('key_', user_id) AS api_key")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with sessions, split at idle gaps of 12 hours."""
    return sessionize(base_events(spark, sf_dir), SESSION_GAP)


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    return as_of_column(base_events(spark, sf_dir), None)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    geo = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        _text("c_custkey").alias("id"), F.lower(F.concat(F.col("c_name"), F.lit("@example.org"))).alias("email"),
        F.col("c_name").alias("first_name"), F.col("n_name").alias("last_name"),
        F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        F.col("c_acctbal").alias("balance"))


def commerce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, and one ship or return event per line item, over several years."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    placed = orders.selectExpr(
        "concat('o', o_orderkey) AS id", "string(o_custkey) AS user_id", "'order' AS event_name",
        "o_orderdate AS timestamp", "string(o_orderkey) AS session_id",
        "map('order_id', string(o_orderkey), 'currency', 'USD', 'total', string(o_totalprice)) AS properties")
    moved = items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "concat_ws('-', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id", "string(o_custkey) AS user_id",
        "if(l_returnflag = 'R', 'return', 'ship') AS event_name", "l_shipdate AS timestamp",
        "string(l_orderkey) AS session_id",
        "map('order_id', string(l_orderkey), 'product_id', string(l_partkey), "
        "'quantity', string(bigint(l_quantity)), 'price', string(l_extendedprice)) AS properties")
    return placed.unionByName(moved).withColumn("project_id", F.lit("shop"))


def raw_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clients would send them, every kind of fault mixed in by event id."""
    return table(spark, sf_dir, "events").selectExpr(
        "string(event_id) AS id",
        "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN '' ELSE string(user_id) END AS user_id",
        "CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 83 = 0 THEN repeat('x', 120) "
        "WHEN event_id % 79 = 0 THEN 'bad name!' ELSE event_type END AS event_name",
        """CASE WHEN event_id % 73 = 0 THEN '{"a":{"b":1}}' WHEN event_id % 71 = 0 THEN '[1]' """
        "WHEN event_id % 70 = 0 THEN NULL ELSE props END AS properties",
        "CASE WHEN event_id % 67 = 0 THEN 'not a time' WHEN event_id % 61 = 0 THEN NULL "
        "WHEN event_id % 2 = 0 THEN string(unix_millis(ts)) "
        """ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") END AS timestamp""",
        "CASE WHEN event_id % 59 = 0 THEN 'desktop' WHEN event_id % 3 = 0 THEN NULL "
        "WHEN (user_id div 3) % 3 = 0 THEN 'web' WHEN (user_id div 3) % 3 = 1 THEN 'android' ELSE 'ios' END AS platform")


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON text: columns ``id`` and ``value``. Properties are JSON already."""
    return raw_columns(spark, sf_dir).selectExpr(
        "id", """concat(rtrim('}', to_json(struct(user_id, event_name, timestamp, platform))),
                        coalesce(concat(',"properties":', properties), ''), '}') AS value""")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_events(raw_json(spark, sf_dir))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch envelopes of 20 raw events; every fifth run of 200 events is sent as one, too large."""
    e = F.col("id").cast("bigint")
    run = F.floor(e / 200)
    batch = F.when(run % 5 == 0, F.concat(F.lit("big-"), _text(run))).otherwise(
        F.concat(F.lit("b-"), _text(F.floor(e / 20))))
    return (raw_json(spark, sf_dir).withColumn("batch_id", batch).groupBy("batch_id")
            .agg(F.concat(F.lit('{"events":['), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(
                F.struct(e.alias("e"), F.col("value").alias("v")))), lambda x: x["v"])), F.lit("]}")).alias("value")))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with repeated deliveries under new ids: every third once more, every ninth twice more."""
    rows = events(spark, sf_dir)
    e = F.col("id").cast("bigint")
    copies = F.when(e % 9 == 0, 3).when(e % 3 == 0, 2).otherwise(1)
    return (rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
            .withColumn("id", F.concat_ws("#", "id", _text("_copy")))
            # The second copy lists its properties in another order.
            .withColumn("properties", F.when(F.col("_copy") == 2, F.map_from_entries(
                F.reverse(F.map_entries("properties")))).otherwise(F.col("properties")))
            .drop("_copy"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _text(key).alias("id"), F.concat(F.lit("p"), _text(key % 3)).alias("project_id"),
        F.sha2(F.concat(F.lit("key_"), _text(key)), 256).alias("key_hash"),
        F.when(key % 11 != 0, F.lit(dt.datetime(2024, 1, 10)) + F.make_dt_interval((key % 40).cast("int"))).alias("expires_at"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.create_map(F.lit("read"), F.lit("true"), F.lit("write"), _text(key % 2 == 0)).alias("permissions"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), _text(F.col("c_custkey") % 3)).alias("id")).distinct()
    return ids.withColumn("name", F.concat(F.lit("Project "), F.col("id")))


def dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        _text("s_suppkey").alias("id"), F.concat(F.lit("p"), _text(F.col("s_suppkey") % 3)).alias("project_id"),
        F.col("s_name").alias("name"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations as logged questions."""
    size = F.length("text")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", _text("conv_id"), _text("turn")).alias("id"),
        _text(F.col("conv_id") % 20).alias("user_id"),
        F.concat(F.lit("p"), _text(F.col("conv_id") % 3)).alias("project_id"),
        F.col("text").alias("natural_language_query"),
        ((size * 37) % 12000).cast("bigint").alias("execution_time_ms"), (size % 500).cast("bigint").alias("result_count"),
        F.when(size % 7 == 0, "timeout").alias("error_message"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(mins=(F.col("conv_id") * 7 + F.col("turn")).cast("int"))).alias("created_at"))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model replies holding SQL in every form a model may answer in."""
    n = F.length("text")
    tail = F.when(n % 2 == 0, " AND timestamp >= now() LIMIT 10").when(n % 3 == 0, " AND created_at > 0").otherwise("")
    scope = F.when(n % 5 == 0, F.lit("user_id")).otherwise(F.lit("project_id"))
    verb = F.when(n % 11 == 0, F.lit("DROP TABLE events; SELECT")).otherwise(F.lit("SELECT"))
    sql = F.concat(verb, F.lit(" count(*) FROM events WHERE "), scope, F.lit(" = 'p"), _text(F.col("conv_id") % 3), F.lit("'"), tail)
    intro = F.col("text")
    form = F.col("turn") % 4
    reply = (F.when(form == 0, F.concat(intro, F.lit("\n```sql\n"), sql, F.lit(";\n```\nDone.")))
             .when(form == 1, F.concat(F.lit("```\n"), sql, F.lit("\n```\n"), intro))
             .when(form == 2, F.concat(sql, F.lit(";")))
             .otherwise(F.concat(F.lit("  "), intro, F.lit(" "))))
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", _text("conv_id"), _text("turn"), "role").alias("id"), reply.alias("reply"))
