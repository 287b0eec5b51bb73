"""Jobs over the log of questions and the SQL that answered them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrain.functions import text
from pulsegrain.functions.numbers import percent, rounded
from pulsegrain.operators.paging import top_n

# Upper bounds of the latency histogram, in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
LATENCY_K = 200  # size of the quantile sketch
MAX_HISTORY = 100
DEFAULT_HISTORY = 20


def extract_sql(df: DataFrame, col: str = "reply", alias: str = "sql") -> DataFrame:
    """Add the SQL found in a logged reply."""
    return df.withColumn(alias, text.extract_sql(col))


def audit_sql(df: DataFrame, col: str = "sql", strict: bool = False) -> DataFrame:
    """Add ``errors``, ``warnings`` (arrays of messages) and ``is_valid`` for logged SQL text."""
    out = df.withColumns({"errors": text.sql_errors(col, strict), "warnings": text.sql_warnings(col)})
    return out.withColumn("is_valid", F.size("errors") == 0)


def common_questions(log: DataFrame, n: int = 10, col: str = "natural_language_query") -> DataFrame:
    """The most asked questions, after normalising case, punctuation and blanks; definition ours."""
    asked = log.filter(F.col(col).isNotNull()).groupBy(text.normalise_question(col).alias("question")).agg(
        F.count("*").alias("asked"))
    return top_n(asked, "asked", n, "question")


def _with_share(grouped: DataFrame) -> DataFrame:
    """The share of a project's queries; the window holds two rows a project."""
    total = F.sum("queries").over(Window.partitionBy("project_id"))
    return grouped.withColumn("share", percent(F.col("queries"), total))


def query_log_stats(log: DataFrame, exact: bool = True) -> DataFrame:
    """Per project and success: queries, latency percentiles, mean result rows, share of queries.

    ``exact=False`` uses approximate percentiles, for logs with very many distinct times.
    """
    pick = F.percentile if exact else F.percentile_approx
    return _with_share(log.groupBy("project_id", F.col("error_message").isNull().alias("success")).agg(
        F.count("*").alias("queries"),
        rounded(pick("execution_time_ms", F.lit(0.5)), 2).alias("p50_ms"),
        rounded(pick("execution_time_ms", F.lit(0.95)), 2).alias("p95_ms"),
        F.max("execution_time_ms").alias("max_ms"), rounded(F.avg("result_count"), 2).alias("avg_rows")))


def latency_partial(log: DataFrame, k: int = LATENCY_K) -> DataFrame:
    """Mergeable rows by project, success and day: counts, sums, and the durations as a quantile sketch. One scan."""
    success, ms = F.col("error_message").isNull(), F.col("execution_time_ms").cast("bigint")
    return log.groupBy("project_id", success.alias("success"), F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("queries"), F.max(ms).alias("max_ms"), F.sum(F.col("result_count").cast("bigint")).alias("rows"),
        F.count("result_count").alias("with_rows"), F.kll_sketch_agg_bigint(ms, k).alias("latency"))


def latency_from_partials(partials: DataFrame) -> DataFrame:
    """The columns of ``query_log_stats`` from ``latency_partial`` rows of any days, without reading the log again.

    The percentiles are durations that occurred, whose rank is off by at most about 1.65 percent (with ``LATENCY_K``).
    Groups in which no query has a duration have NULL.
    """
    merged = partials.groupBy("project_id", "success").agg(
        F.sum("queries").alias("queries"), F.max("max_ms").alias("max_ms"), F.try_divide(F.sum("rows"), F.sum("with_rows")).alias("avg_rows"),
        F.kll_merge_agg_bigint("latency").alias("latency"))
    known = F.kll_sketch_get_n_bigint("latency") > 0
    at = F.kll_sketch_get_quantile_bigint("latency", F.array(F.lit(0.5), F.lit(0.95)))
    merged = merged.withColumn("at", F.when(known, at))
    return _with_share(merged.select("project_id", "success", "queries", F.col("at")[0].alias("p50_ms"), F.col("at")[1].alias("p95_ms"),
                                     "max_ms", rounded(F.col("avg_rows"), 2).alias("avg_rows")))


def latency_histogram(log: DataFrame) -> DataFrame:
    """Cumulative counts of query durations by upper bound in seconds and success.

    Each query falls in one bucket before the aggregation; counts are made cumulative afterwards,
    on one row per success with one column per bucket.
    """
    seconds = F.col("execution_time_ms") / 1000
    bounds = [*LATENCY_BUCKETS, float("inf")]
    counts = log.filter(F.col("execution_time_ms").isNotNull()).groupBy(
        F.col("error_message").isNull().alias("success")).agg(
        *[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    labels = [str(b) if b != float("inf") else "+Inf" for b in bounds]
    return counts.select("success", F.inline(F.array(*[
        F.struct(F.lit(label).alias("le"), F.col(f"b{i}").alias("queries")) for i, label in enumerate(labels)])))


def query_history(log: DataFrame, user_id: str, project_id: str, limit: int = DEFAULT_HISTORY) -> DataFrame:
    """A user's newest questions in a project; a limit above 100 is an error."""
    n = limit or DEFAULT_HISTORY
    if n > MAX_HISTORY:
        raise ValueError(f"limit must be at most {MAX_HISTORY}")
    rows = log.filter((F.col("user_id") == user_id) & (F.col("project_id") == project_id))
    return rows.orderBy(F.col("created_at").desc(), "id").limit(n)
