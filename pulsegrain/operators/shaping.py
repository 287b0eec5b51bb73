"""Row shaping: enrichment, derived fields, and behaviour derived from raw interaction rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrain.functions import web
from pulsegrain.functions.periods import time_bucket
from pulsegrain.functions.props import merge_maps
from pulsegrain.functions.text import PII_RULES, mask_rule, sanitize_text
from pulsegrain.operators.dedupe import one_per_key

# Fixed values.
SCROLL_POINTS = (25, 50, 75, 100)
MIN_ACTIVE_SECONDS = 5
ANONYMOUS_PREFIX = "anonymous_"

# Typed columns of the documented commerce and SaaS events: output name -> (property keys, type).
COMMERCE_SPEC: dict[str, tuple[Sequence[str], str]] = {
    "order_id": (("order_id",), "string"),
    "product_id": (("product_id",), "string"),
    "currency": (("currency",), "string"),
    "quantity": (("quantity",), "bigint"),
    "value": (("value", "total", "price"), "double"),
}
SAAS_SPEC: dict[str, tuple[Sequence[str], str]] = {
    "feature_name": (("feature_name",), "string"),
    "plan": (("plan", "to_plan"), "string"),
    "from_plan": (("from_plan",), "string"),
    "billing_cycle": (("billing_cycle",), "string"),
    "usage_count": (("usage_count",), "bigint"),
}


def enrich(df: DataFrame, context: Mapping[str, Column | str]) -> DataFrame:
    """Add request context (project_id, ip, user_agent, ...) and cut time to milliseconds,
    the precision of its ISO form."""
    cols = {k: v if isinstance(v, Column) else F.lit(v) for k, v in context.items()}
    return df.withColumns({**cols, "timestamp": F.date_trunc("millisecond", "timestamp")})


def merge_props(df: DataFrame, defaults: str | Column, props: str = "properties") -> DataFrame:
    """Merge default properties into the event's own, which win on shared keys."""
    left = F.col(defaults) if isinstance(defaults, str) else defaults
    return df.withColumn(props, merge_maps(left, F.col(props)))


def effective_user_id(user: str = "user_id", session: str = "session_id") -> Column:
    """The user id, or ``anonymous_<session>`` when there is none (absent or empty)."""
    return F.coalesce(F.nullif(F.col(user), F.lit("")), F.concat(F.lit(ANONYMOUS_PREFIX), F.col(session)))


def with_utm(df: DataFrame, url: str, referrer: str | None = None) -> DataFrame:
    """Add the five campaign fields of a URL and, if given, the referrer's host (definition ours)."""
    cols = {key: web.query_param(F.col(url), key) for key in web.UTM_KEYS}
    if referrer:
        cols["referrer_host"] = web.url_host(F.col(referrer))
    return df.withColumns(cols)


def with_device(df: DataFrame, ua: str = "user_agent") -> DataFrame:
    """Add device type, browser and operating system read from the user agent (definition ours)."""
    col = F.coalesce(F.col(ua), F.lit(""))
    return df.withColumns({
        "device_type": web.device_type(col), "browser": web.browser(col), "os": web.operating_system(col)})


def sanitize(df: DataFrame, *cols: str) -> DataFrame:
    """Drop markup characters from text columns."""
    return df.withColumns({c: sanitize_text(c) for c in cols})


def mask_pii(df: DataFrame, *cols: str) -> DataFrame:
    """Mask e-mail addresses, IP addresses and phone-like numbers in text columns (definition ours). Dates stay.

    One projection per rule, so each rule reads the result of the one before it once.
    """
    for needed, pattern, tag in PII_RULES:
        df = df.withColumns({c: mask_rule(F.col(c), needed, pattern, tag) for c in cols})
    return df


def typed_props(df: DataFrame, spec: Mapping[str, tuple[Sequence[str], str]], props: str = "properties") -> DataFrame:
    """Read properties into typed columns: per output the first key that casts (definition ours)."""
    return df.withColumns({
        name: F.coalesce(*[F.col(props)[k].try_cast(kind) for k in keys])
        for name, (keys, kind) in spec.items()})


def scroll_milestones(df: DataFrame, percent: str = "scroll_percent", page: str = "page") -> DataFrame:
    """First time each session and page reached 25, 50, 75 and 100 percent.

    Each row is first reduced to the highest point it reached, so rows are aggregated, not
    multiplied, before the shuffle; points below are filled in on the small result. Percents are rounded
    to whole ones first, halves up.
    """
    reached = F.floor(F.least(F.floor(F.col(percent) + 0.5), F.lit(100)) / 25).cast("int") * 25
    tops = (df.select("session_id", F.col(page).alias("page"), "timestamp", reached.alias("_top"))
            .filter("_top >= 25")
            .groupBy("session_id", "page", "_top").agg(F.min("timestamp").alias("timestamp")))
    points = F.explode(F.filter(F.array(*[F.lit(p) for p in SCROLL_POINTS]), lambda p: p <= F.col("_top")))
    return (tops.select("session_id", "page", points.alias("depth_percent"), "timestamp")
            .groupBy("session_id", "page", "depth_percent").agg(F.min("timestamp").alias("timestamp")))


def stitch_identity(df: DataFrame) -> DataFrame:
    """Give anonymous rows the first known user id seen in the same session (definition ours).

    Adds ``stitched_user_id``. The known ids are one row per session; a session holding very many
    rows is split by Spark's skew join, which can divide the event side.
    """
    anonymous = F.col("user_id").isNull() | (F.col("user_id") == "") | F.col("user_id").startswith(ANONYMOUS_PREFIX)
    known = one_per_key(df.filter(~anonymous), "session_id",
                        F.min_by("user_id", F.struct("timestamp", "user_id")).alias("_known"))
    return (df.join(known, "session_id", "left")
            .withColumn("stitched_user_id", F.when(anonymous, F.coalesce("_known", effective_user_id()))
                        .otherwise(F.col("user_id")))
            .drop("_known"))


def active_time(df: DataFrame, visible: str = "visible", page: str = "page",
                min_seconds: int = MIN_ACTIVE_SECONDS, slice_width: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """Whole seconds each page was visible in each session, kept when above ``min_seconds``.

    Rows are visibility states; a visible state lasts until the next row of its session and page.
    The sum is built in two levels: inside time slices of each session and page, then over the
    slices, of which there are few. No task ever sorts all rows of one large session.
    """
    keys = ["session_id", "page"]
    micros = F.unix_micros("timestamp")
    rows = df.select("session_id", F.col(page).alias("page"), "id", micros.alias("_us"),
                     time_bucket("timestamp", slice_width).alias("_slice"), F.col(visible).alias("_on"))
    inner = Window.partitionBy(*keys, "_slice").orderBy("_us", "id")
    slices = (rows.withColumn("_next", F.lead("_us").over(inner))
              .groupBy(*keys, "_slice")
              .agg(F.sum(F.when(F.col("_on"), F.col("_next") - F.col("_us"))).alias("_inside"),
                   F.min("_us").alias("_first"),
                   F.max_by(F.struct("_on", "_us"), F.struct("_us", "id")).alias("_last")))
    outer = Window.partitionBy(*keys).orderBy("_slice")
    tail = F.when(F.col("_last._on"), F.lead("_first").over(outer) - F.col("_last._us"))
    total = (slices.withColumn("_tail", tail).groupBy(*keys)
             .agg(F.sum(F.coalesce("_inside", F.lit(0)) + F.coalesce("_tail", F.lit(0))).alias("_total")))
    seconds = F.round(F.col("_total") / 1e6).cast("bigint")
    return total.select(*keys, seconds.alias("active_seconds")).filter(F.col("active_seconds") > min_seconds)
