"""Event validation, defaults, and the share of rows per error."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrain.functions.numbers import rounded
from pulsegrain.functions.periods import AsOf
from pulsegrain.schemas import (
    MAX_NAME_LENGTH, MAX_PROPERTIES, MAX_PROPERTIES_CHARS, PLATFORMS, STRICT_NAME_PATTERN, UUID_PATTERN)

EPOCH_MILLIS = "^[0-9]{11,14}\\z"
ISO_START = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def parse_time(col: str | Column) -> Column:
    """ISO-8601 text or epoch milliseconds as a timestamp, NULL when neither."""
    text = F.col(col) if isinstance(col, str) else col
    return (F.when(text.rlike(EPOCH_MILLIS), F.timestamp_millis(text.try_cast("bigint")))
            .when(text.rlike(ISO_START), text.try_cast("timestamp")))


def _rule_rows(strict: bool, id_pattern: str | None) -> list[tuple[str, Column, str]]:
    """(field, violated when, message), in the order the fields are checked."""
    name, props, pairs = F.col("event_name"), F.col("properties"), F.col("_typed")
    nested = F.exists(F.map_values(pairs), lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"))
    rules = [
        ("user_id", F.col("user_id").isNull(), '"user_id" is required'),
        ("user_id", F.col("user_id") == "", '"user_id" is not allowed to be empty')]
    if id_pattern:
        rules.append(("user_id", ~F.col("user_id").rlike(id_pattern), '"user_id" must be a valid GUID'))
    rules += [
        ("event_name", name.isNull(), '"event_name" is required'),
        ("event_name", name == "", '"event_name" is not allowed to be empty'),
        ("event_name", F.length(name) > MAX_NAME_LENGTH,
         f'"event_name" length must be less than or equal to {MAX_NAME_LENGTH} characters long')]
    if strict:
        rules.append(("event_name", ~name.rlike(STRICT_NAME_PATTERN), "Invalid event name format"))
    rules += [
        ("properties", props.isNotNull() & pairs.isNull(), '"properties" must be of type object'),
        ("properties", nested, '"properties" values must be one of [string, number, boolean]')]
    if strict:
        rules += [
            ("properties", F.size(F.map_keys(pairs)) > MAX_PROPERTIES, "Too many properties"),
            ("properties", F.length(F.to_json(pairs)) > MAX_PROPERTIES_CHARS,
             "Properties too large")]
    rules += [
        ("timestamp", F.col("timestamp").isNotNull() & parse_time("timestamp").isNull(),
         '"timestamp" must be in ISO 8601 date format')]
    if id_pattern:
        rules.append(("session_id", F.col("session_id").isNotNull() & ~F.col("session_id").rlike(id_pattern),
                      '"session_id" must be a valid GUID'))
    rules.append(("platform", F.col("platform").isNotNull() & ~F.col("platform").isin(*PLATFORMS),
                  f'"platform" must be one of [{", ".join(PLATFORMS)}]'))
    return rules


def judge_events(df: DataFrame, strict: bool = False, id_pattern: str | None = None) -> DataFrame:
    """Add ``field`` and ``error`` of the first violated rule, both NULL on a good row.

    ``id_pattern="uuid"`` demands UUID user and session ids; by default any non-empty id passes.
    ``strict`` adds the rules on name format, number of properties and their serialized size.
    The typed properties and the verdict come out of generators of one row each, so that a filter
    on the verdict does not copy all rules, and the parsing they need, below itself.
    """
    pattern = UUID_PATTERN if id_pattern == "uuid" else id_pattern
    verdict = F.lit(None).cast("struct<field:string,error:string>")
    for field, violated, message in reversed(_rule_rows(strict, pattern)):
        verdict = F.when(violated, F.struct(F.lit(field).alias("field"), F.lit(message).alias("error"))).otherwise(verdict)
    typed = df.select("*", F.explode(F.array(F.from_json("properties", "map<string,variant>"))).alias("_typed"))
    return typed.select(*df.columns, F.inline(F.array(verdict)))


def validate_events(df: DataFrame, strict: bool = False, id_pattern: str | None = None,
                    all_or_nothing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split raw events into (valid, rejected).

    Raw ``properties`` and ``timestamp`` are text; in the valid part they are typed. Rows are
    rejected one by one. ``all_or_nothing`` names a batch id column: one bad event then rejects
    its whole batch (of at most a hundred events).
    """
    return split_judged(judge_events(df, strict, id_pattern), all_or_nothing)


def split_judged(judged: DataFrame, all_or_nothing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``validate_events``, from rows that have their verdict."""
    bad = F.col("error").isNotNull()
    if all_or_nothing:
        # Rows without a batch id are batches of their own, and are spread by what they hold.
        alone = F.col(all_or_nothing).isNull()
        spread = F.when(alone, F.xxhash64("user_id", "event_name", "timestamp", "properties"))
        of_batch = F.max("error").over(Window.partitionBy(all_or_nothing, spread))
        judged = judged.withColumn("_batch_error", F.when(alone, F.col("error")).otherwise(of_batch))
        batch_bad = F.col("_batch_error").isNotNull()
        rejected = judged.filter(batch_bad).withColumn(
            "error", F.coalesce("error", F.lit("batch rejected"))).drop("_batch_error")
        good = judged.filter(~batch_bad).drop("_batch_error")
    else:
        rejected, good = judged.filter(bad), judged.filter(~bad)
    valid = good.drop("field", "error").withColumns({
        "properties": F.from_json("properties", "map<string,string>"),
        "timestamp": parse_time("timestamp")})
    return valid, rejected


def apply_defaults(df: DataFrame, as_of: dt.datetime | Column | None = None) -> DataFrame:
    """Fill absent properties (empty), timestamp (``as_of``, else now) and platform (web)."""
    now = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.withColumns({
        "properties": F.coalesce("properties", F.create_map().cast("map<string,string>")),
        "timestamp": F.coalesce("timestamp", now.cast("timestamp")),
        "platform": F.coalesce("platform", F.lit("web"))})


def validation_summary(df: DataFrame, strict: bool = False, id_pattern: str | None = None) -> DataFrame:
    """Rows and share of all rows per field and error; good rows appear as field '' and error ''."""
    counts = (judge_events(df, strict, id_pattern)
              .groupBy(F.coalesce("field", F.lit("")).alias("field"), F.coalesce("error", F.lit("")).alias("error"))
              .agg(F.count("*").alias("events")))
    total = F.sum("events").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", rounded(F.col("events") / total, 4))
