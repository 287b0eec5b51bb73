"""Raw client events: JSON lines, batch envelopes, and the batch ingest job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrain.functions.periods import AsOf, month_key
from pulsegrain.functions.props import props_key
from pulsegrain.operators.shaping import enrich
from pulsegrain.operators.validation import apply_defaults, judge_events, split_judged, validate_events
from pulsegrain.schemas import ENVELOPE, MAX_BATCH, RAW_EVENT
from pulsegrain.session import work_dir
from pulsegrain.sources.events import read_events, write_events
from pulsegrain.sources.ledger import mark, open_units
from pulsegrain.sources.store import remove

FIELDS = ("user_id", "event_name", "properties", "timestamp", "session_id", "platform")


def unify_spelling(raw: DataFrame) -> DataFrame:
    """Fold the camel-case spelling of mobile clients into the snake-case columns."""
    return raw.withColumns({
        "user_id": F.coalesce("user_id", "userId"),
        "event_name": F.coalesce("event_name", "eventName"),
        "session_id": F.coalesce("session_id", "sessionId"),
    }).drop("userId", "eventName", "sessionId")


def read_raw(spark: SparkSession, *paths: str) -> DataFrame:
    """Read JSON lines, one event each, with the text of the line (``line``). A line that is no JSON gives a row of
    NULLs beside its text, which validation rejects, rather than a failed job. Blank lines are skipped."""
    lines = spark.read.text(list(paths)).filter(F.trim("value") != "")
    return parse_events(lines.withColumn("line", F.col("value")))


def parse_events(df: DataFrame, col: str = "value") -> DataFrame:
    """Parse a text column holding one event per row; other columns are kept.

    The parsed fields come out of a generator, as one row: filters on them then stay above it, and
    the text is parsed once per row rather than once per use of a field.
    """
    keep = [c for c in df.columns if c != col]
    return unify_spelling(df.select(*keep, F.inline(F.array(F.from_json(col, RAW_EVENT)))))


def explode_batches(df: DataFrame, col: str = "value", max_batch: int = MAX_BATCH) -> tuple[DataFrame, DataFrame]:
    """Split envelopes ``{"events": [...]}`` into event rows.

    Returns (events, rejected envelopes). An envelope of 0 or more than ``max_batch`` events is
    rejected whole, before it is exploded. ``position`` is the place within the envelope.
    """
    opened = df.withColumn("_events", F.from_json(col, ENVELOPE)["events"])
    size = F.coalesce(F.size("_events"), F.lit(-1))
    accepted = opened.filter(size.between(1, max_batch))
    rejected = (opened.filter(~size.between(1, max_batch)).withColumn(
        "error", F.when(size < 0, '"events" is required')
        .when(size == 0, '"events" must contain at least 1 items')
        .otherwise(f'"events" must contain less than or equal to {max_batch} items')).drop("_events"))
    keep = [c for c in df.columns if c != col]
    rows = accepted.select(*keep, F.posexplode("_events").alias("position", "_value"))
    return parse_events(rows, "_value"), rejected


def content_id() -> Column:
    """Identifier computed from the event itself.

    A random id would differ when a lost task is run again, and between two deliveries of the
    same event; this one does not.
    """
    return F.sha2(_as_json(), 256)


def delivery_id(*delivery: Column) -> Column:
    """Identifier of one received event: its content and where it was received, so equal events keep their own."""
    return F.sha2(_as_json(*delivery), 256)


def _as_json(*more: Column) -> Column:
    """The event as JSON: NULL and empty fields differ, and no text can look like two fields."""
    micros = F.unix_micros("timestamp").alias("at")
    fields = F.struct("project_id", "user_id", "session_id", "event_name", micros, props_key().alias("props"),
                      *(c.alias(f"delivery{i}") for i, c in enumerate(more)))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def prepare(raw: DataFrame, context: dict[str, Column | str], as_of: AsOf = None, **rules) -> tuple[DataFrame, DataFrame]:
    """Validate, default, enrich and identify raw events: (events ready to store, rejected)."""
    valid, rejected = validate_events(raw, **rules)
    events = enrich(apply_defaults(valid, as_of), context)
    return events.withColumn("id", content_id()), rejected


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, unit) of the files in a folder; a file that was replaced is another unit. Contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.concat_ws("|", "path", F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string")).alias("unit"))


def without_stored(spark: SparkSession, events: DataFrame, table: str) -> DataFrame:
    """``events`` without those whose id the touched months of the table already hold."""
    try:
        stored = read_events(spark, table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return events
    months = [r[0] for r in events.select(month_key("timestamp")).distinct().collect()]  # one row a month
    return events.join(read_events(spark, table, months).select("id"), "id", "left_anti") if months else events


def ingest(spark: SparkSession, json_path: str, context: dict[str, Column | str], sink: str,
           as_of: AsOf = None, rejected_sink: str | None = None, ledger: str | None = None,
           all_or_nothing: str | None = None, **rules) -> int:
    """Append a folder of JSON lines to the event table; rejected rows, with their text, go to their own folder.

    Each source file is taken once: the ledger (``<sink>-ledger`` unless given) knows the files of earlier runs. A run
    that was interrupted is made up for by the next: then, ids that are stored already are left out (its rejected rows
    may come twice). Returns the number of files taken. Verdicts are computed once, staged, and both outputs are read from there.
    """
    ledger = ledger or f"{sink.rstrip('/')}-ledger"
    files = open_units(source_files(spark, json_path), ledger).collect()  # one row a file, as Spark's own listing
    if not files:
        return 0
    units = spark.createDataFrame([(f.unit,) for f in files], "unit string").coalesce(1)
    mark(units, ledger, done=False)
    verdicts = work_dir(spark, "verdicts")
    judge_events(read_raw(spark, *[f.path for f in files]), **rules).write.parquet(verdicts)
    good, rejected = split_judged(spark.read.parquet(verdicts), all_or_nothing)
    events = enrich(apply_defaults(good.drop("line"), as_of), context).withColumn("id", content_id())
    if any(f.begun for f in files):
        events = without_stored(spark, events, sink)
    write_events(events, sink)
    if rejected_sink:
        rejected.write.mode("append").parquet(rejected_sink)
    mark(units, ledger, done=True)
    remove(spark, verdicts)
    return len(files)
