"""Privacy jobs over a frame of user ids: anonymize, export, erase, and rewriting stored files.

All ids are handled in one pass. The id frame has a column ``id``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrain.operators.dedupe import one_per_key
from pulsegrain.operators.paging import first_n_per_group
from pulsegrain.operators.shaping import mask_pii  # noqa: F401  (the fourth privacy job)
from pulsegrain.sources.events import read_events, read_files, write_events
from pulsegrain.sources.store import files, folders, move, pointed, publish, remove

# Fixed values.
ANONYMOUS = {"email": "anonymized@example.com", "first_name": "Anonymous", "last_name": "User"}
PUSHED_IDS = 200
USER_COLUMN = {"events": "user_id", "users": "id", "sessions": "user_id", "ai_queries": "user_id"}


def _ids(ids: DataFrame, name: str) -> DataFrame:
    return one_per_key(ids.select(F.col("id").alias(name)).filter(F.col(name).isNotNull()), name)


def anonymize_events(events: DataFrame, ids: DataFrame, salt: str = "") -> DataFrame:
    """Replace the user and session ids of the given users by ``anonymous_`` and their SHA-256.

    The hash keeps one user's, and one session's, events together; counts do not change. A session id may hold the user
    id (``sessionize`` makes such). Ids that can be guessed need a secret ``salt``, which is put before them.
    """
    marked = events.join(_ids(ids, "user_id").withColumn("_hit", F.lit(True)), "user_id", "left")
    hidden = {c: F.concat(F.lit("anonymous_"), F.sha2(F.concat(F.lit(salt), F.col(c)), 256)) for c in ("user_id", "session_id") if c in events.columns}
    return marked.withColumns({c: F.when(F.col("_hit"), h).otherwise(F.col(c)) for c, h in hidden.items()}).select(events.columns)


def anonymize_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Replace e-mail and names of the given users by fixed values."""
    marked = users.join(_ids(ids, "id").withColumn("_hit", F.lit(True)), "id", "left")
    cols = {c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)) for c, v in ANONYMOUS.items() if c in users.columns}
    return marked.withColumns(cols).select(users.columns)


def anonymize(events: DataFrame, users: DataFrame, ids: DataFrame, salt: str = "") -> tuple[DataFrame, DataFrame]:
    return anonymize_events(events, ids, salt), anonymize_users(users, ids)


def export_user(events: DataFrame, users: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Profile and events of each given user, one JSON row each: all events, or the oldest ``limit`` if the caller asks."""
    chosen = _ids(ids, "user_id")
    own = events.join(chosen, "user_id", "left_semi")
    if limit is not None:
        own = first_n_per_group(own, ["user_id"], [F.col("timestamp"), F.col("id")], limit)
    options = {"ignoreNullFields": "false"}
    event_rows = own.select("user_id", F.lit("event").alias("kind"),
                            F.to_json(F.struct(*events.columns), options).alias("data"))
    profiles = (users.join(chosen.withColumnRenamed("user_id", "id"), "id", "left_semi")
                .select(F.col("id").alias("user_id"), F.lit("profile").alias("kind"),
                        F.to_json(F.struct(*users.columns), options).alias("data")))
    return profiles.unionByName(event_rows)


def erase(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the given users."""
    return {name: df.join(_ids(ids, USER_COLUMN[name]), USER_COLUMN[name], "left_anti").select(df.columns)
            for name, df in tables.items()}


def files_with(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Files of the stored table that hold events of the given users: ``file`` (name below the table), ``event_month``.

    Up to ``PUSHED_IDS`` users become a filter that reaches the scan, where Bloom filters and dictionaries skip the row
    groups without them; more are joined, and then every user column is read.
    """
    wanted = _ids(ids, "user_id")
    few = sorted(r["user_id"] for r in wanted.limit(PUSHED_IDS + 1).collect())
    below = F.concat_ws("/", F.slice(F.split("_metadata.file_path", "/"), -2, 2))
    stored = read_events(spark, path).select("user_id", "event_month", below.alias("file"))
    if len(few) > PUSHED_IDS:
        hits = stored.join(wanted, "user_id", "left_semi")
    else:
        hits = stored.filter(_one_of(few))
    return hits.select("file", "event_month").distinct()


def _one_of(names: Sequence[str]) -> Column:
    """A flat tree of equalities: a list of values beyond a few would reach the scan as its smallest and largest only."""
    if len(names) > 1:
        return _one_of(names[:len(names) // 2]) | _one_of(names[len(names) // 2:])
    return F.col("user_id") == names[0] if names else F.lit(False)


def rewrite_files(spark: SparkSession, path: str, ids: DataFrame,
                  change: Callable[[DataFrame], DataFrame]) -> list[str | None]:
    """Apply ``change`` to the stored files that hold events of the given users; returns their months.

    All other files stay as they are, under their names; events without a time are a month of their own (None). The
    changed events are first written beside the table, then a list of the files they replace is published; they are moved
    in, and the replaced files are removed. A run that is interrupted after the list is finished by the next one. Afterwards
    the copy is gone, and so is a month left without events. While files are moved a reader may see
    events twice. No other job may write the table until this one has finished.
    """
    copy, replaced = _beside(path)
    _move_in(spark, path)
    found = files_with(spark, path, ids).collect()
    if not found:
        return []
    names, months = sorted({r["file"] for r in found}), {r["event_month"] for r in found}
    write_events(change(read_files(spark, path, names)), copy, "overwrite")
    publish(spark, replaced, {"files": names})
    _move_in(spark, path)
    return sorted(months - {None}) + [None] * (None in months)


def _beside(path: str) -> tuple[str, str]:
    """Beside the table: the changed events, and the list of the files that they replace, there when they are whole."""
    root = path.rstrip("/")
    return f"{root}-rewrite", f"{root}-rewrite-files"


def _move_in(spark: SparkSession, path: str) -> None:
    """Replace the listed files by the changed ones, if there is a list; then drop the list and what is left beside."""
    copy, replaced = _beside(path)
    root, old = path.rstrip("/"), (pointed(spark, replaced) or {"files": []})["files"]
    if old:
        for month in folders(spark, copy, ""):
            for name in files(spark, f"{copy}/{month}"):
                move(spark, f"{copy}/{month}/{name}", f"{root}/{month}/{name}")
        for name in old:
            remove(spark, f"{root}/{name}")
        publish(spark, replaced, {"files": []})
    remove(spark, copy)


def anonymize_stored(spark: SparkSession, path: str, ids: DataFrame, salt: str = "") -> list[str]:
    """Anonymize the given users in the stored event table."""
    return rewrite_files(spark, path, ids, lambda events: anonymize_events(events, ids, salt))


def erase_stored(spark: SparkSession, path: str, ids: DataFrame) -> list[str]:
    """Erase the given users from the stored event table."""
    return rewrite_files(spark, path, ids, lambda events: erase({"events": events}, ids)["events"])
