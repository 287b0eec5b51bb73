"""The stored event table: layout, pruning, and privacy jobs that rewrite it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrain.operators import filters, privacy
from pulsegrain.session import work_dir
from pulsegrain.sources import testbed
from pulsegrain.sources.events import conform, newest_instant, read_events, to_json_rows, write_by_user, write_events, write_json_rows
from pulsegrain.sources.ingest import ingest
from pulsegrain.sources.store import files, folders, remove


@pytest.fixture()
def stored(spark, small_dir):
    """Three months; user m only occurs in the third."""
    path = work_dir(spark, "events")
    rows = conform(testbed.base_events(spark, small_dir))
    later = rows.withColumn("timestamp", F.add_months("timestamp", 1).cast("timestamp"))
    alone = rows.limit(5).withColumns({"timestamp": F.lit(dt.datetime(2024, 3, 1)), "user_id": F.lit("m")})
    write_events(rows.unionByName(later).unionByName(alone), path)
    return path


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_months_are_pruned(spark, stored):
    plan = filters.in_range(read_events(spark, stored), "7d", dt.datetime(2024, 1, 20))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert read_events(spark, stored, ["202402"]).select("event_month").distinct().count() == 1


def test_newest_instant_prunes_too(spark, stored):
    rows = read_events(spark, stored)
    df = filters.in_range(rows, "1d")
    # The newest event is of 1 March 00:00.
    assert df.count() == rows.filter("timestamp >= '2024-02-29'").count() < rows.count()
    assert "PartitionFilters: [isnotnull(event_month" in df._jdf.queryExecution().executedPlan().toString()


def test_erase_then_export_is_empty_and_emptied_month_is_gone(spark, stored):
    before = read_events(spark, stored)
    gone = before.filter("user_id IN ('1', 'm')").count()
    total = before.count()
    assert privacy.erase_stored(spark, stored, ids(spark, "1", "m")) == ["202401", "202402", "202403"]
    after = read_events(spark, stored)
    assert after.count() == total - gone and after.filter("user_id IN ('1', 'm')").count() == 0
    users = spark.createDataFrame([], "id string, email string")
    assert privacy.export_user(after, users, ids(spark, "1")).count() == 0
    assert privacy.erase_stored(spark, stored, ids(spark, "nobody")) == []


def test_untouched_months_are_not_rewritten(spark, stored):
    files = {r.f for r in read_events(spark, stored).select(F.input_file_name().alias("f")).distinct().collect()}
    assert privacy.anonymize_stored(spark, stored, ids(spark, "m")) == ["202403"]
    now = {r.f for r in read_events(spark, stored).select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f for f in files if "202403" not in f} == {f for f in now if "202403" not in f}


def test_anonymize_keeps_rows_and_users(spark, stored):
    before = read_events(spark, stored)
    counts = (before.count(), before.select("user_id").distinct().count())
    privacy.anonymize_stored(spark, stored, ids(spark, "1", "2"))
    after = read_events(spark, stored)
    assert (after.count(), after.select("user_id").distinct().count()) == counts
    assert after.filter("user_id LIKE 'anonymous_%'").select("user_id").distinct().count() == 2


def test_export_limit_is_per_user(spark, stored):
    users = spark.createDataFrame([("1", "a@b.c"), ("2", "d@e.f")], "id string, email string")
    out = privacy.export_user(read_events(spark, stored), users, ids(spark, "1", "2"), limit=3)
    assert sorted((r.user_id, r.kind, r["count"]) for r in out.groupBy("user_id", "kind").count().collect()) == [
        ("1", "event", 3), ("1", "profile", 1), ("2", "event", 3), ("2", "profile", 1)]


def test_json_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [r.value for r in to_json_rows(df).collect()] == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    write_json_rows(df.coalesce(1), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']


def test_ingest_takes_each_file_once(spark, small_dir):
    source, sink, bad = (work_dir(spark, n) for n in ("raw", "sink", "bad"))
    testbed.raw_json(spark, small_dir).select("value").repartition(2).write.text(source)
    args = (spark, source, {"project_id": "p"}, sink, dt.datetime(2024, 3, 1), bad)
    assert [ingest(*args), ingest(*args)] == [2, 0]
    rows = read_events(spark, sink)
    stored = rows.count()
    assert stored == rows.select("id").distinct().count() > 0
    assert spark.read.parquet(bad).filter("error IS NULL").count() == 0
    spark.createDataFrame([('{"user_id":"new","event_name":"e","timestamp":"2024-01-02T00:00:00Z"}',), ("no json",), ("",)], "value string").coalesce(1).write.mode("append").text(source)
    assert ingest(*args) == 1 and read_events(spark, sink).count() == stored + 1
    assert "no json" in {r.line for r in spark.read.parquet(bad).collect()}


def test_an_interrupted_ingest_is_made_up_for(spark, small_dir):
    from pulsegrain.sources.ingest import source_files
    from pulsegrain.sources.ledger import mark
    source, sink, ledger = (work_dir(spark, n) for n in ("raw", "sink", "ledger"))
    testbed.raw_json(spark, small_dir).select("value").repartition(3).write.text(source)
    args = (spark, source, {"project_id": "p"}, sink, dt.datetime(2024, 3, 1))
    assert ingest(*args) == 3
    stored = read_events(spark, sink).count()
    mark(source_files(spark, source), ledger, done=False)  # the rows were stored, and then the driver died
    assert ingest(*args, ledger=ledger) == 3 and read_events(spark, sink).count() == stored
    assert ingest(*args, ledger=ledger) == 0


def test_events_without_a_time_are_erased_too(spark):
    path = work_dir(spark, "events")
    rows = spark.createDataFrame([("1", dt.datetime(2024, 1, 1)), ("1", None), ("2", None), ("2", dt.datetime(2024, 1, 2))], "user_id string, timestamp timestamp")
    write_events(conform(rows), path)
    assert privacy.erase_stored(spark, path, ids(spark, "1")) == ["202401", None]
    assert [r.user_id for r in read_events(spark, path).collect()] == ["2", "2"]
    assert privacy.erase_stored(spark, path, ids(spark, "2")) == ["202401", None]
    assert read_events(spark, path).count() == 0
    assert read_events(spark, path, [None]).count() == 0


def test_no_copy_of_rewritten_events_stays(spark, stored):
    privacy.erase_stored(spark, stored, ids(spark, "1"))
    assert folders(spark, f"{stored}-rewrite", "") == []


def test_an_interrupted_rewrite_is_finished_by_the_next(spark, stored, monkeypatch):
    total = read_events(spark, stored).count()
    gone = read_events(spark, stored).filter("user_id = '1'").count()
    move_in, calls = privacy._move_in, []

    def stops(spark, path):
        calls.append(path)
        if len(calls) == 2:
            # The list is published, one changed file is moved in, and one that it replaces is gone.
            copy, replaced = privacy._beside(path)
            month = folders(spark, copy, "")[0]
            name = files(spark, f"{copy}/{month}")[0]
            privacy.move(spark, f"{copy}/{month}/{name}", f"{path}/{month}/{name}")
            remove(spark, f"{path}/{privacy.pointed(spark, replaced)['files'][0]}")
            raise RuntimeError("stopped")
        move_in(spark, path)

    monkeypatch.setattr(privacy, "_move_in", stops)
    with pytest.raises(RuntimeError):
        privacy.erase_stored(spark, stored, ids(spark, "1"))
    privacy.erase_stored(spark, stored, ids(spark, "1"))
    after = read_events(spark, stored)
    assert after.count() == total - gone and after.filter("user_id = '1'").count() == 0
    assert folders(spark, f"{stored}-rewrite", "") == []


def stored_files(spark, path):
    return {f"{m}/{f}" for m in folders(spark, path, "") for f in files(spark, f"{path}/{m}")}


@pytest.mark.parametrize("pushed", [0, 200])
def test_only_files_with_the_users_are_rewritten(spark, monkeypatch, pushed):
    """With the ids as a filter of the scan, and as a join: the same files."""
    monkeypatch.setattr(privacy, "PUSHED_IDS", pushed)
    path = work_dir(spark, "events")
    for k in range(4):  # file k holds the users k, k + 4, ... of one month
        write_events(conform(spark.range(k, 4000, 4).selectExpr("string(id) AS user_id", "string(id) AS id", "timestamp'2024-01-05' AS timestamp")).coalesce(1), path)
    before = stored_files(spark, path)
    hit = {r.file for r in privacy.files_with(spark, path, ids(spark, "2", "6", "nobody")).collect()}
    assert privacy.erase_stored(spark, path, ids(spark, "2", "6", "nobody")) == ["202401"]
    after = stored_files(spark, path)
    assert hit and before - after == hit and len(before & after) >= 3
    left = {r.user_id for r in read_events(spark, path).collect()}
    assert left == {str(i) for i in range(4000)} - {"2", "6"}


def test_row_groups_without_the_user_are_skipped(spark):
    path = work_dir(spark, "events")
    users = conform(spark.range(20000).selectExpr("string(id * 2) AS user_id", "timestamp'2024-01-05' AS timestamp"))
    write_events(users.coalesce(1), path)

    def read_rows(name):
        df = read_events(spark, path).filter(F.col("user_id") == name)
        assert "EqualTo(user_id" in df._jdf.queryExecution().executedPlan().toString()
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return leaves.head().metrics().get("numOutputRows").get().value()

    assert read_rows("10000") > 0
    assert sum(read_rows(str(n)) for n in (10001, 10003, 10005)) == 0  # inside the range of the stored ids


def test_newest_instant_opens_one_month(spark, stored):
    assert newest_instant(spark, stored) == dt.datetime(2024, 3, 1)
    privacy.erase_stored(spark, stored, ids(spark, "m"))  # March is empty now
    expected = read_events(spark, stored).agg(F.max("timestamp")).first()[0]
    assert newest_instant(spark, stored) == expected < dt.datetime(2024, 3, 1)
    assert newest_instant(spark, work_dir(spark, "nothing")) is None
    newest = filters.in_range(read_events(spark, stored), "1d").agg(F.max("timestamp")).first()[0]
    assert newest == expected


def test_pages_by_cursor_are_the_sorted_rows(spark):
    from pulsegrain.operators.paging import page_after
    rows = [(n, None if n % 5 == 0 else dt.datetime(2024, 1 + n % 2, 1, 0, 0, n % 3, 1), None if n % 4 == 0 else float(n % 3)) for n in range(23)]
    df = spark.createDataFrame(rows, "n int, timestamp timestamp, x double").withColumn("event_month", F.date_format("timestamp", "yyyyMM"))
    for order in (["-timestamp", "x", "n"], ["timestamp", "-x", "-n"], ["x", "-timestamp", "n"], ["-n"]):
        wanted = [r.n for r in df.orderBy(*(F.col(o[1:]).desc() if o[0] == "-" else F.col(o) for o in order)).collect()]
        found, cursor, more = [], None, True
        while more:
            page = page_after(df, order, cursor, 4).collect()
            by_n = {r.n: r for r in page}
            page = [by_n[n] for n in wanted if n in by_n]
            found += [r.n for r in page]
            cursor, more = page[-1].cursor, page[-1].has_more
        assert found == wanted
        assert page_after(df, order, cursor, 4).count() == 0
    plan = page_after(df, ["-n"], cursor)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "offset" not in plan.lower()
    for bad in ("x", "", "e30="):
        with pytest.raises(ValueError):
            page_after(df, ["-n"], bad)
    with pytest.raises(ValueError):
        page_after(df, ["n"], cursor)
    with pytest.raises(ValueError):
        page_after(df, ["n"], None, 1001)


def test_a_cursor_prunes_months(spark, stored):
    from pulsegrain.operators.paging import page_after
    rows = read_events(spark, stored)
    cursor = rows.filter("event_month = '202402'").transform(lambda d: page_after(d, ["-timestamp", "id"], None, 1)).first().cursor
    plan = page_after(rows, ["-timestamp", "id"], cursor)._jdf.queryExecution().executedPlan().toString()
    assert "(event_month" in plan.split("PartitionFilters:")[1].split("]")[0] and "LessThanOrEqual(timestamp" in plan


def test_the_copy_by_user_needs_no_shuffle_of_events(spark, small_dir):
    from pulsegrain.operators import retention, sessions, users
    rows = testbed.base_events(spark, small_dir)
    copy = write_by_user(rows, "copy_by_user", work_dir(spark, "by-user"), 4)
    gap = dt.timedelta(hours=12)
    for made in (lambda d: sessions.sessionize(d, gap).select("id", "session_id"), users.user_profile, users.churn_risk,
                 lambda d: retention.retention(d, "p0", as_of=dt.datetime(2024, 2, 1))):
        df = made(copy)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(user_id" not in plan
        assert sorted(map(str, df.collect())) == sorted(map(str, made(conform(rows)).collect()))


def test_permissions_of_the_key_come_along(spark):
    from pulsegrain.operators.joins import resolve_project
    rows = spark.createDataFrame([("1", "k")], "id string, key string")
    keys = spark.createDataFrame([("k", "p2", {"w": "1"}), ("k", "p1", {"w": "2"}), ("k", "p1", {"w": "0"})], "k string, project_id string, permissions map<string,string>")
    keys = keys.select(F.sha2("k", 256).alias("key_hash"), "project_id", "permissions", F.lit(True).alias("is_active"), F.lit(dt.datetime(2025, 1, 1)).alias("expires_at"))
    projects = spark.createDataFrame([("p1", "one"), ("p2", "two")], "id string, name string")
    found = resolve_project(rows, keys, projects, dt.datetime(2024, 1, 1), "key").collect()
    assert [(r.project_id, r.permissions) for r in found] == [("p1", {"w": "0"})]
