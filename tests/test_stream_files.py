"""Files of the stream checks grow with their rows."""

import datetime as dt

import pytest

from pulsegrain.plans import checks_streams
from pulsegrain.session import work_dir

T0 = dt.datetime(2024, 1, 1)


def _frame(spark, ids):
    return spark.createDataFrame([(str(i), T0 + dt.timedelta(minutes=i)) for i in ids], "id string, timestamp timestamp")


def _batches(spark, stream):
    """The ids of each micro-batch."""
    seen = []
    checks_streams._drain(spark, stream.writeStream.option("checkpointLocation", work_dir(spark, "offsets"))
                          .foreachBatch(lambda df, _: seen.append(sorted(int(r.id) for r in df.collect()))))
    return seen


@pytest.mark.parametrize("rows, per_file, files", [(100, 10, 10), (100, 1000, 4)])
def test_replay_has_files_in_proportion_and_two_batches(spark, monkeypatch, rows, per_file, files):
    monkeypatch.setattr(checks_streams, "ROWS_PER_FILE", per_file, raising=False)
    seen, read = [], checks_streams.stream_events
    monkeypatch.setattr(checks_streams, "stream_events", lambda s, path, *a: seen.append(len(s.read.parquet(path).inputFiles())) or read(s, path, *a))
    got = _batches(spark, checks_streams._replay(spark, _frame(spark, range(rows))))
    assert seen == [files] and len(got) == 2 and sorted(sum(got, [])) == list(range(rows))


def test_parts_of_any_size_are_one_batch_each(spark, monkeypatch):
    monkeypatch.setattr(checks_streams, "ROWS_PER_FILE", 10, raising=False)
    seen, read = [], checks_streams.stream_events
    monkeypatch.setattr(checks_streams, "stream_events", lambda s, path, *a: seen.append(len(s.read.parquet(path).inputFiles())) or read(s, path, *a))
    parts = [list(range(50)), [], [50], list(range(51, 80))]
    got = _batches(spark, checks_streams._in_turn(spark, [_frame(spark, ids) for ids in parts]))
    assert seen == [20] and got == parts
