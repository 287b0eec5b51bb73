"""Cases found in review: an index opened with other buckets, long runs in secret scans, workers without the library."""

import random
import re
import time

import pytest
from pyspark import cloudpickle

from pulsegrain.llm import exact_dedup
from pulsegrain.llm.secret_scan import BASE, MORE, Scanner, scan
from pulsegrain.session import work_dir


def test_an_index_goes_on_with_its_own_buckets(spark):
    path = work_dir(spark, "index")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    first = exact_dedup.DigestIndex(spark, path, buckets=4)
    first.admit(docs).count()
    spark.sql(f"DROP TABLE {first.name}")  # as in another session
    again = exact_dedup.DigestIndex(spark, path, buckets=16)
    more = spark.createDataFrame([(1000 + i, f"text {i}") for i in range(150, 260)], "doc_id long, text string")
    fates = {r.doc_id: r.kept for r in again.admit(more).collect()}
    assert again.buckets == 4 and again.read().count() == 260
    assert [i for i, kept in fates.items() if kept] == list(range(1200, 1260)) or {i for i, kept in fates.items() if kept} == set(range(1200, 1260))
    spark.sql(f"DROP TABLE {again.name}")
    with pytest.raises(ValueError, match="layout"):
        spark.createDataFrame([(b"x", 1)], "digest binary, keep_id long").write.parquet(f"{path}-foreign")
        exact_dedup.DigestIndex(spark, f"{path}-foreign")


def plain(text):
    out = []
    kinds = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"assign": 6, "access": 20, "hex": 24}
    for k, (kind, pattern) in enumerate(kinds.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[1] if kind == "assign" else m[0]) >= least[kind]]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def base_of(text, scanner):
    kinds = {r.kind for r in BASE}
    return [(x["kind"], x["start"], x["end"]) for x in scan([text.encode()], scanner)[0] if x["kind"] in kinds]


def test_long_runs_are_scanned_in_one_go():
    scanner = Scanner.of((*BASE, *MORE))
    begin = time.time()
    assert base_of("0a" * 500_000, scanner) == [("hex", 0, 1_000_000)]
    assert time.time() - begin < 30  # a walk from every byte took a day
    rng = random.Random(6)
    parts = ["a" * 30, "token=", "token = ", "secret:", "AKIA", "AKIA" + "A1" * 12, "0f" * 20, "0f" * 5, " ", "\"", "api_key", "password'", ":", "=", "Zz9+/", "-", "xyz", "deadbeef" * 4]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 25)))
        assert base_of(text, scanner) == plain(text)


def test_what_tasks_get_needs_no_library():
    import os
    import subprocess
    import sys
    data = cloudpickle.dumps(Scanner.of(BASE))
    code = "import pickle, sys; s = pickle.loads(sys.stdin.buffer.read()); print(len(s.rules), 'pulsegrain' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, cwd=os.path.sep, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
    assert done.stdout.split() == [b"3", b"False"]
