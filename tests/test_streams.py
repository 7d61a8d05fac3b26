"""Streams against tables: progress of runs, restarts, batches that are written twice."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from provenia.streaming import intake, progress

SAYS = [
    "→ Loading economy config", "✓ Economy config — fine  0.1s", "⚠ Economy config — no portal", "✗ LLM ready — down", "✓ LLM ready — a/b-1  1.2s", "Seed data — 3 acts",
    "Zone 1 complete — 7 documents", "→ Zone 1 — portal", "nothing to see", "", "Outputs written — 12 records", "⚠ Writing outputs — slow  2m 3s",
    "Discovery complete — 9 act(s) (4 KNOWN, 5 NEW)", "→ Fetching — https://www.x.org/law/12 [{d}/5]", "✓ Fetched — Act {d} [{d}/5]  3s", "✗ Fetch failed — timeout [{d}/5]",
    "Translating [{d}/5]", "✓ RAG retrieval — 15 [{d}/9] 0.4s", "✗ RAG failed [{d}/5]", "LLM extraction", "✓ Validation — ok [{d}/5]", "⚠ Validation — short [{d}/5] 1s", "✓ LLM extraction — 2 [{d}/5]",
]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    progress.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def logs(folder, runs=12, parts=4, each=14, seed=5):
    """Logs in parts with times in their order."""
    rng, stamp = random.Random(seed), 1_700_000_000
    for part in range(parts):
        for run in range(runs):
            os.makedirs(f"{folder}/run {run}", exist_ok=True)
            path = f"{folder}/run {run}/part-{part:05d}.log"
            with open(path, "w") as f:
                f.write("\n".join("\x1b[32m" + rng.choice(SAYS).format(d=rng.randint(1, 5)) + "\x1b[0m" for _ in range(rng.randint(0, each))) + "\n")
            stamp += 1
            os.utime(path, (stamp, stamp))


def facts(df):
    return sorted(map(tuple, df.select("run", "item", "name", "status", "stage", "detail", "time").collect()), key=repr)


def test_progress_fold_and_windows_agree_and_restart_keeps_the_state(spark, rocksdb, tmp_path):
    logs(tmp_path / "logs")
    calls = []

    def fails_once(batch, number):
        calls.append(number)
        if number == 2 and calls.count(2) == 1:
            raise RuntimeError("lost between writing and committing")

    def start():
        reports = progress.progress_stream(intake.log_stream(spark, str(tmp_path / "logs"), parts_a_batch=9), "run", "seq", "line")
        return intake.store_batches(reports, str(tmp_path / "out"), str(tmp_path / "cp"), then=fails_once, availableNow=True)

    with pytest.raises(Exception, match="lost between"):
        start().awaitTermination()
    start().awaitTermination()
    assert calls.count(2) == 2 and max(calls) >= 4
    table = facts(progress.progress(intake.log_table(spark, str(tmp_path / "logs")), "run", "seq", "line"))
    assert len(table) > 150 and facts(progress.latest(spark.read.parquet(str(tmp_path / "out")))) == table


def test_lines_are_stored_once(spark, tmp_path):
    logs(tmp_path / "logs", runs=3)
    failed = []

    def fails_once(batch, number):
        if not failed:
            failed.append(number)
            raise RuntimeError("killed")

    def start():
        return intake.store_batches(intake.log_stream(spark, str(tmp_path / "logs"), 2), str(tmp_path / "out"), str(tmp_path / "cp"), then=fails_once, availableNow=True)

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    start().awaitTermination()
    want = sorted(map(tuple, intake.log_table(spark, str(tmp_path / "logs")).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("batch_id").collect())) == want
    assert len({w[:2] for w in want}) == len(want) and not any("\x1b" in w[2] for w in want)


def test_silent_runs_are_reported(spark, rocksdb, tmp_path):
    logs(tmp_path / "logs", runs=3, parts=2)
    runs = sorted(r.run for r in intake.log_table(spark, str(tmp_path / "logs")).select("run").distinct().collect())
    reports = progress.progress_stream(intake.log_stream(spark, str(tmp_path / "logs")), "run", "seq", "line", silent_ms=500)
    q = intake.store_batches(reports, str(tmp_path / "out"), str(tmp_path / "cp"), processingTime="200 milliseconds")
    silent, until = [], time.time() + 90
    while len(silent) < len(runs) and time.time() < until:
        time.sleep(1)
        if q.exception():
            raise q.exception()
        if (tmp_path / "out").exists() and any((tmp_path / "out").glob("batch_id=1/*.parquet")):
            silent = spark.read.parquet(str(tmp_path / "out")).where(F.col("name") == "phase").select("run", "detail").collect()
    q.stop()
    assert runs and sorted(map(tuple, silent)) == [(r, "silent") for r in runs]


def test_progress_of_odd_lines(spark):
    rows = [("a", 1, None), ("a", 2, "✓ Fetched — x [99999999999/1]"), (None, 3, "→ Fetching — y [1/2]"), ("b", 4, "⚠ Validation — no document")]
    got = facts(progress.progress(spark.createDataFrame(rows, "r string, n int, l string"), "r", "n", "l"))
    assert (None, "document", "1", "running", "fetch", "y", None) in got and ("b", "stage", "validate", "warn", None, "no document", None) in got
    assert not progress.progress(spark.createDataFrame([], "r string, n int, l string"), "r", "n", "l").collect()
