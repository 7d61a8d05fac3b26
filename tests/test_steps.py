"""Lanes with a deadline, models loaded once a worker, archives that grow by what is new, the newest of several files."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenia.operators import lanes, models, sinks
from provenia.sources import readers


def test_a_lane_that_overruns_is_interrupted_and_the_rest_kept(spark):
    def count(n):
        return lambda s: s.range(n).count()

    def slow(s):
        hold = F.udf(lambda x: time.sleep(60) or x, "long")
        return s.range(2).select(hold("id")).collect()

    def fails(s):
        raise ValueError("no portal\nmore")

    began = time.monotonic()
    found = lanes.run_lanes(spark, {"a": [("one", count(5)), ("two", fails), ("three", count(7))], "b": [("hangs", slow), ("after", count(1))], "c": [("late", count(3))]}, deadline=12, at_once=2)
    assert time.monotonic() - began < 45
    assert [(o.lane, o.step, o.status, o.result) for o in found] == [
        ("a", "one", "done", 5), ("a", "two", "failed", None), ("a", "three", "done", 7), ("b", "hangs", "interrupted", None), ("b", "after", "skipped", None), ("c", "late", "done", 3),
    ]
    assert found[1].error == "ValueError: no portal" and spark.range(4).count() == 4 and not spark.getTags()
    assert {o.status for o in lanes.run_lanes(spark, {"a": [("one", count(5))]}, deadline=-1)} == {"skipped"}


def counted_model(folder):
    """A stand-in model that leaves a file for each time it is loaded."""

    class Model:
        def __init__(self):
            open(f"{folder}/{os.getpid()}-{time.time_ns()}", "w").close()

        def encode(self, texts):
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])

        def score(self, questions, texts):
            return np.array([len(set(q.split()) & set(t.split())) for q, t in zip(questions, texts, strict=True)])

    return Model


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    docs = spark.createDataFrame([(i, None if i == 7 else "a " * (i % 5)) for i in range(400)], "id int, text string").repartition(24)
    got = docs.withColumn("v", models.embedded(F.col("text"), counted_model(str(tmp_path)))).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in got) and next(r for r in got if r.id == 7).v == [0, 0, 1]
    loads = [f.split("-")[0] for f in os.listdir(tmp_path)]
    assert len(loads) == len(set(loads)) < 24


def test_rerank_by_a_model(spark, tmp_path):
    rows = [("q", 1, 1, "who is he", "he"), ("q", 2, 2, "who is he", "he is who"), ("q", 3, 3, "who is he", None), ("q", 4, 4, "who is he", "he")]
    ranked = models.reranked(spark.createDataFrame(rows, "g string, seq int, rank int, question string, text string"), ["g"], "question", "text", counted_model(str(tmp_path)), k=3)
    assert [(r.seq, r.rerank_score) for r in ranked.orderBy("rank").collect()] == [(2, 3.0), (1, 1.0), (4, 1.0)]


def test_archive_adds_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "archive")
    make = lambda rows: spark.createDataFrame([(u, c) for u, c in rows], "source_url string, content binary")
    first = sinks.snapshots(make([("a", b"1"), ("b", b"1"), ("c", None), ("d", b"2")]), path)
    names = {r.source_url: r.archive_url for r in first.collect()}
    assert names["a"] == names["b"] != names["d"] and names["c"] is None
    files = sorted(os.listdir(path))
    sinks.snapshots(make([("a", b"1"), ("d", b"2")]), path)
    assert sorted(os.listdir(path)) == files
    sinks.snapshots(make([("a", b"1"), ("e", b"3")]), path)
    kept = spark.read.parquet(path)
    assert sorted(bytes(r.content) for r in kept.collect()) == [b"1", b"2", b"3"]


def test_newest_file_of_each_pillar(spark, tmp_path):
    for run, (pillar, stamp, value) in enumerate([("P6", 100, "old"), ("P7", 300, "seven"), ("P6", 200, "new"), ("P6", 150, "between")]):
        path = tmp_path / f"out {run}" / f"result_{pillar}_{run}.csv"
        path.parent.mkdir()
        path.write_text("﻿title,note\n" + value + ',"two\nlines"\n')
        os.utime(path, (1_700_000_000 + stamp,) * 2)
    (tmp_path / "result_P9.txt").write_text("x")
    got = readers.newest_rows(spark, str(tmp_path), r"result_(P\d)_")
    assert {(r.grp, r.title, r.note) for r in got.collect()} == {("P6", "new", "two\nlines"), ("P7", "seven", "two\nlines")}
    assert len(got.inputFiles()) == 2
    with pytest.raises(FileNotFoundError):
        readers.newest_rows(spark, str(tmp_path), r"none_(P\d)")
