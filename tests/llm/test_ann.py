"""Learned partitions against brute force, at every size."""

import numpy as np
import pytest

from provenia.llm import ann


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist(), 1, "x") for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<double>, part int, shelf string")


@pytest.mark.parametrize("n", [500, 2000, 16_000])
def test_recall_and_scored_share(spark, n):
    """Vectors without any structure, the hardest case: recall of 0.9, and under half of all rows scored for a query."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    counter = spark.sparkContext.accumulator(0)
    found = {}
    for r in ann.nearest(frame(spark, x), counter=counter).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked, hit = list(range(0, n, 50)), 0
    for q in asked:
        s = u @ u[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5].tolist()) & set(found[q]))
    assert hit / (5 * len(asked)) >= 0.9
    assert 0 < counter.value < 0.5 * n * len(asked)


def test_cosine_of_extreme_vectors(spark):
    """Components near the ends of the double range; the score is that of the scaled vectors."""
    x = np.array([[1e200, 1e200], [1e200, 0.0], [1e-200, 1e-200], [3.0, 4.0]])
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(frame(spark, x, [0, 1, 2, 3])).collect()}
    assert got[0, 2] == pytest.approx(1, abs=1e-15) and got[0, 1] == pytest.approx(0.5**0.5, abs=1e-15) and got[0, 3] == pytest.approx(7 / 50**0.5, abs=1e-15)


def test_shelves(spark):
    first, number = ann.shelves_of({0: 5000, 1: 3000, 2: 20_000, 3: 10, 5: 8000}, 6)
    assert number.tolist() == [1, 1, 3, 1, 1, 1] and first.tolist() == [0, 0, 1, 4, 4, 4]


def test_large_parts_have_several_shelves(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHELF_ROWS", 40)
    x = np.random.default_rng(1).normal(size=(900, 8)) + np.repeat(np.random.default_rng(2).normal(size=(3, 8)) * 4, 300, axis=0)
    found = {}
    for r in ann.nearest(frame(spark, x)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    u, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        s[q] = -2
        assert sorted(r for r, _ in found[q]) == [1, 2, 3, 4, 5]
        hit += len(set(np.argsort(-s)[:5].tolist()) & {v for _, v in found[q]})
    assert hit / 90 >= 0.9
