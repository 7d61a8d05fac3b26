"""Periodic runs of words: a grid probed at multiples of each period, survivors extended by whole chunks.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 * q)`` words that no
neighbouring word extends. Such a run holds four points of the grid ``0, q, 2q, ...`` in a row, and
their words are equal; so words are compared at the grid points of every period only, about
``n * ln(n)`` comparisons of ``n`` words, and what survives is extended both ways.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provenia.llm.common import bytes_of

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared at once when a survivor is looked at, and at first when it is extended; survivors looked at together.
LOOK, CHUNK, TOGETHER = 32, 64, 4096
#: Bytes of text whose results are handed back together, about.
SLAB = 1 << 22
RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def word_codes(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    return np.fromiter(map(_Codes().__getitem__, words), np.int32, len(words))


def _unequal(w: np.ndarray, at: int, p: int, step: int) -> int:
    """First place from ``at`` on, upward or downward, whose word differs from the one ``p`` later; the end of the text else."""
    end, size = len(w) - p, CHUNK
    while 0 <= at < end:
        lo, hi = (at, min(end, at + size)) if step > 0 else (max(0, at + 1 - size), at + 1)
        other = np.flatnonzero(w[lo:hi] != w[lo + p : hi + p])
        if len(other):
            return lo + int(other[0 if step > 0 else -1])
        at, size = (hi if step > 0 else lo - 1), min(2 * size, 1 << 16)
    return at


def _likely(w: np.ndarray, p: int, xs: np.ndarray) -> Iterator[int]:
    """The grid points after which the next words are those a period later, too (a run's first point has ``2 * p`` such words)."""
    look = np.arange(min(2 * p, LOOK))
    for i in range(0, len(xs), TOGETHER):
        some = xs[i : i + TOGETHER]
        places = some[:, None] + look
        yield from some[(w[places] == w[places + p]).all(1)].tolist()


def _grid(w: np.ndarray, covered: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Periods in ascending order with their grid points at which four equal words begin.

    Small periods are taken one by one with all their points; large ones together, point by point,
    so that a text costs about ``2 * sqrt(n)`` array steps. ``covered`` is looked at as it grows.
    """
    n, most = len(w), len(w) // LEAST_PERIODS
    small = min(most, int(n**0.5))
    for p in range(1, small + 1):
        grid = w[::p]
        same = grid[1:] == grid[:-1]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(hits):
            yield p, hits * p
    found: list[np.ndarray] = []
    for j in range(n):
        hi = min(most, (n - 1) // (j + 3))
        if hi <= small:
            break
        at = lambda k: w[k * (small + 1) : k * hi + 1 : k] if k else w[:1]  # noqa: E731, B023
        second, third = at(j + 1), at(j + 2)
        ps = small + 1 + np.flatnonzero((at(j) == second) & (second == third) & (third == at(j + 3)))
        ps = ps[covered[j * ps] < (j + 2) * ps]
        if len(ps):
            found.append(np.stack([ps, j * ps]))
    if found:
        ps, xs = np.concatenate(found, 1)
        order = np.lexsort((xs, ps))
        ps, xs = ps[order], xs[order]
        cuts = np.flatnonzero(np.r_[True, ps[1:] != ps[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(ps)], strict=True):
            yield int(ps[a]), xs[a:b]


def find_runs(w: np.ndarray) -> np.ndarray:
    """The runs of some word numbers: rows of start, length and period, by start and then period.

    A point whose next two periods lie in a run of a smaller period is skipped: by the theorem of
    Fine and Wilf the whole stretch then has that smaller period and lies in that run. Points
    between the one that was extended and the next mismatch belong to the same stretch.
    """
    runs: list[tuple[int, int, int]] = []
    covered = np.zeros(len(w), np.int64)  # the furthest end of the runs that began here or before and reach here
    for p, xs in _grid(w, covered):
        behind = 0
        for x in _likely(w, p, xs[covered[xs] < xs + 2 * p]):
            if x < behind:
                continue
            behind = _unequal(w, x, p, 1)
            start, end = _unequal(w, x, p, -1) + 1, behind + p
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                runs.append((start, end - start, p))
                np.maximum(covered[start:end], end, out=covered[start:end])
    return np.array(sorted(runs, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exact length over period; of equal ones the first, then the one of the smallest period."""
    if not len(runs):
        return None
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-9)].tolist()
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The periodic runs of every whole text: ``doc_id, n_words, runs, strongest, text``.

    ``runs`` holds (start, length, period) in words, by start and period; ``strongest`` is the one
    with most periods (null without runs); ``text`` is the text without the repeated periods, its
    words joined by one space. Words are what lies between ASCII white space, in their own letter case.

    One pass over each text without a shuffle; a row for every row. A null or empty text has no
    words and no runs and an empty ``text``; a null ``doc_id`` stays null; repeated ids and extra
    columns do not matter. A text of ``n`` words needs memory in proportion to ``n``.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def flush(ids: pa.Array, rows: list) -> pa.RecordBatch:
        runs = [r for r, _, _, _ in rows]
        flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN))
        best = [b and dict(zip(("start", "length", "period"), b, strict=True)) for _, b, _, _ in rows]
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array([n for _, _, n, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans),
                pa.array(best, _RUN), pa.array([t for _, _, _, t in rows], pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "runs", "strongest", "text"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, size, since = batch.column(0), [], 0, 0
            for i, raw in enumerate(bytes_of(batch.column(1))):
                words = (raw or b"").split()
                runs = find_runs(word_codes(words))
                rows.append((runs, strongest(runs), len(words), collapsed(words, runs)))
                size += len(raw or b"")
                if size > SLAB:
                    yield flush(ids[since : i + 1], rows)
                    rows, size, since = [], 0, i + 1
            if rows:
                yield flush(ids[since:], rows)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, runs array<{RUN}>, strongest {RUN}, text string")
