"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens; masked-out positions are ignored, so a copy
with single substitutions still shares seeds. The seed hashes of the test items are joined with
those of the training texts inside the scan of the texts: a block of items (bounded in tokens)
goes to the executors as a hash table, further blocks take further scans, and no text is
shuffled. Every hit names a diagonal of one item and one text, which is then compared token by
token around the hit; the overlaps of an item on neighbouring diagonals, parted by inserted or dropped
tokens, are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import bytes_of

#: Fixed masks: 1 compares the token, 0 ignores it. Any two substitutions inside a window of ten tokens leave one of them whole.
MASKS = ("11111", "1101101", "1011011", "110011001", "1110000011")
#: Items of up to so many words are their own seed and must occur whole and unchanged.
SHORT = 4
#: Fewest words of an overlap, and of a part of it on one diagonal; most words that one part lies off the next.
LEAST_WORDS, LEAST_PART, MOST_SHIFT = 12, 2, 8
#: Tokens of the items that one scan looks for: the bound on what is broadcast.
BLOCK_TOKENS = 2_000_000
#: Odd multipliers, one a position.
_ODD = [(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) & ((1 << 64) - 1) for i in range(max(map(len, MASKS)))]
#: Words of texts that are hashed at one go.
_TOGETHER = 50_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(raw: bytes) -> list[bytes]:
    """Runs of letters and digits (any byte of a non-ASCII character counts as a letter), A-Z lower-cased."""
    return raw.translate(_FOLD).split()


class SeedIndex:
    """Spaced-seed hashes of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.words: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, raw in items:
            split = tokens(raw)
            if split:
                self.items.append((item_id, np.array([self.words.setdefault(w, len(self.words) + 1) for w in split], np.int64)))
        found: list[np.ndarray] = []
        for no, (_, ids) in enumerate(self.items):
            for mask in range(len(MASKS)) if len(ids) > SHORT else [-len(ids)]:
                h = self.hashes(ids, mask)
                found.append(np.stack([h.view(np.int64), np.full(len(h), no), np.arange(len(h))], axis=1))
        self.masks = [*range(len(MASKS)), *sorted({-len(ids) for _, ids in self.items if len(ids) <= SHORT})]
        seeds = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        order = np.argsort(seeds[:, 0], kind="stable")
        self.seeds, self.owner, self.place = seeds[order, 0], seeds[order, 1], seeds[order, 2]
        self.shift = np.uint64(64 - max(16, min(26, int(len(seeds)).bit_length() + 8)))
        self.filled = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filled[(self.seeds.view(np.uint64) >> self.shift).astype(np.int64)] = True

    @staticmethod
    def hashes(ids: np.ndarray, mask: int) -> np.ndarray:
        """One hash a start position; positions under the mask's zeros do not enter it. A negative ``mask`` is that many words in a row."""
        pattern = MASKS[mask] if mask >= 0 else "1" * -mask
        n = len(ids) - len(pattern) + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        x, h = ids.view(np.uint64), np.full(n, (mask + SHORT + 1) << 40, np.uint64)
        for i, on in enumerate(pattern):
            if on == "1":
                h = (h ^ x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def overlaps(self, raws: list[bytes]) -> list[list[tuple[int, int, int, int, int, int]]]:
        """For each text, ``item_id, doc_start, doc_end, item_start, item_end, matched`` of its best overlap with each item."""
        out: list[list[tuple[int, int, int, int, int, int]]] = []
        held, size = [], 0
        for raw in raws:
            held.append(tokens(raw))
            size += len(held[-1])
            if size >= _TOGETHER:
                out += self._together(held)
                held, size = [], 0
        return out + self._together(held)

    def _together(self, texts: list[list[bytes]]) -> list[list[tuple[int, int, int, int, int, int]]]:
        """Texts laid end to end; the unknown words between them are in no item, so no hit reaches over."""
        get, apart, flat, starts = self.words.get, [0] * len(_ODD), [], []
        for words in texts:
            starts.append(len(flat))
            flat += [get(w, 0) for w in words]
            flat += apart
        ids, owners = np.array(flat, np.int64), np.array(starts, np.int64)
        near: set[tuple[int, int, int]] = set()
        for mask in self.masks:
            h = self.hashes(ids, mask)
            at = np.flatnonzero(self.filled[(h >> self.shift).astype(np.int64)])
            if len(at):
                keys = h[at].view(np.int64)
                first, last = np.searchsorted(self.seeds, keys, "left"), np.searchsorted(self.seeds, keys, "right")
                at, first, last = (x[last > first] for x in (at, first, last))
                text = np.searchsorted(owners, at, "right") - 1
                for d, p, a, b in zip(text.tolist(), (at - owners[text]).tolist(), first.tolist(), last.tolist(), strict=True):
                    near.update((d, int(self.owner[i]), p - int(self.place[i])) for i in range(a, b))
        def parts(d: int, no: int, diagonals: set[int]) -> list[tuple[int, int, np.ndarray, int]]:
            _, item = self.items[no]
            found = []
            for diagonal in sorted(diagonals):
                start, end = max(0, -diagonal), min(len(item), len(texts[d]) - diagonal)
                if end <= start:
                    continue
                same = ids[starts[d] + start + diagonal : starts[d] + end + diagonal] == item[start:end]
                before = np.r_[0, np.cumsum(same)]
                found += [(x + start, y + start, before[x : y + 1], diagonal) for x, y in overlap_runs(same, min(len(item), LEAST_PART))]
            return found

        hit: dict[tuple[int, int], set[int]] = {}
        for d, no, diagonal in near:
            hit.setdefault((d, no), set()).add(diagonal)
        out: list[list[tuple[int, int, int, int, int, int]]] = [[] for _ in texts]
        for d, no in sorted(hit):
            item_id, item = self.items[no]
            own, least = hit[d, no], min(len(item), LEAST_WORDS)
            got = _joined(parts(d, no, own), least)
            if not got:  # a short part between two insertions has no seed of its own
                got = _joined(parts(d, no, {x + k for x in own for k in range(-MOST_SHIFT, MOST_SHIFT + 1)}), least)
            if got:
                out[d].append((item_id, *got))
        return out


def _joined(parts: list[tuple[int, int, np.ndarray, int]], least: int) -> tuple[int, int, int, int, int] | None:
    """Best overlap of ``least`` words or more, ``doc_start, doc_end, item_start, item_end, matched``: one part, or several in order on near diagonals."""
    parts = sorted(parts, key=lambda p: (p[0] + p[3], p[0]))
    longest = max((p[1] for p in parts), default=0) + MOST_SHIFT
    best, chains = None, []  # of each part the chain that ends in it: doc_start, item_start, matched
    for j, (x, y, before, diagonal) in enumerate(parts):
        own = (x + diagonal, x, int(before[-1] - before[0]))
        for i in range(j - 1, -1, -1):
            end, shift = parts[i][1], parts[i][3]
            if x + diagonal - parts[i][0] - shift > longest:
                break
            if abs(shift - diagonal) > MOST_SHIFT or shift == diagonal:
                continue
            begin = max(x, end, end + shift - diagonal)
            if begin >= y:
                continue
            doc, at, matched = chains[i]
            matched += int(before[-1] - before[begin - x])
            if matched > own[2] and 5 * matched >= 4 * max(y + diagonal - doc, y - at):
                own = (doc, at, matched)
        chains.append(own)
        span = min(y + diagonal - own[0], y - own[1])
        if span >= least and (best is None or own[2] > best[4]):
            best = (own[0], y + diagonal, own[1], y, own[2])
    return best


def overlap_runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The longest run (:func:`longest_overlap`), the longest before and after it, and so on, each of ``least`` or more."""
    found, open_ = [], [(0, len(same))]
    while open_:
        a, b = open_.pop()
        got = longest_overlap(same[a:b]) if b - a >= least and 5 * np.count_nonzero(same[a:b]) >= 4 * least else None
        if got and got[1] - got[0] >= least:
            found.append((a + got[0], a + got[1]))
            open_ += [(a, a + got[0]), (a + got[1], b)]
    return sorted(found)


def longest_overlap(same: np.ndarray) -> tuple[int, int] | None:
    """The longest run, from a match to a match, of which at least four fifths match; the first of equals."""
    ends = np.flatnonzero(same)
    if not len(ends):
        return None
    gain = np.zeros(len(same) + 1, np.int64)
    np.cumsum(np.where(same, 1, -4), out=gain[1:])
    lowest = np.minimum.accumulate(gain)  # of all starts up to here
    first = np.searchsorted(-lowest, -gain[ends + 1], "left")  # earliest start from which the run is alike enough
    starts = ends[np.searchsorted(ends, first)]  # a start at a mismatch only gains by moving on to the next match
    best = int(np.argmax(ends - starts))
    return int(starts[best]), int(ends[best]) + 1


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[SeedIndex]:
    held, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string").cast("binary")).toLocalIterator():
        raw = bytes(row[1] or b"")
        held.append((row[0], raw))
        size += len(raw) // 4 + 1
        if size >= most:
            yield SeedIndex(held)
            held, size = [], 0
    if held:
        yield SeedIndex(held)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each text and item that overlap: ids, word positions of the overlap in both, matches and their share.

    An overlap is a run of words of the item of which at least 0.8 are the same in the text, in
    one part or in several that inserted or dropped words set off from one another by up to
    ``MOST_SHIFT``; it spans ``LEAST_WORDS`` words (or the whole item if that is shorter), be
    the item as long as it may. Items of up to ``SHORT`` words are found where they occur whole
    and unchanged, items without a word nowhere. Of the overlaps of a text with one item the one
    with the most equal words counts, of equals the first in the text. Null and empty texts overlap nothing; repeated rows are compared each for itself; an empty benchmark
    or table gives an empty result. Other columns are not read.
    """
    schema = "doc_id long, item_id long, doc_start int, doc_end int, item_start int, item_end int, matched int, similarity double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [x.split()[0] for x in schema.split(", ")]
    out = rows.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, item_col, item_text, block_tokens):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(d, *o, o[5] / (o[2] - o[1])) for d, own in zip(batch.column(0).to_pylist(), index.overlaps([raw or b"" for raw in bytes_of(batch.column(1))]), strict=True) for o in own]
                if found:
                    types = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows whose text overlaps an item; columns stay as they are, null texts stay."""
    at = docs.columns.index(text_col)
    for index in _blocks(benchmark, item_col, item_text, block_tokens):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not own for own in index.overlaps([raw or b"" for raw in bytes_of(batch.column(at))])], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
