"""SimHash near-duplicate linking through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank and cut into small leaf groups. A group keeps the bits that
all its members share and a mask of those; upper nodes factor the shared masked patterns of the
groups below. A search of the index with itself descends pairs of nodes and drops a pair as soon
as the differences of the shared bits exceed the radius, or when both nodes already lie in one
component. Many fingerprints are first dealt to buckets of thousands, an index each: any two that
differ in at most ``radius`` bits agree on one of ``radius + 1`` blocks of bits, so on the first
bits of it. What leaves a bucket is a spanning forest, at most one edge a member, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import bytes_of, components, map_batches, merge_labels, stored

#: Members of a leaf group, and fingerprints that one index holds, about.
LEAF, BUCKET = 16, 8192
#: Rows that one call of the vectorised search takes at least, where the partition has them.
SLAB = 1 << 16
_TURN = 4096  # pairs of leaf groups compared at one go


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles, repeats included; shorter texts have one shingle, empty ones none.

    A-Z are lower-cased, words are split at ASCII white space.
    """
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(whole, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - width + 1].tolist()
    return np.array([digest(whole[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; no hashes: 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed long) of every row. A null text counts as empty, with fingerprint 0."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t or b"", width)) for t in bytes_of(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, of, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Position of a bit pattern in the Gray sequence: the xor of all its right shifts."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def bucket_masks(count: int, radius: int) -> list[int]:
    """Masks of the bits that a bucket shares, as signed longs: one for all, or the first bits of all choices of some of the blocks.

    Of ``radius + extra`` blocks any two fingerprints within the radius agree on ``extra``. As many bits are used as leave
    ``BUCKET`` fingerprints a bucket, ``extra`` is as large as those bits need.
    """
    bits = max(0, (max(1, count) - 1) // BUCKET).bit_length()
    if not bits:
        return [0]
    extra = next(e for e in range(1, 64) if 64 // (radius + e) * e >= min(bits, 32))
    bounds = [64 * i // (radius + extra) for i in range(radius + extra + 1)]
    masks = []
    for chosen in combinations(range(radius + extra), extra):
        held = [b for i in chosen for b in reversed(range(bounds[i], bounds[i + 1]))][:bits]
        m = sum(1 << b for b in held)
        masks.append(m - (1 << 64) * (m >> 63))
    return masks


def link_sorted(bucket: np.ndarray, fps: np.ndarray, radius: int, steps: list[tuple[int, int, int]] | None = None) -> np.ndarray:
    """Root index of each row: rows of one bucket (contiguous, in Gray order) within ``radius`` bits are united.

    ``steps`` gets the level, the pairs of nodes looked at and the pairs kept of every step down the indexes.
    """
    n = len(fps)
    labels = np.arange(n)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    place = np.arange(n) - np.repeat(starts, sizes)
    leaf = np.repeat(starts, sizes) + place // LEAF * LEAF
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(1, min(LEAF, int(sizes.max()))):
        near = np.flatnonzero((leaf[step:] == leaf[:-step]) & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= radius))
        if len(near):
            found.append((near, near + step))
    if found:
        labels = merge_labels(labels, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
    for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        part = slice(start, start + size)
        labels[part] = _search(fps[part], labels[part] - start, radius, steps) + start
    return labels


def _search(fps: np.ndarray, labels: np.ndarray, radius: int, steps: list[tuple[int, int, int]] | None = None) -> np.ndarray:
    """Dual descent of the index of one bucket; the leaf groups' own pairs are united already."""
    n = len(fps)
    cuts = np.arange(0, n, LEAF)
    levels = [(np.bitwise_and.reduceat(fps, cuts), np.bitwise_or.reduceat(fps, cuts))]
    while len(levels[-1][0]) > 1:
        pairs = np.arange(0, len(levels[-1][0]), 2)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], pairs), np.bitwise_or.reduceat(levels[-1][1], pairs)))
    shared = [(low, ~(low ^ high)) for low, high in levels]  # pattern, and mask of the bits all members have alike

    def uniform(level: int) -> np.ndarray:
        at = np.arange(0, n, LEAF << level)
        low, high = np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)
        return np.where(low == high, low, -1)

    def open_pairs(level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pattern, mask = shared[level]
        one = uniform(level)
        keep = (np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= radius) & ~((one[a] == one[b]) & (one[a] >= 0))
        if steps is not None:
            steps.append((level, len(a), int(keep.sum())))
        return a[keep], b[keep]

    a = b = np.zeros(1, np.int64)
    for level in range(len(levels) - 2, -1, -1):
        width = len(shared[level][0])
        left, right = np.repeat(a * 2, 4) + np.tile([0, 0, 1, 1], len(a)), np.repeat(b * 2, 4) + np.tile([0, 1, 0, 1], len(b))
        keep = (left <= right) & (right < width) & (left < width)
        left, right = left[keep], right[keep]
        own = left == right
        if level == 0:
            a, b = open_pairs(0, left[~own], right[~own])
        else:
            x, y = open_pairs(level, left[~own], right[~own])
            a, b = np.r_[left[own], x], np.r_[right[own], y]
    lanes = np.arange(LEAF)
    for at in range(0, len(a), _TURN):
        left, right = open_pairs(0, a[at : at + _TURN], b[at : at + _TURN])
        x, y = left[:, None] * LEAF + lanes, right[:, None] * LEAF + lanes
        near = np.bitwise_count(fps[np.minimum(x, n - 1)][:, :, None] ^ fps[np.minimum(y, n - 1)][:, None, :]) <= radius
        near &= (x < n)[:, :, None] & (y < n)[:, None, :]
        k, i, j = np.nonzero(near)
        if len(k):
            labels = merge_labels(labels, x[k, i], y[k, j])
    return labels


def _forest(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            change = np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)]
            root = link_sorted(np.cumsum(change), fps.view(np.uint64), radius)
            own = root != np.arange(len(fps))
            return pa.RecordBatch.from_arrays([pa.array(fps[own]), pa.array(fps[root[own]])], names=["a", "b"])

        keys, fps = np.empty((0, 4), np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)])
            fps = np.concatenate([fps, batch.column(4).to_numpy()])
            if len(fps) < SLAB:
                continue
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys[0] != keys[-1]).any() else 0
            if last:
                yield out(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(fps):
            yield out(keys, fps)

    return run


def link_fingerprints(nodes: DataFrame, radius: int = 3, max_bucket: int = 50_000) -> DataFrame:
    """Edges ``a, b`` that connect exactly what links of at most ``radius`` bits connect among distinct ``fp``.

    The number of buckets follows the number of fingerprints; the result does not depend on it.
    A bucket above ``max_bucket`` is split by its most balanced bits: two members within the
    radius differ in at most ``radius`` of these as well, so every pair of parts that near is
    searched, in tasks of their own.
    """
    count = nodes.count()
    masks = bucket_masks(count, radius)
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(table).alias("x")).select("x.t", "x.key", "fp")
    hot = rows.groupBy("t", "key").count().where(F.col("count") > max_bucket).drop("count")
    zero = F.lit(0).cast("long")
    if count > max_bucket and not hot.isEmpty():
        rows = _split_hot(rows, stored(hot, "hot"), radius, max_bucket)
    else:
        rows = rows.select("t", "key", zero.alias("low"), zero.alias("high"), "fp")
    dealt = rows.repartition("t", "key", "low", "high").sortWithinPartitions("t", "key", "low", "high", gray_rank(F.col("fp")))
    return dealt.mapInArrow(_forest(radius), "a long, b long").distinct()


def _split_hot(rows: DataFrame, hot: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{i}") for i in range(64)]
    stats = rows.join(hot, ["t", "key"]).groupBy("t", "key").agg(F.count("*").alias("n"), *ones)

    def plan(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.column(2).to_numpy()
        bits = np.stack([batch.column(3 + i).to_numpy() for i in range(64)], axis=1)
        chosen, turns = [], []
        for size, row in zip(n, bits, strict=True):
            depth = min(16, int(np.ceil(np.log2(4 * size / max_bucket))))
            best = [int(i) for i in np.argsort(np.abs(2 * row - size), kind="stable")[: max(1, depth)]]
            signed = lambda m: m - (1 << 64) * (m >> 63)
            chosen.append(signed(sum(1 << i for i in best)))
            turns.append([signed(sum(1 << i for i in c)) for k in range(radius + 1) for c in combinations(best, k)])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.int64()), pa.array(turns, pa.list_(pa.int64()))], names=["t", "key", "mask", "turns"])

    plans = stored(map_batches(stats, plan, "t int, key long, mask long, turns array<long>"), "plans")
    part = F.col("fp").bitwiseAND(F.coalesce("mask", F.lit(0).cast("long")))
    dealt = rows.join(plans, ["t", "key"], "left").select(
        "t", "key", "fp", part.alias("own"), F.explode(F.coalesce("turns", F.array(F.lit(0).cast("long")))).alias("turn")
    )
    other = F.col("own").bitwiseXOR(F.col("turn"))
    return dealt.select("t", "key", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, max_bucket: int = 50_000) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` of every row of ``docs``.

    Only the id and the text are read, so other columns of any name do no harm. Empty, blank
    and null texts have fingerprint 0 and link like any other; repeated rows come out as often
    as they came in; a row with a null id links, but never names its component (a component of
    such rows only has a null ``component_id``). An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width), "fps")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    labels = components(link_fingerprints(nodes.select("fp"), radius, max_bucket))
    if labels is None:
        named = nodes.select("fp", F.col("rep").alias("component_id"))
    else:
        held = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
        named = held.join(held.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp").select("doc_id", "fp", digits, "component_id")
