"""Line de-duplication against a sharded minimal perfect hash of all distinct lines.

A line's key is its text without ASCII white space at both ends, A-Z lower-cased, held as a
128-bit hash. Distinct keys are dealt to shards, and each shard becomes a minimal perfect hash
(levels of bit arrays with rank counts) over compact arrays: a 64-bit fingerprint, the count of
documents, and the smallest document. Documents send the hashes of their lines past the arrays
of the shard, in a stream that holds one shard at a time; the counts say which lines are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import bytes_of, discard, map_batches, stored

#: Distinct keys of a shard, on average, and the least number of shards.
SHARD_KEYS, LEAST_SHARDS = 1 << 17, 64
#: A shard that more than a ``HOT``-th of all lines ask, and twice as many as the others (a key that very many documents hold), is shared by several tasks.
HOT = 1024
_LAST_ID = (1 << 63) - 1
_PART = "bits binary, ranks binary, sizes binary, fps binary, counts binary, firsts binary"
_COLUMNS = [x.split()[0] for x in _PART.split(", ")]


def line_key(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key; None for keys under ``least`` code points."""
    key = line.strip().lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode(errors="replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & ((1 << 64) - 1)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: position 0..n-1 for members, anything for others."""

    def __init__(self, bits: np.ndarray, ranks: np.ndarray, sizes: np.ndarray):
        self.bits, self.ranks, self.sizes = bits, ranks, sizes

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """Keys alone in a cell of a level's array settle there; the others go on to the next level."""
        rest, planes, sizes = np.arange(len(h1)), [], []
        while len(rest):
            size = -(-len(rest) * 3 // 2 // 64) * 64 + 64
            cell = _mixed(h1[rest], h2[rest], len(sizes)) % np.uint64(size)
            alone = np.bincount(cell.astype(np.int64), minlength=size) == 1
            planes.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[~alone[cell.astype(np.int64)]]
        bits = np.concatenate(planes) if planes else np.zeros(0, np.uint64)
        ranks = np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]].astype(np.uint32) if len(bits) else np.zeros(0, np.uint32)
        return cls(bits, ranks, np.array(sizes, np.int64))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Position of each key; -1 for some keys that are no members, others get a member's position."""
        found, rest, start = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(rest):
                break
            cell = _mixed(h1[rest], h2[rest], level) % np.uint64(size) + np.uint64(start)
            word, bit = (cell >> np.uint64(6)).astype(np.int64), cell & np.uint64(63)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            found[rest[hit]] = (self.ranks[word] + below)[hit]
            rest, start = rest[~hit], start + size
        return found


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``doc_id, h1, h2`` for each distinct key of each row; a null id stands last."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
            own = {k for line in (text or b"").split(b"\n") if (k := line_key(line, least))}
            keys.extend(own)
            ids.extend([doc] * len(own))
        if not keys:
            return None
        both = _halves(keys)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "h1", "h2"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, of, "doc_id long, h1 long, h2 long")


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(shard: int, rows: np.ndarray) -> pa.RecordBatch:
        h1, h2 = rows[:, 0].view(np.uint64), rows[:, 1].view(np.uint64)
        index = PerfectHash.build(h1, h2)
        at = index.find(h1, h2)
        fps, counts, firsts = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32), np.empty(len(at), np.int64)
        held = np.where(rows[:, 3] < rows[:, 4], rows[:, 2], 1)  # rows that repeat an id are one document
        fps[at], counts[at], firsts[at] = h2, np.minimum(held, (1 << 32) - 1), rows[:, 3]
        parts = [index.bits, index.ranks, index.sizes, fps, counts, firsts]
        arrays = [pa.array([shard], pa.int32()), pa.array([int(rows[:, 2].sum())], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "lines", *_COLUMNS])

    shard, held = None, []
    for batch in batches:
        of = batch.column(0).to_numpy()
        rows = np.stack([batch.column(i).to_numpy() for i in range(1, 6)], axis=1)
        cuts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if of[a] != shard:
                if held:
                    yield made(shard, np.concatenate(held))
                shard, held = int(of[a]), []
            held.append(np.ascontiguousarray(rows[a:b]))
    if held:
        yield made(shard, np.concatenate(held))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's arrays come first, then the lines sent to it, in as many batches as they take."""
    shard, index, fps, counts, firsts = None, None, None, None, None
    for batch in batches:
        of, is_line = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        cuts = np.r_[0, np.flatnonzero((of[1:] != of[:-1]) | (is_line[1:] != is_line[:-1])) + 1, len(of)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if not is_line[a]:
                part = [batch.column(6 + i)[a].as_py() for i in range(6)]
                shard = of[a]
                index = PerfectHash(np.frombuffer(part[0], np.uint64), np.frombuffer(part[1], np.uint32), np.frombuffer(part[2], np.int64))
                fps, counts, firsts = np.frombuffer(part[3], np.uint64), np.frombuffer(part[4], np.uint32), np.frombuffer(part[5], np.int64)
            elif of[a] == shard:
                doc, h1, h2 = (batch.column(i).slice(a, b - a).to_numpy() for i in (3, 4, 5))
                at = index.find(h1.view(np.uint64), h2.view(np.uint64))
                drop = (at >= 0) & (fps[at] == h2.view(np.uint64)) & (counts[at] > 1) & (firsts[at] != doc)
                if drop.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[drop]) for x in (doc, h1, h2)], names=["doc_id", "h1", "h2"])


def shards_of(keys: DataFrame) -> tuple[DataFrame, int]:
    """The index of all distinct keys (one row a shard, with the number of lines that ask it), and the number of shards."""
    seen = stored(keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "distinct")
    shards = max(LEAST_SHARDS, -(-seen.count() // SHARD_KEYS))
    rows = seen.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "n", "first", "last")
    built = stored(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_build_shards, f"shard int, lines long, {_PART}"), "shards")
    discard(seen)
    return built, shards


def lines_to_drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """``doc_id, drops``: the keys that each document loses, for those that lose any (the largest long stands for a null id)."""
    keys = line_keys(docs, id_col, text_col, least)
    index, shards = shards_of(keys)
    total = index.agg(F.sum("lines")).first()[0] or 0
    most = max(1, 2 * total // shards, total // HOT)
    tasks = F.floor(F.col("lines") / most).cast("int") + 1
    none = F.lit(None)
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"), F.lit(0).alias("is_line"), *[none.cast("long").alias(c) for c in ("doc_id", "h1", "h2")], *_COLUMNS)
    # HOT rows at most
    shared = F.broadcast(index.where(F.col("lines") >= most).select("shard", tasks.alias("tasks")))
    asking = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(shared, "shard", "left")
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("tasks", F.lit(1))).cast("int")
    lines = asking.select("shard", salt.alias("salt"), F.lit(1).alias("is_line"), "doc_id", "h1", "h2", *[none.cast("binary").alias(c) for c in _COLUMNS])
    sent = arrays.unionByName(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "is_line")
    dropped = sent.mapInArrow(_probe, "doc_id long, h1 long, h2 long")
    return dropped.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, counts: bool = False) -> DataFrame:
    """``docs`` with every repeated line dropped outside the document with the smallest id that holds it.

    Lines end at ``\\n``; a null or empty text is one empty line. Lines whose key has under
    ``least`` code points stay. A line repeated inside one document only stays, as do all
    occurrences in the smallest document. Rows that repeat an id count as one document; a null
    id is the largest. Columns and row counts stay as they are (a null text stays null); with
    ``counts`` the columns ``n_lines`` (before dropping) and ``n_dropped`` follow. An empty
    table stays empty.
    """
    drops = lines_to_drop(docs, id_col, text_col, least)
    named = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*named)
    doc, text = (named[docs.columns.index(c)] for c in (id_col, text_col))
    joined = rows.withColumn("doc_id", F.coalesce(F.col(doc).cast("long"), F.lit(_LAST_ID))).join(drops, "doc_id", "left")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        texts, h1, total, gone = bytes_of(batch.column(at)), batch.column(len(named)).to_pylist(), [], []
        for i, (raw, drop) in enumerate(zip(texts, h1, strict=True)):
            lines = (raw or b"").split(b"\n")
            total.append(len(lines))
            if drop:
                lost = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in drop}
                kept = [x for x in lines if line_key(x, least) not in lost]
                texts[i] = b"\n".join(kept)
                gone.append(len(lines) - len(kept))
            else:
                gone.append(0)
        columns = [batch.column(i) for i in range(len(named))]
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*named, "n_lines", "n_dropped"])

    types = ", ".join([*[f"{n} {t}" for n, (_, t) in zip(named, docs.dtypes, strict=True)], "n_lines long, n_dropped long"])
    out = map_batches(joined.withColumn(text, F.col(text).cast("string")).select(*named, "drops"), of, types)
    return out.toDF(*docs.columns, "n_lines", "n_dropped") if counts else out.select(*named).toDF(*docs.columns)


#: What the query on ``documents`` returns, in DuckDB's SQL.
SQL = r"""
with l as (select doc_id, row_number() over () as row_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
m as (select k.*, r.first is not null and r.first <> k.doc_id as drop_it from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (drop_it) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not drop_it), '')) as kept_sha256 from m group by doc_id
"""
