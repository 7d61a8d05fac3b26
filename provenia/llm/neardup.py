"""Near-duplicate texts at a stated similarity: SimHash first, then what it cannot see by prefixes of the shingle sets.

The fingerprints of the texts' five-word shingles are linked through the Gray-order index
(:mod:`provenia.llm.simhash`), and each link is checked on the whole shingle sets. Texts at 0.8
differ in more bits than that index spans, so the rest is found exactly: the shingles of every
text are put in one order of all shingles, the common ones last. Texts that are alike have one of
their first shingles in common, so a join on these finds every pair. The texts with one such
shingle are compared with the smallest of them, then with one another as far as no link has
brought them into one group yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import bytes_of, components, discard, map_batches, release, stored
from provenia.llm.shared import Extract, held_by_several
from provenia.llm.simhash import fingerprint, link_fingerprints
from provenia.llm.words import batches_of, mixed, run_hashes

#: Words of a shingle, least similarity, bits in which linked fingerprints may differ.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 3
#: Counters of the sketch that says how common a shingle is, of one row of it, and steps in which a count doubles.
COUNTERS, COUNTERS_ROW, STEPS = 1 << 20, 1 << 14, 4


def shingle_sets(raws: list[bytes | None]) -> Iterator[np.ndarray]:
    """The distinct hashes, in order, of the runs of ``SHINGLE`` words of each text; of the whole of a shorter text; none of an empty one."""
    for _, words in batches_of(raws):
        h = run_hashes(words.hashes, SHINGLE)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            yield np.unique(h[a : b - SHINGLE + 1]) if b - a >= SHINGLE else run_hashes(words.hashes[a:b], b - a) if b > a else h[:0]


def profiles(texts: DataFrame) -> DataFrame:
    """``doc, n, whole, fp``: number of shingles, a hash of all of them, and their SimHash fingerprint."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, whole, fp = [], [], []
        for own in shingle_sets(bytes_of(batch.column(1))):
            n.append(len(own))
            whole.append(mixed(own + np.uint64(1)).sum(dtype=np.uint64))
            fp.append(fingerprint(own))
        hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (whole, fp)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), *hashes], names=["doc", "n", "whole", "fp"])

    return map_batches(texts, of, "doc long, n int, whole long, fp long")


def commonness(texts: DataFrame) -> np.ndarray:
    """A level for each of ``COUNTERS`` classes of shingles, higher for classes that more texts hold. Its size does not depend on the table."""
    rows = COUNTERS // COUNTERS_ROW

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for own in shingle_sets(bytes_of(batch.column(1))):
                np.add.at(total, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array([x.tobytes() for x in total.reshape(rows, -1)], pa.binary())], names=["row", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
                held[row] = held.get(row, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        if held:
            levels = [(STEPS * np.log2(1 + x)).astype(np.uint8).tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(levels, pa.binary())], names=["row", "levels"])

    added = texts.mapInArrow(count, "row int, counts binary").repartition(rows, "row").mapInArrow(add, "row int, levels binary")
    parts = sorted((r[0], bytes(r[1])) for r in added.collect())  # a byte a counter; an iterator would start a job for each partition
    return np.frombuffer(b"".join(x for _, x in parts), np.uint8) if parts else np.zeros(COUNTERS, np.uint8)


def least_shared(n: int, similarity: float) -> int:
    """Shingles that a text of ``n`` shares at least with any text that is alike."""
    return max(1, int(np.ceil(similarity * n - 1e-9)))


def prefixes(levels: np.ndarray, similarity: float) -> Extract:
    """The first shingles of each text in one order of all, as many as two texts that are alike cannot both lack; with the number of all and the place of each.

    Texts of ``n`` shingles that overlap by ``similarity`` share ``similarity * n`` of them at
    least, so they have one of the first ``n - similarity * n + 1`` in common, whatever the order.
    """

    def of(ids: np.ndarray, raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for doc, h in zip(ids.tolist(), shingle_sets(raws), strict=True):
            n = len(h)
            first = h[np.argsort(levels[(h % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")[: n - least_shared(n, similarity) + 1]]
            yield first, np.full(len(first), doc, np.int64), np.full(len(first), n), np.arange(len(first))

    return of


def _alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles overlap enough."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b)])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(shared >= similarity * (len(both) - shared) - 1e-9)
        mask = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["doc", "rep"])

    return map_batches(pairs, of, "doc long, rep long")


def _compared(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``doc, rep`` that are alike. Ids are stored first, so that Spark sees their size and moves only the texts asked for."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(bytes_of(batch.column(1)))], pa.binary())], names=["doc", "hashes"])

    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select("doc").unionByName(pairs.select(F.col("rep").alias("doc"))).distinct(), "asked")
    known = stored(map_batches(texts.join(ids, "doc", "left_semi"), sets, "doc long, hashes binary"), "compared")
    one = known.select("doc", F.col("hashes").alias("a"))
    two = known.select(F.col("doc").alias("rep"), F.col("hashes").alias("b"))
    found = stored(_alike(pairs.join(one, "doc").join(two, "rep").select("doc", "rep", "a", "b"), similarity), "alike")
    discard(known)
    release(texts.sparkSession)
    return found


def _possible(n: str, at: str, other_n: str, other_at: str, similarity: float) -> Column:
    """Whether texts whose first common shingle is at these places can be alike: what follows in both bounds what they share."""
    shared = F.least(F.col(n) - F.col(at), F.col(other_n) - F.col(other_at))
    return shared >= similarity * (F.col(n) + F.col(other_n) - shared) - 1e-9


def _labelled(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """With ``label``, the smallest document of the group of ``doc`` so far."""
    if groups is None:
        return rows.withColumn("label", F.col("doc"))
    return rows.join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))


def _stars(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``doc, rep`` of each text with the smallest text that has a key of it and lies in another group."""
    reps = shared.where("doc = ref").select("key", F.col("label").alias("ref_label"))
    near = shared.where("doc != ref").where(_possible("n", "at", "ref_n", "ref_at", similarity))
    return near.join(reps, "key").where("label != ref_label").select("doc", F.col("ref").alias("rep")).distinct()


def _apart(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``doc, rep`` with a key in common that are not in one group yet.

    The shorter of two alike texts has the key among its first ``n - 2s / (1 + s) * n + 1``, so
    only keys with such a row are joined, and only these rows with the longer texts.
    """
    parted = shared.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rest = stored(shared.join(parted, "key"), "rest")
    early = F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-9)
    one, two = rest.where(early).alias("one"), rest.alias("two")
    order = (F.col("one.n") < F.col("two.n")) | ((F.col("one.n") == F.col("two.n")) & (F.col("one.doc") < F.col("two.doc")))
    near = one.join(two, (F.col("one.key") == F.col("two.key")) & order & (F.col("one.label") != F.col("two.label")) & _possible("one.n", "one.at", "two.n", "two.at", similarity))
    return near.select(F.greatest("one.doc", "two.doc").alias("doc"), F.least("one.doc", "two.doc").alias("rep")).distinct()


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame | None:
    """``node, label``: the documents that have near-duplicates, and the smallest id of their group; None if there are none.

    Similarity is the Jaccard overlap of the sets of five-word shingles (A-Z and a-z alike), of
    the whole text if it is shorter; empty and null texts are copies of one another. A group is
    what links of that similarity connect. Rows that repeat an id are one document, with the
    smallest of their texts. Null ids take no part.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    if not texts.groupBy("doc").count().where("count > 1").isEmpty():
        texts = stored(texts.groupBy("doc").agg(F.min("text").alias("text")), "texts")
    spark = texts.sparkSession
    known = stored(profiles(texts), "profiles")
    copies = stored(known.groupBy("whole", "n", "fp").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")).where("rep < last").drop("last"), "copies")
    equal = stored(known.join(copies, ["whole", "n", "fp"]).where("doc != rep").select("doc", "rep"), "equal")
    gone = stored(equal.select("doc"), "gone")

    single = known.join(gone, "doc", "left_anti").where("n > 0")
    nodes = stored(single.groupBy("fp").agg(F.min("doc").alias("rep")), "nodes")
    links = link_fingerprints(nodes.select("fp"), RADIUS)
    a, b = (nodes.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}")) for x in "ab")
    hashed = links.join(a, "a").join(b, "b").select(F.greatest("rep_a", "rep_b").alias("doc"), F.least("rep_a", "rep_b").alias("rep"))
    alike = _compared(hashed.unionByName(single.join(nodes, "fp").where("doc != rep").select("doc", "rep")).distinct(), texts, similarity)

    members = held_by_several(texts, prefixes(commonness(texts), similarity), 0.04, "members")
    members = members.withColumnsRenamed({"h": "key", "p": "n", "q": "at", "ref_p": "ref_n", "ref_q": "ref_at"}).join(gone, "doc", "left_anti")
    shared = stored(_labelled(members, components(alike, "doc", "rep")), "shared")
    alike = alike.unionByName(_compared(_stars(shared, similarity), texts, similarity))
    groups = components(alike, "doc", "rep")
    if groups is not None:
        shared = stored(_labelled(shared.drop("label"), groups), "shared")
    alike = alike.unionByName(_compared(_apart(shared, similarity), texts, similarity))
    return components(equal.unionByName(alike), "doc", "rep")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id; columns stay as they are.

    Rows with a null id stay, as do rows that repeat the id of a document that stays. An empty table stays empty.
    """
    groups = duplicate_groups(docs, id_col, text_col, similarity)
    if groups is None:
        return docs
    gone = groups.where("node != label").select(F.col("node").alias("__gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
