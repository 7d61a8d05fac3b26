"""Helpers shared by the training-data operators: shared storage, Arrow batches, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the classes of the query contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A hub of a graph has over a ``HUBS``-th of its edges; its edges are dealt to so many parts.
HUBS, SALTS = 1000, 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine is made and set for the session if Spark runs in
    one process (tests); on a cluster that folder would not be shared, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="provenia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage is cut and survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/provenia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stored` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver forget ended steps, so that Spark deletes their shuffle files while a long operator goes on."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor`` (null: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def _joined(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``rows`` (``u, v``) with ``m`` of their ``u`` from ``least`` (``u, m, n``: ``n`` rows have this ``u``).

    The rows of a hub are dealt to ``SALTS`` parts. A hub has over a ``HUBS``-th of the rows, so
    the list of hubs that is broadcast has that many at most.
    """
    hub = F.col("n") > max(HUBS, edges // HUBS)
    hubs = F.broadcast(least.where(hub).select("u", F.lit(True).alias("hub")))
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    own = rows.join(hubs, "u", "left").withColumn("salt", salt).drop("hub")
    return own.join(least.select("u", "m", F.explode(salts).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame | None:
    """Connected components of an undirected graph of long ids: ``node, label`` with the smallest id as label.

    Alternating large-star and small-star rounds. Both use a pre-aggregated minimum and an
    equi-join in which a hub of any degree is salted, never a collected neighbour list. Every
    round is stored, and the round before it deleted. None for no edges.
    """
    now = stored(
        edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges"
    )
    sign = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = sign(now)
    if not before[0]:
        return None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _joined(both, least, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        parent = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            _joined(large, parent, before[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(parent.select("u", F.col("m").alias("v"))).distinct()
        )
        after_df = stored(small, "edges")
        after = sign(after_df)
        done = after == before
        discard(now)
        now, before = after_df, after
        if done:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite a[i] with b[i] in an array of root labels (the smallest index of each set)."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
