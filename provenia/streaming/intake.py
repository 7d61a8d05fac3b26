"""Logs of runs as a stream: their lines, and results stored once a batch.

A run writes its log in parts, ``<run>/<name><number>.log``, each a finished file. A part is read as
one value, so that every line has its exact place; parts are the bound of what is held at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fixed value: terminal colours and the like.
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
#: Lines of a part at most; places of lines are numbers of parts times this plus a line number.
PART_LINES = 1_000_000_000


def _lines(parts: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    named = parts.select(
        F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("run"),
        F.regexp_extract(path, r"(\d+)[^/\d]*$", 1).try_cast("long").alias("part"), F.regexp_replace("value", ANSI, "").alias("value"),
    )
    lines = named.select("run", "part", F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    return lines.where(F.trim("line") != "").select("run", (F.coalesce("part", F.lit(0)) * PART_LINES + F.col("no")).alias("seq"), "line")


def log_table(spark: SparkSession, folder: str) -> DataFrame:
    """``run, seq, line`` of all logs below a folder, blank lines left out, without terminal codes."""
    return _lines(spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.log"))


def log_stream(spark: SparkSession, folder: str, parts_a_batch: int = 1000) -> DataFrame:
    """The same as a stream: parts are taken as they appear, in the order of their times, each once."""
    reader = spark.readStream.option("maxFilesPerTrigger", parts_a_batch)
    return _lines(reader.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.log"))


def store_batches(rows: DataFrame, folder: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger: object) -> StreamingQuery:
    """Start a stream whose every batch is a folder ``batch_id=<n>`` of Parquet files below ``folder``.

    A batch that was written but not committed is written again under the same number after a
    restart, over the old files: nothing is lost or doubled. ``then`` is called with each written
    batch and its number, and must bear being called twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        path = f"{folder}/batch_id={number}"
        batch.write.mode("overwrite").parquet(path)
        if then is not None:
            then(batch.sparkSession.read.schema(batch.schema).parquet(path), number)

    writer = rows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
