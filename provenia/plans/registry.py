"""The registry of named queries: a builder, and the SQL that returns the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

BUILDERS: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its own name (or ``name``)."""

    def add(builder: Builder) -> Builder:
        key = name or builder.__name__
        BUILDERS[key] = builder
        if sql:
            SQL[key] = sql
        return builder

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the tables of a folder, pruned to the columns named.

    A table of long texts that is a single file would be read by one task or a few; its rows are
    dealt to all cores. Tables of many files, which is what large ones are, are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    if {"text", "html"} & set(df.columns) and _single_file(spark, f"{sf_dir}/{name}.parquet"):
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def _single_file(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
