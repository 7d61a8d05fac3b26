"""Sources: files as bytes, tables of known answers, sitemaps, results of earlier runs, versions."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenia.functions import text as T
from provenia.functions import urls as U


#: Bytes of a file that tell its kind, bytes of a file that is read whole, and names that Spark's text reader unpacks.
HEAD, WHOLE, PACKED = 512, 32 << 20, r"\.(gz|bz2|lz4|snappy|zst|deflate)$"


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, modified, length, kind`` of files, told by their first bytes.

    Larger files are read in splits, so that no task holds one whole; but for packed ones, which cannot be split.
    """
    name, length = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    large = files.where((F.col("length") > WHOLE) & ~name.rlike(PACKED)).select("path", F.col("modificationTime").alias("modified"), "length", name.alias("_at"))
    told = large.join(_heads(spark, path, pattern), "_at", "left").select("path", "modified", "length", file_kind(F.coalesce("head", F.lit(b"")), F.lit("")).alias("kind"))
    for few in (files.where(F.col("length") <= WHOLE), files.where((length > WHOLE) & name.rlike(PACKED))):
        told = told.unionByName(few.select("path", F.col("modificationTime").alias("modified"), "length", file_kind(F.col("content"), F.lit("")).alias("kind")))
    return told


def _heads(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``_at, head``: the first bytes of each large file, from the first lines of its first split."""
    name = F.col("_metadata.file_path")
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(path).where((F.col("_metadata.file_size") > WHOLE) & ~name.rlike(PACKED))
    cut = F.substring(F.col("value").cast("binary"), 1, HEAD).alias("line")
    rows = lines.select(name.alias("_at"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), cut).where("start = 0")
    first = rows.withColumn("no", F.row_number().over(Window.partitionBy("_at").orderBy("n"))).where(F.col("no") <= HEAD)
    gathered = first.groupBy("_at").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    return gathered.select("_at", F.aggregate("l", F.lit(b""), lambda got, x: F.concat(got, x["line"], F.lit(b"\n"))).alias("head"))


def file_kind(content: Column, content_type: Column) -> Column:
    """Route of a document by its first bytes, then by its declared type."""
    head = F.hex(F.substring(content, 1, 8))
    declared = F.lower(content_type)
    return (
        F.when(head.startswith("504B0304"), "DOCX").when(head.startswith("25504446"), "PDF").when(head.startswith("50415231"), "PARQUET")
        .when(head.startswith("89504E47") | head.startswith("FFD8FF"), "IMAGE")
        .when(F.contains(declared, F.lit("html")) | F.lower(F.substring(content, 1, 512).cast("string")).rlike(r"<!doctype html|<html"), "HTML")
        .when(F.contains(declared, F.lit("pdf")), "PDF").when(declared.startswith("image/"), "IMAGE").otherwise("UNKNOWN")
    )


def csv_with_mark(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header whose first name may carry a byte-order mark."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def column_like(columns: list[str], candidates: list[str]) -> str | None:
    """The first column whose lower-cased name holds the first candidate that any does."""
    return next((c for want in candidates for c in columns if want in c.lower()), None)


def sitemap_locations(maps: DataFrame, key: str, xml: str) -> DataFrame:
    """``key, pos, url``: each ``loc`` that is a page, the first of those with one normalised URL."""
    locs = maps.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), 1)).alias("pos", "url"))
    pages = locs.where(F.lower("url").startswith("http") & ~F.lower("url").endswith(".xml"))
    rank = F.row_number().over(Window.partitionBy(key, U.normalise_url(F.col("url"))).orderBy("pos"))
    return pages.withColumn("_n", rank).where("_n = 1").drop("_n")


def seed_table(rows: DataFrame, indicator: str, acts: str, references: str) -> DataFrame:
    """``indicator_id, act, section`` in long form of a sheet that packs acts and citations into cells."""
    exploded = rows.select(T.engine_id(F.col(indicator)).alias("indicator_id"), F.explode(T.split_titles(F.col(acts))).alias("title"), F.col(references).alias("cited"))
    return exploded.where("indicator_id is not null").select("indicator_id", T.normalise_title(F.col("title")).alias("act"), F.explode_outer(T.section_tokens(F.col("cited"))).alias("section")).distinct()


def newest(files: DataFrame, group: str, time: str, value: str) -> DataFrame:
    """The newest file of each group."""
    return files.groupBy(group).agg(F.max_by(value, F.struct(time, value)).alias(value))


def newest_files(spark: SparkSession, folder: str, group: str, glob: str = "*") -> DataFrame:
    """``grp, path, modified``: of the files below a folder the newest of each group, the group being what the first parentheses of ``group`` match in the name.

    Only the files' own metadata are looked at. Files with the same time: the last name counts; files that do not match are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    name, time = F.col("_metadata.file_name"), F.col("_metadata.file_modification_time")
    listed = files.select(F.regexp_extract(F.url_decode(name), group, 1).alias("grp"), F.col("_metadata.file_path").alias("path"), time.alias("modified")).where("grp != ''")
    return listed.groupBy("grp").agg(F.max(F.struct("modified", "path")).alias("f")).select("grp", "f.path", "f.modified")


def newest_rows(spark: SparkSession, folder: str, group: str, glob: str = "*.csv", **options: object) -> DataFrame:
    """The rows of the newest CSV file of each group, with its ``grp``; no other file is opened. The driver holds a path for each group."""
    chosen = {r.path: r.grp for r in newest_files(spark, folder, group, glob).collect()}
    if not chosen:
        raise FileNotFoundError(f"no file below {folder} matches {group!r}")
    read = spark.read.options(**{"header": True, "encoding": "UTF-8", "multiLine": True, "escape": '"'} | options)
    rows = read.csv([unquote(p) for p in chosen])
    rows = rows.withColumn("grp", F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), group, 1))
    return rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])


def first_valid(versions: DataFrame, key: str, date: str, valid: str, tries: int = 10) -> DataFrame:
    """The newest version that is valid among the newest ``tries`` of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))
    return versions.withColumn("_n", rank).where(F.col("_n") <= tries).where(F.col(valid)).groupBy(key).agg(F.max(date).alias(date))
