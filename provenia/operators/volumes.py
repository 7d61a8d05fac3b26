"""Volumes that hold several acts: where each act begins and ends, and what it is called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How the first line of an act begins (A-Z in either case).
ACT_HEADERS = (
    r"^(Act|Law|Ordinance|Chapter|Regulation|Order|Notification)\s+[\d]+",
    r"^(พระราชบัญญัติ|กฎกระทรวง)",
    r"^(Undang-Undang|Peraturan)\s+",
)
#: Least font size of a header, share of the page from its top in which it stands, least pages of an act, pages of a part where no header is found.
HEADER_SIZE, HEADER_TOP, LEAST_PAGES, PART_PAGES = 14.0, 0.20, 3, 50


def acts_of_volumes(spans: DataFrame, volumes: DataFrame, extra: Sequence[str] = (), by: str = "volume") -> DataFrame:
    """``by, segment, title, start_page, end_page, fallback``: the acts of each volume, pages counted from 0.

    ``spans`` has ``by, page, no, y, height, size, text`` (lines as they stand on a page), ``volumes``
    ``by, pages``. An act begins on page 0 and wherever a large line in the top fifth of a page
    looks like a header; a volume without one is cut every 50 pages. An act of less than three
    pages belongs to the one before it. Its title is the largest line of its first page (of equal
    ones the first), or ``Segment n``.

    The spans are read for two aggregates by page; the rest handles a row for each act.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    looks = F.lit(False)
    for pattern in (*ACT_HEADERS, *extra):
        looks = looks | text.rlike(f"(?i){pattern}")
    header = (F.col("size") >= HEADER_SIZE) & (text != "") & (F.col("y") <= F.col("height") * HEADER_TOP) & looks
    page = F.col("page").cast("int")
    pages = spans.select(by, page.alias("page"), header.alias("header"), F.when((text != "") & (F.col("size") > 0), F.struct("size", (-F.col("no")).alias("no"), text.alias("text"))).alias("line"))
    pages = pages.groupBy(by, "page").agg(F.max(F.coalesce("header", F.lit(False))).alias("header"), F.max("line")["text"].alias("title"))
    found = pages.where(F.col("header") & (F.col("page") > 0)).groupBy(by).agg(F.array_sort(F.collect_set("page")).alias("found"))
    bounds = volumes.where("pages > 0").select(by, F.col("pages").cast("int").alias("pages")).join(found, by, "left")
    fallback = F.col("found").isNull()
    starts = F.when(fallback, F.sequence(F.lit(0), F.col("pages") - 1, F.lit(PART_PAGES))).otherwise(F.concat(F.array(F.lit(0)), "found"))
    bounds = bounds.select(by, "pages", fallback.alias("fallback"), starts.alias("starts"))
    parts = bounds.select(by, "fallback", F.posexplode("starts").alias("i", "start_page"), "starts", "pages")
    parts = parts.withColumn("end_page", F.coalesce(F.get("starts", F.col("i") + 1), F.col("pages")) - 1)
    kept = (F.col("i") == 0) | (F.col("end_page") - F.col("start_page") + 1 >= LEAST_PAGES)
    number = F.sum(kept.cast("int")).over(Window.partitionBy(by).orderBy("i")) - 1
    acts = parts.withColumn("segment", number).groupBy(by, "segment").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.first("fallback").alias("fallback"))
    titled = acts.join(pages.select(by, F.col("page").alias("start_page"), F.col("title").alias("_title")), [by, "start_page"], "left")
    name = F.concat(F.lit("Segment "), F.col("segment").cast("string"))
    title = F.when(F.col("fallback"), name).otherwise(F.coalesce("_title", name))
    return titled.select(by, F.col("segment").cast("int").alias("segment"), title.alias("title"), "start_page", "end_page", "fallback")
