"""Single documents: text and headings of word-processor files, and a run over one given file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.functions import text as T

_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCX = "path string, text string, headings array<struct<level: int, title: string>>, error string"


def heading_level(style: str) -> int | None:
    """0 for a title, the number of a heading style, 1 without one; None for other styles."""
    m = re.fullmatch(r"(title)|heading\s*(\d*)(.*)", style.strip().lower())
    if not m:
        return None
    return 0 if m[1] else int(m[2]) if m[2] and not m[3] else 1


def docx_text(content: bytes) -> tuple[str, list[tuple[int, str]]]:
    """Paragraphs, then the rows of tables with `` | `` between cells; and the headings. Raises ValueError without text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_NS}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ElementTree.Element("none")
    names = {s.get(f"{_NS}styleId"): (s.find(f"{_NS}name").get(f"{_NS}val") if s.find(f"{_NS}name") is not None else "") for s in styles.iter(f"{_NS}style")}
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_NS}t")).strip()
    lines, headings = [], []
    for p in body.findall(f"{_NS}p"):
        line, style = said(p), p.find(f"{_NS}pPr/{_NS}pStyle")
        if line:
            lines.append(line)
            key = style.get(f"{_NS}val") if style is not None else ""
            level = heading_level(names.get(key, key or ""))
            headings += [(level, line)] if level is not None else []
    for row in body.iter(f"{_NS}tr"):
        cells = [c for c in map(said, row.findall(f"{_NS}tc")) if c]
        lines += [" | ".join(cells)] if cells else []
    if not lines:
        raise ValueError("no text")
    return "\n".join(lines), headings


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, headings, error`` of every file; a file that cannot be read has an error and fails nothing else."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in frame.itertuples(index=False):
                try:
                    text, headings = docx_text(content)
                    out.append((name, text, [{"level": n, "title": t} for n, t in headings], None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, ValueError) as e:
                    out.append((name, None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "headings", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, DOCX)


def title_of_file(path: Column) -> Column:
    """A title from a file's name: no ending, blanks for ``_`` and ``-``, title case."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return T.title_case(F.translate(stem, "_-", "  "))


def given_files(spark: SparkSession, path: str, economy: str) -> DataFrame:
    """``url, economy, act_title, discovery_tag, archive_url`` of files that are given instead of discovered."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"))
    return files.select("url", F.lit(economy).alias("economy"), title_of_file(F.col("url")).alias("act_title"), F.lit("KNOWN").alias("discovery_tag"), F.lit("").alias("archive_url"))
