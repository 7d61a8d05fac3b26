"""Configuration as tables: economies, the taxonomy of indicators, and where files and keys are found.

Economies are JSON files (one object each), the taxonomy one JSON array; Spark reads both, so a
thousand of them cost no more than one, and rules on them are column expressions.
"""

from __future__ import annotations

import difflib
import logging
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.operators.quality import blank, listed

log = logging.getLogger(__name__)

ECONOMY = "economy_name string, iso_code string, languages array<string>, portals array<struct<name: string, url: string>>"
INDICATOR = "indicator_id string, name string, legal_question string, probe_keywords array<string>, exclude_keywords array<string>, exclude_act_titles array<string>"
#: What codes look like, how alike a suggested name must be, and the one key that any provider may use.
ISO_CODE, LANGUAGE_CODE, ALIKE, ANY_KEY = r"^[A-Za-z]{2,3}$", r"^[a-z]{2,3}$", 0.6, "LLM_API_KEY"


class UnknownEconomy(LookupError):
    """No economy has that name or code; says which name is close."""


def economies(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, with ``iso_code`` in capitals."""
    return spark.read.json(path, schema=ECONOMY, multiLine=True).withColumn("iso_code", F.upper(F.trim(F.coalesce("iso_code", F.lit("")))))


def economy_violations() -> Column:
    """What is wrong with a row of :func:`economies`."""
    languages = F.coalesce("languages", F.array().cast("array<string>"))
    return listed(
        ((F.col("iso_code") != "") & ~F.col("iso_code").rlike(ISO_CODE), F.concat(F.lit("invalid iso_code '"), "iso_code", F.lit("'"))),
        (F.size(languages) == 0, "languages must not be empty"),
        (F.exists(languages, lambda c: ~c.rlike(LANGUAGE_CODE)), "invalid language code"),
        (F.coalesce(F.size("portals"), F.lit(0)) < 1, "at least one portal is required"),
    )


def economy(table: DataFrame, name: str) -> DataFrame:
    """The one row with that name, else with that code. Raises :class:`UnknownEconomy` with the closest name."""
    wanted = name.strip()
    by_name = F.lower("economy_name") == wanted.lower()
    found = table.where(by_name | (F.col("iso_code") == wanted.upper())).orderBy(F.when(by_name, 0).otherwise(1)).limit(1)
    if found.isEmpty():
        names = [r[0] for r in table.select("economy_name").distinct().collect()]  # a row an economy: hundreds at most
        close = difflib.get_close_matches(wanted.title(), names, n=1, cutoff=ALIKE)
        raise UnknownEconomy(f"no economy '{name}'" + (f"; did you mean '{close[0]}'?" if close else ""))
    return found


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """One row an indicator; what a file leaves out is empty."""
    rows = spark.read.json(path, schema=INDICATOR, multiLine=True).where("indicator_id is not null")
    empty = {n: F.coalesce(n, F.array().cast(t) if t.startswith("array") else F.lit("")) for n, t in rows.dtypes}
    return rows.withColumns(empty)


def with_valid_ids(rows: DataFrame, indicators: DataFrame, column: str = "indicator_id") -> DataFrame:
    """Rows whose indicator the taxonomy has."""
    return rows.join(indicators.select(F.col("indicator_id").alias(column)).distinct(), column, "left_semi")


def seeds(*tables: DataFrame) -> DataFrame:
    """All known answers (``indicator_id, act, section``) of several sources, each once. Warns where there is none."""
    rows = reduce(DataFrame.unionByName, [t.select("indicator_id", "act", "section") for t in tables]).distinct()
    if rows.isEmpty():
        log.warning("no known answers: every finding will be NEW")
    return rows


def first_file(spark: SparkSession, paths: Iterable[str]) -> str | None:
    """The first of some paths that exists, on any file system Spark reads."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path
    return None


def key_of(environment: Mapping[str, str], own: str) -> str:
    """A provider's own key, else the one for any provider, else nothing."""
    return next((k for k in (environment.get(own, "").strip(), environment.get(ANY_KEY, "").strip()) if k), "")


def checked_taxonomy() -> Column:
    """What keeps a row of :func:`taxonomy` from being used."""
    return listed((blank("indicator_id"), "indicator_id empty"), (F.size("probe_keywords") == 0, "no probe keywords"))
