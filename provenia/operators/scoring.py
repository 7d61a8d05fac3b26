"""Audits and scores against known answers, null rows, cost roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Price of a thousand tokens in and out by provider, of a page by OCR engine.
TOKEN_PRICES = {"anthropic": (0.003, 0.015), "openai": (0.0025, 0.01), "gemini": (0.0003, 0.0025), "groq": (0.0, 0.0), "ollama": (0.0, 0.0)}
PAGE_PRICES = {"azure": 0.001, "mistral": 0.001}
#: Points for known answers, for each genuine new one, and at most for new ones.
KNOWN_POINTS, NEW_POINTS, NEW_MOST = 40, 4, 20
NULL_SNIPPET = "[No qualifying provision identified — assessed as no barrier]"


def llm_cost(calls: DataFrame, provider: str = "provider", tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """Add ``cost_usd``; a provider without a price costs nothing."""
    prices = calls.sparkSession.createDataFrame([(k, *v) for k, v in TOKEN_PRICES.items()], f"{provider} string, _in double, _out double")
    cost = F.col(tokens_in) / 1000 * F.coalesce("_in", F.lit(0.0)) + F.col(tokens_out) / 1000 * F.coalesce("_out", F.lit(0.0))
    return calls.join(F.broadcast(prices), provider, "left").withColumn("cost_usd", cost).drop("_in", "_out")


def recall_audit(seed: DataFrame, emitted: DataFrame) -> DataFrame:
    """``act, section, indicator_id, status``: found, act_missing or provision_missing."""
    found = emitted.where("section is not null").select("act", "section", "indicator_id").distinct().withColumn("_found", F.lit(True))
    present = emitted.select("act").distinct().withColumn("_present", F.lit(True))
    joined = seed.select("act", "section", "indicator_id").distinct().join(found, ["act", "section", "indicator_id"], "left").join(present, "act", "left")
    status = F.when(F.col("_found"), "found").when(F.col("_present").isNull(), "act_missing").otherwise("provision_missing")
    return joined.select("act", "section", "indicator_id", status.alias("status"))


def null_rows(assessed: DataFrame, found: DataFrame) -> DataFrame:
    """A no-barrier row for each assessed indicator without a finding; its law is the first title."""
    rows = assessed.groupBy("indicator_id").agg(F.min("title").alias("law_name")).join(found.select("indicator_id").distinct(), "indicator_id", "left_anti")
    return rows.select("indicator_id", F.initcap("law_name").alias("law_name"), F.lit("N/A").alias("article"), F.lit("KNOWN").alias("discovery_tag"), F.lit(NULL_SNIPPET).alias("verbatim_snippet"))


def genuine_new(rows: DataFrame, known: DataFrame) -> DataFrame:
    """NEW rows whose law and section are not known, nor the law as a whole (a known key with an empty section)."""
    number = F.regexp_extract(F.lower("article"), r"\d+", 0)
    keyed = rows.where(F.upper(F.trim("discovery_tag")) == "NEW").withColumns({
        "law_key": F.lower(F.trim(F.regexp_replace("law_name", r"\s+", " "))), "art_key": F.when(number != "", F.concat(F.lit("section "), number)).otherwise(F.lower("article")),
    })
    exact = known.select("law_key", "art_key").distinct()
    whole = known.where("art_key = ''").select("law_key").distinct()
    return keyed.join(exact, ["law_key", "art_key"], "left_anti").join(whole, "law_key", "left_anti")


def scores(known: DataFrame, engine: DataFrame, new: DataFrame, by: str = "pillar") -> DataFrame:
    """``by, known_total, known_matched, new_discovered, known_score, new_score, total_score``."""
    truth = known.select(by, "indicator_id").distinct()
    hit = truth.join(engine.select(by, "indicator_id").distinct().withColumn("_hit", F.lit(1)), [by, "indicator_id"], "left")
    counts = hit.groupBy(by).agg(F.count("*").alias("known_total"), F.sum(F.coalesce("_hit", F.lit(0))).alias("known_matched"))
    found = new.groupBy(by).agg(F.count("*").alias("new_discovered"))
    both = counts.join(found, by, "left").withColumn("new_discovered", F.coalesce("new_discovered", F.lit(0)))
    return with_points(both)


def with_points(counts: DataFrame) -> DataFrame:
    known = F.when(F.col("known_total") > 0, F.col("known_matched") / F.col("known_total") * KNOWN_POINTS).otherwise(F.lit(0.0))
    new = F.least(F.col("new_discovered") * NEW_POINTS, F.lit(NEW_MOST)).cast("double")
    return counts.withColumns({"known_score": F.round(known, 1), "new_score": F.round(new, 1), "total_score": F.round(known + new, 1)})
