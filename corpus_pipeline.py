"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.llm import toxicity
from provenia.llm.common import stored
from provenia.llm.decontaminate import drop_contaminated
from provenia.llm.lines import dedup_lines
from provenia.llm.mixing import mix_sources, mixed_texts
from provenia.llm.neardup import drop_near_duplicates

#: Models are trained, so SQL cannot say what the rows are.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    labels = toxicity.for_training(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that an earlier one has; ``n_chars`` follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_copies),
    ("benchmark", drop_benchmark),
    ("mixing", mix),
]


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages but the last keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, cleaned(spark, sf_dir), sf_dir)


def write_corpus(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Write the corpus itself to ``folder``: the cleaned texts, each as often as the mix takes it, with ``epoch``. Returns the mix's plan."""
    docs = cleaned(spark, sf_dir)
    plan = stored(STAGES[-1][1](spark, docs, sf_dir), "plan")
    mixed_texts(docs, plan).write.parquet(folder)
    return plan
