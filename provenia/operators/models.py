"""Models in the plan: loaded once a Python worker, fed with whole batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Texts scored in one call of a model.
BATCH = 64


class Embedder(Protocol):
    """Vectors of texts, a row each."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class CrossEncoder(Protocol):
    """How well each text answers the question beside it."""

    def score(self, questions: list[str], texts: list[str]) -> np.ndarray: ...


def _texts(values: np.ndarray) -> list[str]:
    return ["" if v is None else str(v) for v in values]


def embedded(text: Column, load: Callable[[], Embedder], batch: int = BATCH, unit: bool = True) -> Column:
    """Vectors of a text column. ``load`` runs once in each Python worker, which serves task after task; a null text counts as empty.

    With ``unit`` vectors are divided by their length, so that inner products are cosines; a zero vector stays.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            vectors = np.asarray(model.encode(_texts(texts)), np.float64)
            if unit:
                length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
                vectors = vectors / np.where(length > 0, length, 1)
            return vectors

        return predict

    return predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch)(F.coalesce(text, F.lit("")))


def cross_scored(question: Column, text: Column, load: Callable[[], CrossEncoder], batch: int = BATCH) -> Column:
    """Score of each pair of question and text, loaded and batched in the same way."""

    def make() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        model = load()
        return lambda questions, texts: np.asarray(model.score(_texts(questions), _texts(texts)), np.float64)

    return predict_batch_udf(make, return_type=DoubleType(), batch_size=batch)(F.coalesce(question, F.lit("")), F.coalesce(text, F.lit("")))


def reranked(candidates: DataFrame, by: list[str], question: str, text: str, load: Callable[[], CrossEncoder], key: str = "seq", k: int = 15) -> DataFrame:
    """The best ``k`` candidates of each scope by a model; ties keep the order they came in (``rank``). Each different pair is scored once."""
    pairs = candidates.select(question, text).distinct()
    scored = pairs.withColumn("rerank_score", cross_scored(F.col(question), F.col(text), load))
    same = F.col(f"c.{question}").eqNullSafe(F.col(f"s.{question}")) & F.col(f"c.{text}").eqNullSafe(F.col(f"s.{text}"))
    rows = candidates.withColumnRenamed("rank", "came").alias("c").join(scored.alias("s"), same).select("c.*", "s.rerank_score")
    order = Window.partitionBy(*by).orderBy(F.desc("rerank_score"), "came", key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
