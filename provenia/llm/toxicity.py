"""Toxicity by weak supervision.

Many lexicon and pattern voters look at a bounded sample of labelled rows. A generative label
model estimates each voter's accuracy by expectation maximisation, and from the voters'
residuals which of them repeat one another; correlated voters share their weight. Its posterior
labels train a linear classifier on the words and word stems of the whole text, which then
scores every text in one scan.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import map_batches, remainder, stored

#: Labelled rows that are read for training, at most.
SAMPLE_ROWS = 4000
#: Features that the classifier weighs, at most; voters that the labelled rows suggest, at most; letters of the stems.
FEATURES, SUGGESTED, STEMS = 1024, 96, (4, 5, 6, 7)
#: Rejected from this score on.
THRESHOLD = 0.7

#: Insults that are voters of their own.
LEXICON = (
    "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown dumb fool jerk "
    "garbage vermin filth ugly freak coward liar hate imbecile cretin dummkopf trottel arschloch abschaum connard "
    "crétin imbécile salaud estúpido imbécil basura escoria inútil"
).split()
#: Patterns that are voters of their own.
PATTERNS = (r"!{3,}", r"\byou (?:are|re) (?:a|an|so|such)\b", r"\b[A-Z]{4,}(?: [A-Z]{4,}){2,}\b", r"\bshut up\b", r"\bgo away\b", r"\bkill yourself\b")
_PATTERNS = [re.compile(p) for p in PATTERNS]
_WORD = re.compile(r"[^\W\d_]+")
_TURN = 512  # texts that are taken out of a batch at one go


def features(text: str) -> set[str]:
    """Distinct lower-cased words, their stems (marked ``~``; ``~2`` and ``~4`` if that many words have it), the patterns found (``#``)."""
    words = Counter(_WORD.findall(text.lower()))
    stems: dict[str, int] = {}
    for w, n in words.items():
        for k in STEMS:
            if len(w) < k:
                break
            s = w[:k]
            stems[s] = stems.get(s, 0) + n
    found = set(words)
    for s, n in stems.items():
        found.add("~" + s)
        if n > 1:
            found.add("~2" + s)
            if n > 3:
                found.add("~4" + s)
    return found | {f"#{i}" for i, p in enumerate(_PATTERNS) if p.search(text)}


class LabelModel:
    """A class prior and, for each voter and class, how likely the voter speaks; ``share`` discounts voters that repeat others."""

    def __init__(self, votes: np.ndarray, gold: np.ndarray, rounds: int = 30):
        """votes: rows by voters, 1 where it fires; gold: the given label of each row, a voter of unknown accuracy like the rest."""
        votes = np.column_stack([votes, gold]).astype(np.float64)
        n, k = votes.shape
        self.share = np.ones(k)
        posterior = np.clip(gold.astype(np.float64), 0.05, 0.95)
        for step in range(rounds):
            self.prior = float(np.clip(posterior.mean(), 1e-3, 1 - 1e-3))
            fires = np.stack([((1 - posterior) @ votes + 0.5) / ((1 - posterior).sum() + 1), (posterior @ votes + 0.5) / (posterior.sum() + 1)])
            self.fires = np.clip(fires, 1e-4, 1 - 1e-4)
            if step % 5 == 4:
                self.share = self._shares(votes, posterior)
            posterior = self.posterior(votes)
        self.labels = posterior

    def _shares(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        rest = votes - ((1 - posterior)[:, None] * self.fires[0] + posterior[:, None] * self.fires[1])
        spread = np.sqrt((rest * rest).mean(axis=0)) + 1e-9
        self.correlation = (rest.T @ rest) / len(votes) / np.outer(spread, spread)
        repeats = np.where(self.correlation > 0.3, self.correlation, 0).sum(axis=0)
        return 1 / np.maximum(repeats, 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        logit = np.log(self.prior / (1 - self.prior)) + (votes * (yes * self.share) + (1 - votes) * (no * self.share)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class ToxicityModel:
    """A linear classifier: a bias and a weight for each of a bounded number of features."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def score(self, text: str) -> float:
        get = self.weights.get
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(get(f, 0.0) for f in features(text)), -30, 30))))


def hashed(names: set[str]) -> np.ndarray:
    """The features of a text as sorted 64-bit hashes: what training holds instead of the names."""
    return np.sort(np.array([xxhash.xxh3_64_intdigest(n) for n in names], np.uint64))


def train(texts: list[np.ndarray], gold: np.ndarray) -> tuple[float, dict[int, float]]:
    """Voters, label model, then logistic regression on the posterior labels. Bias, and weights by hash of the feature."""
    n, y = len(texts), gold.astype(np.float64)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in texts])
    known, col, seen = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    col = col.astype(np.int32)
    n_yes, n_no = y.sum(), n - y.sum()
    yes = np.bincount(col, y[row], len(known))
    odds = np.log((yes + 0.5) / (n_yes + 1)) - np.log((seen - yes + 0.5) / (n_no + 1))
    marks = np.flatnonzero((yes >= 5) & (odds > 2.5))
    marks = marks[np.argsort(-yes[marks] * odds[marks], kind="stable")[:SUGGESTED]]
    given = np.flatnonzero(np.isin(known, hashed({*LEXICON, *[f"#{i}" for i in range(len(PATTERNS))]})))
    voters = np.unique(np.r_[given, marks])
    votes = np.zeros((n, len(voters) + 1))
    cast = np.isin(col, voters)
    votes[row[cast], np.searchsorted(voters, col[cast])] = 1
    votes[:, -1] = ~votes[:, :-1].any(axis=1)
    y = LabelModel(votes, gold).labels
    rate = float(y.mean())
    mass = np.bincount(col, y[row], len(known))
    telling = np.abs(mass - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1)
    chosen = np.flatnonzero((seen >= 3) & (telling > 4))
    chosen = np.sort(chosen[np.argsort(-telling[chosen], kind="stable")[:FEATURES]])
    keep = np.isin(col, chosen)
    row, col = row[keep], np.searchsorted(chosen, col[keep])
    w, b = np.zeros(len(chosen)), float(np.log(rate / (1 - rate)))
    speed_w, speed_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], n), -30, 30)))
        gw, gb = np.bincount(col, (p - y)[row], len(chosen)) + 0.1 * w, float((p - y).sum())
        speed_w += gw * gw
        speed_b += gb * gb
        w -= 0.5 * gw / np.sqrt(speed_w)
        b -= 0.2 * gb / np.sqrt(speed_b)
    return b, dict(zip(known[chosen].tolist(), w.tolist(), strict=True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled rows, drawn by a hash of the id; null labels and ids are left out.

    The drawn ids are bounded by that parameter, so they are broadcast to the texts. The driver
    holds hashes of their features; a second look at the same rows names the features that got a
    weight. Rows that repeat an id count once, with the smallest of their texts; labels that repeat
    one count as toxic if any is. Without a row of either class nothing is learned and every score is next to 0.
    """
    gold = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("gold")).where("id is not null and gold is not null")
    drawn = gold.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).groupBy("id").agg(F.max("gold").alias("gold"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(texts.join(F.broadcast(drawn), "id").groupBy("id", "gold").agg(F.min("text").alias("text")), "labelled")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [hashed(features(t or "")).tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "gold", "features"])

    sample = [(r[0], int(r[1] > 0), bytes(r[2])) for r in map_batches(rows, of, "id long, gold int, features binary").toLocalIterator()]
    sample.sort()
    y = np.array([r[1] for r in sample])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(-30.0, {})
    held = [np.frombuffer(r[2], np.uint64) for r in sample]
    del sample
    bias, weights = train(held, y)
    del held

    def names(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {n for t in batch.column(2).to_pylist() for n in features(t or "") if xxhash.xxh3_64_intdigest(n) in weights}
        return pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["name"])

    named = [r[0] for r in map_batches(rows, names, "name string").distinct().collect()]
    return ToxicityModel(bias, {n: weights[xxhash.xxh3_64_intdigest(n)] for n in sorted(named)})


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; a null text is scored like an empty one, repeated rows each for itself.

    Other columns are not read, an empty table gives an empty result.
    """

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, of, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay as they are.

    A null text is scored like an empty one, repeated rows each for itself, ids are not read. An empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _TURN):
                batch = whole.slice(start, _TURN)
                yield batch.filter(pa.array([model.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def for_training(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that training may use: crc32 of the id modulo 3 is not 1."""
    return labels.where(remainder(F.col(id_col), 3) != 1)
