"""Runs followed line by line: the state of a run folded from its log, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a line says when a stage is on, the first match counting; and the stages in order.
KEYWORDS = (
    ("Loading economy config", "config"), ("Economy config", "config"), ("Connecting to LLM", "llm_init"), ("Verifying LLM", "llm_init"),
    ("LLM ready", "llm_init"), ("LLM provider", "llm_init"), ("Loading Round 1 seed data", "seed"), ("Seed data —", "seed"), ("Zone 1 —", "discover"),
    ("Loading PDF", "discover"), ("PDF loaded", "discover"), ("Fetching —", "fetch"), ("Fetched —", "fetch"), ("Fetch failed", "fetch"),
    ("Translating", "translate"), ("Translation", "translate"), ("RAG retrieval", "rag"), ("RAG failed", "rag"), ("LLM extraction", "extract"),
    ("Validating output", "validate"), ("Validation", "validate"), ("Writing outputs", "write"), ("Outputs written", "write"),
)
STAGES = ("config", "llm_init", "seed", "discover", "fetch", "translate", "rag", "extract", "validate", "write")
#: The stage at which work on one document begins; a return to it is a new document.
EACH_DOCUMENT = "fetch"
Rules = tuple[tuple[tuple[str, str], ...], tuple[str, ...], str]
STATE = "stage int, lines long, changes long, loops long"


def advance(state: tuple[int, int, int, int], line: str, rules: Rules = (KEYWORDS, STAGES, EACH_DOCUMENT)) -> tuple[int, int, int, int]:
    """State after a line: the stage, lines seen, changes of stage, and returns to the first stage of a document."""
    (stage, lines, changes, loops), (words, stages, each) = state, rules
    name = next((s for word, s in words if word in line), None)
    at = stages.index(name) if name in stages else -1
    back = at >= 0 and name == each and stage > at
    moved = at > stage or back
    return at if moved else stage, lines + 1, changes + moved, loops + back


def fold_batch(lines: DataFrame, run: str, order: str, line: str, rules: Rules = (KEYWORDS, STAGES, EACH_DOCUMENT)) -> DataFrame:
    """``run, stage, lines, changes, loops`` of each run. Lines are sorted inside the task that folds them."""
    kind = dict(lines.dtypes)[run]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        state = (-1, 0, 0, 0)
        for x in frame.sort_values(order)[line]:
            state = advance(state, x, rules)
        return pd.DataFrame([(frame[run].iloc[0], *state)], columns=["run", "stage", "lines", "changes", "loops"])

    return lines.select(run, order, line).groupBy(run).applyInPandas(fold, f"run {kind}, {STATE}")


def fold_stream(lines: DataFrame, run: str, order: str, line: str, rules: Rules = (KEYWORDS, STAGES, EACH_DOCUMENT)) -> DataFrame:
    """The same on a stream: a row with the new state for each run that a batch touches."""
    kind = dict(lines.dtypes)[run]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (-1, 0, 0, 0)
        for frame in frames:
            for x in frame.sort_values(order)[line]:
                now = advance(tuple(int(v) for v in now), x, rules)
        state.update(now)
        yield pd.DataFrame([(*key, *now)], columns=["run", "stage", "lines", "changes", "loops"])

    return lines.select(run, order, line).groupBy(run).applyInPandasWithState(fold, f"run {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Beyond runs: counts by tumbling window. Works on streams, where ``late`` bounds the state, and on tables."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
