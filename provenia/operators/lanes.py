"""Several pieces of work side by side, with a deadline after which what is done is kept and the rest is let go."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: A step of a lane: its name, and an action on the session (it runs Spark jobs and returns what is to be kept).
Step = tuple[str, Callable[[SparkSession], Any]]


@dataclass
class Outcome:
    """What became of a step: ``done``, ``failed``, ``interrupted`` (it ran at the deadline) or ``skipped`` (not begun by then)."""

    lane: str
    step: str
    status: str
    seconds: float = 0.0
    result: Any = None
    error: str = ""


@dataclass
class _Lane:
    name: str
    steps: Sequence[Step]
    tag: str
    outcomes: list[Outcome] = field(default_factory=list)


def run_lanes(spark: SparkSession, lanes: Mapping[str, Sequence[Step]], deadline: float, at_once: int = 4, grace: float = 30.0) -> list[Outcome]:
    """Run the steps of each lane in order, ``at_once`` lanes at a time, for ``deadline`` seconds at most.

    Every lane has a pool of its own, which shares the executors fairly where the session was
    started with ``spark.scheduler.mode=FAIR``, and a tag on its jobs. At the deadline the jobs of
    all running lanes are interrupted by tag; steps that were done keep their results. A step that
    fails does not stop its lane. A step that hangs outside Spark is waited for ``grace`` seconds.
    """
    sc, until = spark.sparkContext, time.monotonic() + deadline
    waiting = [_Lane(name, steps, f"lane-{uuid.uuid4().hex}") for name, steps in lanes.items()]
    every, lock, over = list(waiting), threading.Lock(), threading.Event()

    def step(lane: _Lane, name: str, action: Callable[[SparkSession], Any]) -> Outcome:
        began = time.monotonic()
        if over.is_set() or began >= until:
            return Outcome(lane.name, name, "skipped")
        try:
            result = action(spark)
        except Exception as e:
            status = "interrupted" if over.is_set() else "failed"
            return Outcome(lane.name, name, status, time.monotonic() - began, error=f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        return Outcome(lane.name, name, "done", time.monotonic() - began, result)

    def work() -> None:
        while True:
            with lock:
                if not waiting:
                    return
                lane = waiting.pop(0)
            sc.setLocalProperty("spark.scheduler.pool", lane.name)
            spark.addTag(lane.tag)
            try:
                for name, action in lane.steps:
                    lane.outcomes.append(step(lane, name, action))
            finally:
                spark.removeTag(lane.tag)
                sc.setLocalProperty("spark.scheduler.pool", None)

    threads = [InheritableThread(target=work, daemon=True) for _ in range(min(at_once, len(every)))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join(max(0.0, until - time.monotonic()))
    over.set()
    end = time.monotonic() + grace
    while any(t.is_alive() for t in threads) and time.monotonic() < end:
        for lane in every:
            spark.interruptTag(lane.tag)  # again: a step may have been between two jobs
        for thread in threads:
            thread.join(0.2)
    found = []
    for lane in every:
        own = list(lane.outcomes)
        for at, (name, _) in enumerate(lane.steps):
            found.append(own[at] if at < len(own) else Outcome(lane.name, name, "interrupted" if at == len(own) and lane not in waiting else "skipped"))
    return found
