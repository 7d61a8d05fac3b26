"""The progress of runs, told from the lines they print: stages, documents and counters.

A line is parsed by column expressions, the same for tables and streams. On a table the state of
every run follows from aggregates and windows over its parsed lines. On a stream a
``StatefulProcessor`` folds them, line by line, into a value state (counters), a map state by
stage and a map state by document; a timer reports runs that fell silent.

Both return rows ``run, item, name, status, stage, detail, time``: an item is a ``stage`` (name,
status, note, elapsed time as printed), a ``document`` (index, status, last stage, title) or a
``counter`` (name, value).

The rules: a line belongs to the stage of the first keyword in it. Its mark says whether the stage
starts, ends, fails or warns. A counter ``[i/n]`` on a line of the document loop names the
document; a change of document sets the loop's stages back to pending and ends the smaller
documents that still ran. A line of the loop ends the loop's stages before it, a line of another
stage ends all running stages before it; a warning does not undo a stage that is done.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provenia.functions import urls
from provenia.streaming.runs import KEYWORDS, STAGES

#: The stages that every document goes through, and the marks a line may begin with.
LOOP = ("fetch", "translate", "rag", "extract", "validate")
MARKS = {"→": "start", "✗": "fail", "⚠": "warn", "✓": "done"}
#: Status of a stage by the kind of its line; length of a note.
STATUS = {"start": "running", "done": "done", "warn": "warn", "fail": "fail", "info": "running"}
NOTE = 60
#: Patterns of an elapsed time at a line's end, of a document's counter, and of lines that carry counters.
ELAPSED = r"\s(\d+(?:\.\d+)?s|\d+m\s*\d+s)\s*$"
COUNTER = r"\[(\d+)/(\d+)\]"
TOTAL = r"Zone 1 complete — (\d+) document"
RECORDS = r"Outputs written — (\d+) records"
ACTS = r"Discovery complete — (\d+) act\(s\) \((\d+) KNOWN, (\d+) NEW\)"
PROVIDER = r"LLM (?:provider|ready) — ([\w.\-]+/[\w.\-:]+)"
COUNTERS = ("lines", "total_docs", "current_doc", "records", "acts_total", "acts_known", "acts_new", "provider")
ROWS = "item string, name string, status string, stage string, detail string, time string"
_FIELDS = [c.split()[0] for c in ROWS.split(", ")]
_ONCE = tuple(s for s in STAGES if s not in LOOP)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def document_label(title: Column) -> Column:
    """A title as it is; of a URL the host and the last part of its path."""
    host = F.replace(urls.host_of(title), F.lit("www."), F.lit(""))
    parts = F.filter(F.split(urls.path_of(title), "/"), lambda s: s != "")
    return F.when(title.startswith("http"), F.when(F.size(parts) > 0, F.concat(host, F.lit("/"), F.element_at(parts, -1))).otherwise(host)).otherwise(title)


def parsed(lines: DataFrame, run: str, order: str, line: str) -> DataFrame:
    """``run, seq`` and what each line says; nulls where it says nothing."""
    text = F.coalesce(F.col(line), F.lit(""))
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    stage = F.coalesce(*[F.when(text.contains(word), name) for word, name in KEYWORDS])
    kind = F.coalesce(*[F.when(body.startswith(mark), name) for mark, name in MARKS.items()], F.lit("info"))
    rows = lines.select(
        F.col(run).alias("run"), F.col(order).cast("long").alias("seq"), text.alias("text"), stage.alias("stage"), kind.alias("kind"),
        _found(body, ELAPSED).alias("time"), F.rtrim(F.regexp_replace(body, ELAPSED, "")).alias("body"),
    )
    rows = rows.withColumn("counter", F.nullif(F.regexp_extract("body", COUNTER, 0), F.lit("")))
    rows = rows.withColumn("bare", F.trim(F.when(F.col("counter").isNull(), F.col("body")).otherwise(F.replace("body", "counter", F.lit("")))))
    rows = rows.withColumn("detail", F.when(F.instr("bare", " — ") > 0, F.nullif(F.trim(F.expr("substring(bare, instr(bare, ' — ') + 3)")), F.lit(""))))
    known, number = F.col("stage").isNotNull(), lambda p, g=1: _found(F.col("text"), p, g).cast("int")
    return rows.select(
        "run", "seq", "stage", "kind", F.when(known, F.col("time")).alias("time"), F.when(known, F.col("detail")).alias("detail"),
        F.when(known, F.regexp_extract("counter", COUNTER, 1).try_cast("int")).alias("doc"), F.when(known, F.regexp_extract("counter", COUNTER, 2).try_cast("int")).alias("of"),
        number(TOTAL).alias("total"), number(RECORDS).alias("records"), *[number(ACTS, g + 1).alias(k) for g, k in enumerate(COUNTERS[4:7])], _found(F.col("text"), PROVIDER).alias("provider"),
    )


def _rows(df: DataFrame, item: str, **columns: Column) -> DataFrame:
    named = {k: F.lit(None).cast("string") for k in _FIELDS} | {"item": F.lit(item)} | columns
    return df.select("run", *[c.cast("string").alias(k) for k, c in named.items()])


def progress(lines: DataFrame, run: str, order: str, line: str) -> DataFrame:
    """The state of every run of a table of lines. ``order`` is a whole number that orders the lines of a run.

    One sort of each run's lines; everything after that is aggregation by run and stage or document.
    A null line counts as a line that says nothing; a null run is a run of its own.
    """
    own = Window.partitionBy("run").orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    index = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(STAGES))):
        index = F.when(F.col("stage") == s, i).otherwise(index)
    rows = parsed(lines, run, order, line).withColumn("at", index).withColumn("loop", F.col("stage").isin(*LOOP))
    rows = rows.withColumn("doc_now", F.when(F.col("loop"), F.col("doc")))
    rows = rows.withColumn("doc_was", F.coalesce(F.last("doc_now", True).over(before), F.lit(0)))
    later = F.lit(None).cast("long")  # the last line before this one of a later stage outside the loop
    for i, s in enumerate(STAGES):
        if s in _ONCE:
            later = F.when(F.col("at") == i, F.max(F.when((F.col("at") > i) & ~F.col("loop"), F.col("seq"))).over(before)).otherwise(later)
    rows = rows.withColumn("later", later).withColumn("change", F.coalesce(F.col("doc_now") != F.col("doc_was"), F.lit(False)))
    rows = rows.withColumn("strong", F.when(F.col("loop") | (F.col("kind") != "warn"), F.col("seq")))
    rows = rows.withColumn("since", F.coalesce(F.max("strong").over(Window.partitionBy("run", "stage").orderBy("seq")), F.lit(-1)))

    # Of each run: its counters, where the last change of document was, the last line of each stage.
    seq = F.col("seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c)
    total_at = F.max(F.when(F.col("total").isNotNull(), seq)).over(own)
    said = rows.withColumn("_t", F.struct(F.coalesce(total_at, F.lit(-1)).alias("t"), F.coalesce("total", "of", F.lit(0)).alias("n")))
    ends = {f"end_{s}": F.max(F.when(F.col("stage") == s, seq)) for s in STAGES}
    runs = said.groupBy("run").agg(
        F.count("*").alias("lines"), F.max("_t")["n"].alias("total_docs"), F.max(F.when(F.col("change"), seq)).alias("reset"),
        F.max_by("doc_now", F.when(F.col("doc_now").isNotNull(), seq)).alias("current_doc"), *[last(c) for c in COUNTERS[3:]], *[c.alias(k) for k, c in ends.items()],
    ).withColumn("current_doc", F.coalesce("current_doc", F.lit(0)))

    # Of each stage: the line since which its state counts, and the first warning after it.
    groups = rows.where("stage is not null").groupBy("run", "stage", "since").agg(
        F.max_by("kind", "strong").alias("kind"), F.min(F.when(~F.col("loop") & (F.col("kind") == "warn"), F.struct("seq", "later"))).alias("warned")
    )
    stages = groups.groupBy("run", "stage").agg(F.max_by(F.struct("since", "kind", "warned"), "since").alias("g")).select("run", "stage", "g.*")
    reset, status = F.col("reset"), F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    said_of = rows.where("stage is not null").withColumn("fresh", F.when(~F.col("change"), seq))
    notes = said_of.groupBy("run", "stage").agg(*[
        F.max_by(F.struct("fresh", c), F.when(F.col(c).isNotNull() & F.col("fresh").isNotNull(), seq)).alias(c) for c in ("detail", "time")
    ])
    every = runs.select("run", "reset", *ends, F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])).alias("s"))
    every = every.select("run", "reset", *ends, "s.*")
    by_run = [F.expr(f"stages.{k} <=> every.{k}") for k in ("run", "stage")]
    every = every.alias("every").join(stages.alias("stages"), by_run, "left").select("every.*", "since", "kind", "warned")
    every = every.alias("every").join(notes.alias("stages"), by_run, "left").select("every.*", "detail", "time")
    over = lambda inner: F.greatest(F.lit(-1), *[
        F.when(F.col("at") < i, F.col(f"end_{s}")) for i, s in enumerate(STAGES) if (s in LOOP) == inner
    ])
    base = F.when(reset.isNotNull() & F.coalesce(F.col("since") < reset, F.lit(True)), "pending").when(F.col("kind") == "fail", "warn").otherwise(status[F.col("kind")])
    begun = F.when(base == "pending", reset - 1).otherwise(F.coalesce("since", F.lit(-1)))
    inside = F.when((F.coalesce(base, F.lit("pending")).isin("pending", "running")) & (over(True) > begun), "done").when((base == "running") & (over(False) > begun), "done").otherwise(base)
    was = status[F.col("kind")]
    at_warning = (was == "done") | ((was == "running") & F.coalesce(F.col("warned.later") > F.col("since"), F.lit(False)))
    outside = F.when(F.col("warned").isNotNull(), F.when(at_warning, "done").otherwise("warn")).when((was == "running") & (over(False) > F.col("since")), "done").otherwise(was)
    in_loop = F.col("stage").isin(*LOOP)
    fresh = lambda c: F.when(~in_loop | reset.isNull() | (F.col(f"{c}.fresh") > reset), F.col(f"{c}.{c}"))
    every = every.withColumn("status", F.when(in_loop, inside).otherwise(outside))
    of_stages = _rows(every.where("status is not null"), "stage", name=F.col("stage"), status=F.col("status"), detail=F.substring(fresh("detail"), 1, NOTE), time=fresh("time"))

    # Of each document: what its own lines said, and whether a larger one came after it.
    own_lines = rows.where("doc_now is not null").withColumn(
        "told", F.when(F.col("kind") == "fail", "warn").when((F.col("stage") == "validate") & (F.col("kind") == "done"), "done")
    )
    titled = (F.col("stage") == "fetch") & F.col("kind").isin("start", "done") & F.col("detail").isNotNull()
    docs = own_lines.groupBy("run", F.col("doc_now").alias("doc")).agg(
        F.min("seq").alias("first"), F.max(F.when(F.col("change"), seq)).alias("came"), F.max_by("stage", "seq").alias("stage"),
        F.max_by("told", F.when(F.col("told").isNotNull(), seq)).alias("told"), F.max_by("detail", F.when(titled, seq)).alias("title"),
    )
    larger = Window.partitionBy("run").orderBy(F.desc("doc")).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("left", F.coalesce(F.max("came").over(larger) > F.col("first"), F.lit(False)))
    of_docs = _rows(
        docs, "document", name=F.col("doc"), status=F.coalesce("told", F.when(F.col("left"), "done").otherwise("running")), stage=F.col("stage"),
        detail=F.coalesce(document_label(F.col("title")), F.lit("")),
    )
    told = runs.select("run", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in COUNTERS])).alias("c")).select("run", "c.*")
    return of_stages.unionByName(of_docs).unionByName(_rows(told.where("value is not null"), "counter", name=F.col("name"), detail=F.col("value")))


def _fold(row: Row, run: dict, stages: dict[str, list], docs: dict[int, list]) -> None:
    """One parsed line into the state: ``stages`` has status, note and time, ``docs`` has title, stage and status."""
    run["lines"] += 1
    for name in COUNTERS[3:]:
        if row[name] is not None:
            run[name] = row[name]
    if row.total is not None:
        run["total_docs"] = row.total
    if row.stage is None:
        return
    if row.of is not None:
        run["total_docs"] = max(run["total_docs"], row.of)
    own = stages.setdefault(row.stage, [None, None, None])
    if row.time is not None:
        own[2] = row.time
    if row.detail is not None:
        own[1] = row.detail[:NOTE]
    at, status = STAGES.index(row.stage), STATUS[row.kind]
    if row.stage not in LOOP:
        for s in STAGES[:at]:
            if s in stages and stages[s][0] == "running":
                stages[s][0] = "done"
        if not (row.kind == "warn" and own[0] == "done"):
            own[0] = status
        return
    if row.doc is not None:
        if row.doc != run["current_doc"]:
            for s in LOOP:
                stages[s] = ["pending", None, None]
            for index, doc in docs.items():
                if index < row.doc and doc[2] == "running":
                    doc[2] = "done"
            run["current_doc"] = row.doc
        doc = docs.setdefault(row.doc, ["", row.stage, "running"])
        doc[1] = row.stage
        if row.label is not None:
            doc[0] = row.label
        if row.kind == "fail":
            doc[2] = "warn"
        elif row.stage == "validate" and row.kind == "done":
            doc[2] = "done"
    for s in STAGES[STAGES.index(LOOP[0]) : at]:
        mine = stages.setdefault(s, [None, None, None])
        if mine[0] in (None, "pending", "running"):
            mine[0] = "done"
    stages[row.stage][0] = "warn" if row.kind == "fail" else status


class ProgressProcessor(StatefulProcessor):
    """Keeps a run's counters, stages and documents, and reports what a batch of its lines changed.

    With ``silent_ms`` a run that gets no line for so long is reported once with the counter ``phase`` = ``silent``.
    """

    def __init__(self, silent_ms: int | None = None) -> None:
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "lines long, total_docs int, current_doc int, records int, acts_total int, acts_known int, acts_new int, provider string")
        self.stages = handle.getMapState("stages", "stage string", "status string, note string, time string")
        self.docs = handle.getMapState("docs", "doc int", "title string, stage string, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        run = dict(zip(COUNTERS, self.run.get(), strict=True)) if self.run.exists() else dict.fromkeys(COUNTERS) | {"lines": 0, "total_docs": 0, "current_doc": 0}
        stages = {k[0]: list(v) for k, v in self.stages.iterator()}
        docs = {k[0]: list(v) for k, v in self.docs.iterator()}
        old = dict(run), {k: tuple(v) for k, v in stages.items()}, {k: tuple(v) for k, v in docs.items()}
        for row in sorted(rows, key=lambda r: r.seq):
            _fold(row, run, stages, docs)
        self.run.update(tuple(run[c] for c in COUNTERS))
        report = lambda **values: Row("run", *_FIELDS)(key[0], *[values.get(k) for k in _FIELDS])
        for name in COUNTERS:
            if run[name] is not None and (run[name] != old[0][name] or not old[0]["lines"]):
                yield report(item="counter", name=name, detail=str(run[name]))
        for name, state in stages.items():
            if tuple(state) != old[1].get(name):
                self.stages.updateValue((name,), tuple(state))
                yield report(item="stage", name=name, status=state[0], detail=state[1], time=state[2])
        for index, state in docs.items():
            if tuple(state) != old[2].get(index):
                self.docs.updateValue((index,), tuple(state))
                yield report(item="document", name=str(index), status=state[2], stage=state[1], detail=state[0])
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        yield Row("run", *_FIELDS)(key[0], "counter", "phase", None, None, "silent", None)

    def close(self) -> None:
        pass


def progress_stream(lines: DataFrame, run: str, order: str, line: str, silent_ms: int | None = None) -> DataFrame:
    """The same on a stream (update mode): rows for what each batch changed; the last row of a run's item is its state.

    The lines of a run must come in order from batch to batch; within a batch they are sorted.
    Needs the RocksDB state store (:func:`use_rocksdb`).
    """
    rows = parsed(lines, run, order, line)
    titled = (F.col("stage") == "fetch") & F.col("kind").isin("start", "done") & F.col("detail").isNotNull()
    rows = rows.withColumn("label", F.when(titled, document_label(F.col("detail"))))
    kind = dict(rows.dtypes)["run"]
    mode = "None" if silent_ms is None else "ProcessingTime"
    return rows.groupBy("run").transformWithState(ProgressProcessor(silent_ms), f"run {kind}, {ROWS}", "Update", mode)


def use_rocksdb(spark: object) -> None:
    """Let the session keep stream states in RocksDB, which map states and timers need; states larger than memory go to disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest(reports: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The state of runs from stored reports of :func:`progress_stream`: of each item the row of the last batch."""
    columns = [c for c in reports.columns if c not in ("run", "item", "name", batch)]
    last = reports.groupBy("run", "item", "name").agg(F.max_by(F.struct(*columns), batch).alias("x"))
    return last.select("run", "item", "name", "x.*")
