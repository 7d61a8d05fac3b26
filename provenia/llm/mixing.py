"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import WORD_PATTERN, stored

#: Slices of the seeded order inside a source. A source is never ordered as one group, only each slice.
SLICES = 4096


def water_fill(sources: DataFrame, max_epochs: int, weights: Sequence[float]) -> DataFrame:
    """Add ``target`` to ``no_source, source, source_size``, one row a source.

    Weights are dealt in turn in code-point order of the sources, null last. A source stops at
    ``max_epochs`` times its size; what it would have had beyond goes to the others by weight
    until none is above. Sorted by cap over weight, the clamped sources are the prefix up to the
    first whose cap covers its share of what the ones before it leave over. This table has a row
    a source, so its windows need no partitions.
    """
    turn = F.row_number().over(Window.orderBy("no_source", "source")) - 1
    weighed = sources.withColumn("turn", turn).withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") % len(weights) + 1),
        "cap": F.col("source_size") * max_epochs,
    })
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    measured = weighed.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)),
        "at": F.row_number().over(by_room),
    })
    covered = F.col("cap") * F.col("open") >= F.col("weight") * F.col("left")
    first = F.min(F.when(covered, F.struct("at", "left", "open"))).over(everything)
    level = measured.withColumn("first", first)
    share = F.col("weight") * F.col("first.left") / F.col("first.open")
    return level.select("no_source", "source", "source_size", F.when(F.col("at") < F.col("first.at"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 42,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, repeats``: how many words of each row the mix takes.

    Size is the number of words; null and blank texts have 0 and are taken 0 times. All sources
    together get as many words as they hold. Each row is taken the whole number of times that
    fits its source's target, and in an order seeded by id one more time until the target is
    reached; the row that crosses it is taken in part, so a source meets its target to the word.
    No row is taken more than ``max_epochs`` times. Rows that repeat an id are mixed each for
    itself. Null is a source of its own, the last. An empty table gives an empty result; other
    columns are not read.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("s"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    ).select("doc_id", F.col("s").isNull().alias("no_source"), F.coalesce("s", F.lit("")).alias("source"), "size", order.alias("place"))
    rows = stored(rows.withColumn("slice", F.conv(F.substring("place", 1, 3), 16, 10).cast("int") % SLICES), "sizes")
    source = ["no_source", "source"]
    slices = stored(rows.groupBy(*source, "slice").agg(F.sum("size").alias("words")), "slices")
    targets = water_fill(slices.groupBy(*source).agg(F.sum("words").alias("source_size")), max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy(*source).orderBy("slice")) - F.col("words")
    starts = slices.select(*source, "slice", before.alias("before")).join(plan, source)
    inside = F.sum("size").over(Window.partitionBy(*source, "slice").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    dealt = rows.join(starts, [*source, "slice"]).withColumn("ahead", F.col("before") + inside)
    again = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("extra") - F.col("ahead")))
    taken = (F.col("whole") * F.col("size") + again).alias("taken")
    return dealt.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", taken
    ).withColumn("repeats", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0)))


def mixed_texts(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus that a plan of :func:`mix_sources` describes: the rows of ``docs`` once for each repetition, with ``epoch`` from 1 on.

    The last repetition of a row that is taken in part has its first words only, joined by a space;
    rows that are not taken are left out. Rows that repeat an id meet the plan's rows of that id in
    the order of their sizes. Null ids are one id.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    number = F.row_number().over(Window.partitionBy("_id").orderBy("_size"))
    texts = docs.select("*", F.col(id_col).cast("long").alias("_id"), size.alias("_size")).withColumn("_n", number)
    taken = plan.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken")).withColumn("_n", number).where("_taken > 0")
    both = texts.alias("t").join(taken.alias("p"), F.expr("t._id <=> p._id and t._n = p._n")).select("t.*", "p._taken")
    each = both.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.col("_size")))).alias("epoch"))
    left = (F.col("_taken") - (F.col("epoch") - 1) * F.col("_size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD_PATTERN})")), F.lit(1), left), " ")
    return each.withColumn(text_col, F.when(left < F.col("_size"), part).otherwise(F.col(text_col))).select(*docs.columns, "epoch")


#: The same mix in DuckDB's SQL, over a table or view ``documents``.
SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('42:' || coalesce(doc_id::varchar, '')) as place from documents),
s as (select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
    [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
    row_number() over (order by source nulls last) as turn from d group by source),
m as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, turn rows between unbounded preceding and 1 preceding), 0))::double as rest,
    sum(weight) over (order by cap / weight, turn rows between current row and unbounded following) as open,
    row_number() over (order by cap / weight, turn) as pos from s),
f as (select min(pos) as pos, arg_min(rest, pos) as rest, arg_min(open, pos) as open from m where cap * open >= weight * rest),
t as (select m.source, m.source_size, case when m.pos < f.pos then m.cap::double else m.weight * f.rest / f.open end as target from m, f),
p as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as whole,
    (sum(d.size) over (partition by d.source order by place, d.size rows unbounded preceding) - d.size)::bigint as ahead
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
    (whole * size + greatest(0, least(size, round(target)::bigint - whole * source_size - ahead)))::bigint as taken from p
"""
