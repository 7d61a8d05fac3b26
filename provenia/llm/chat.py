"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users. The rendering is columnar: a row for each perspective
and block of turns, with the text and the character spans that carry loss. Blocks bound what
any task gathers, however long a conversation is; the blocks of a perspective, in order,
concatenate to its whole rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a block, turn numbers that are counted together, and speakers that are never the assistant but keep their role.
BLOCK_TURNS, SLICE_TURNS, KEPT_ROLES = 64, 4096, ("system",)
#: The frame around a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def harmless(c: Column) -> Column:
    """Marks inside a text with a blank in them, so that no text can open or close a turn."""
    return F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "< |$1|>")


def heading(speaker: Column, perspective: Column) -> Column:
    """What stands before a turn's text: its role, and the name of a speaker who is a user."""
    role = (
        F.when(speaker.isin(*KEPT_ROLES), speaker)
        .when(speaker == perspective, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), speaker))
    )
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """``conv_id, perspective, block, text, spans, n_turns, n_trained``: each conversation as each of its speakers.

    ``spans`` holds start and end (code points, end exclusive) of the texts of the assistant's
    turns within ``text``, the closing mark included: these carry loss, all else is masked. Turns are in order of
    their number, then speaker, then text; repeated rows are repeated turns, kept in full. A turn without
    a number comes first. Turns are counted in slices of their numbers and gathered in blocks, so no
    task sorts or holds a whole conversation. Marks inside texts and names are written with a blank in
    them, line ends in names as blanks. A null speaker is the participant ``unknown``, a null text is empty,
    a null conversation is one of its own. ``system`` keeps its role and has no perspective; a
    conversation with no other speaker gives no rows. Names are not changed, so a speaker called
    ``assistant`` is a named user in the others' perspectives. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        harmless(F.translate(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")), "\r\n", "  ")).alias("speaker"),
        harmless(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
    ).withColumn("slice", F.floor(F.col("turn") / SLICE_TURNS))
    sizes = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("slice"))) - F.col("n")
    starts = sizes.select(F.col("conv_id").alias("of"), F.col("slice").alias("in"), ahead.alias("ahead"))
    order = Window.partitionBy("conv_id", "slice").orderBy(F.asc_nulls_first("turn"), "speaker", "text")
    numbered = rows.withColumn("own", F.row_number().over(order) - 1).join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("slice").eqNullSafe(F.col("in")))
    placed = numbered.withColumn("place", F.col("ahead") + F.col("own")).withColumn("block", F.floor(F.col("place") / block_turns).cast("int"))
    blocks = placed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("place", "speaker", "text"))).alias("said"))
    people = rows.where(~F.col("speaker").isin(*KEPT_ROLES)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    parts = F.transform("said", lambda t: F.struct(
        heading(t["speaker"], F.col("perspective")).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["speaker"] == F.col("perspective")).alias("on"),
    ))
    started = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        body = acc["at"] + F.length(p["head"])
        end = body + F.length(p["body"])
        span = F.array(F.struct(body.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["on"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    made = seen.withColumn("parts", parts)
    return made.select(
        "conv_id", "perspective", "block", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("parts", started, step)["spans"].alias("spans"), F.size("said").alias("n_turns"), F.size(F.filter("parts", lambda p: p["on"])).alias("n_trained"),
    )
