"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant, all others as
named users, and masks over what the assistant says. Speakers in ``context_speakers`` (system prompts) take no turn
as the assistant; they are rendered as they are in every perspective. DataFrame expressions only.

A conversation of any length is cut into parts of ``part_turns`` messages, so that no row holds an unbounded group.
Messages are numbered over a range-sorted table: the place within its sorted partition plus the rows of earlier
partitions that belong to the same conversation. So a conversation that holds a third of all rows is spread over
partitions, too.

Cases: a null text is an empty message; a null speaker is named ``unknown``; a null conversation id is a conversation
of its own. Messages that tie in their turn (null turns first) are ordered by speaker and text; repeated messages stay,
repeated. A conversation with context speakers alone has no perspective and gives no row. An empty table gives no rows.
Other columns are ignored, whatever their names. Template marks inside a text are broken up with a zero-width space, so
that a message can't forge a turn; marks count as part of the rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.llm.common import save

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _numbered(messages: DataFrame) -> DataFrame:
    """Adds ``nth``, a message's place in its conversation from 0."""
    keys = ["conv", "turn", "speaker", "text"]
    ranged = messages.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("pid", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    held, _ = save(ranged)  # the bounds of the ranges are sampled: both uses below must see the same table
    mine = held.groupBy("conv", "pid").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    mine = mine.select(F.col("conv").alias("_c"), F.col("pid").alias("_p"), "first", before.alias("before"))
    on = held["conv"].eqNullSafe(mine["_c"]) & (held["pid"] == mine["_p"])
    return held.join(mine, on).withColumn("nth", F.col("row") - F.col("first") + F.col("before")).drop("_c", "_p", "pid", "row", "first", "before")


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<\u200b|im_"))


def rotate(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    context_speakers: tuple[str, ...] = ("system",),
    part_turns: int = 256,
) -> DataFrame:
    """One row per conversation, perspective and part.

    Columns: conv_id, perspective, part (from 0), n_messages, rendered, masks (array of start and end in characters of
    ``rendered``, end excluded: what is learnt), n_masked (characters under masks).
    """
    m = messages.select(
        F.col(conversation).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    message = F.struct("nth", "speaker", _safe(F.col("text")).alias("text"))
    parts = (
        _numbered(m)
        .withColumn("part", F.floor(F.col("nth") / part_turns))
        .groupBy("conv", "part")
        .agg(F.sort_array(F.collect_list(message)).alias("said"))
    )
    people = m.where(~F.col("speaker").isin(*context_speakers)).select(F.col("conv").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    each = parts.join(people, parts["conv"].eqNullSafe(people["_c"]))

    def header(x: Column) -> Column:
        other = F.concat(F.lit("user name="), _safe(F.regexp_replace(x["speaker"], r"\s+", "_")))
        role = F.when(x["speaker"] == F.col("perspective"), F.lit("assistant")).when(x["speaker"].isin(*context_speakers), x["speaker"]).otherwise(other)
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    turns = F.transform("said", lambda x: F.struct(header(x).alias("head"), F.concat(x["text"], F.lit(CLOSE)).alias("body"), (x["speaker"] == F.col("perspective")).alias("own")))
    each = each.withColumn("turns", turns)
    rendered = F.concat(F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"])), "\n"), F.lit("\n"))
    span = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(span).alias("_none"), F.array().cast(span).alias("masks"))

    def step(acc: Column, x: Column) -> Column:
        begins = acc["at"] + F.length(x["head"])
        ends = begins + F.length(x["body"])
        masks = F.when(x["own"], F.array_append(acc["masks"], F.struct(begins.alias("start"), ends.alias("end")))).otherwise(acc["masks"])
        return F.struct((ends + 1).alias("at"), acc["_none"], masks.alias("masks"))

    masks = F.aggregate("turns", start, step, lambda acc: acc["masks"])
    out = each.select(F.col("conv").alias("conv_id"), "perspective", "part", F.size("turns").alias("n_messages"), rendered.alias("rendered"), masks.alias("masks"))
    total = F.aggregate("masks", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return out.withColumn("n_masked", total)
