"""Multi-party dialogues rendered from each participant's view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHUNK = 256


def _open(as_role: Column, name: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), as_role, F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit(" name="), name)), F.lit("\n"))


CLOSE = "<|im_end|>\n"


def _name(speaker: Column) -> Column:
    """The speaker as a name of letters, digits, ``_`` and ``-``; where that isn't the same, with a part of its MD5, so that names differ."""
    clean = F.regexp_replace(speaker, "[^A-Za-z0-9_-]", "_")
    return F.when(clean == speaker, speaker).otherwise(F.concat(clean, F.lit("_"), F.left(F.md5(speaker), F.lit(8))))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """For every conversation and participant, the dialogue with that speaker as assistant and the others as named users.

    One row for each turn of each view: conv_id, view, turn, speaker, as_role, train, rendered (the turn's part of the
    view's text), start and end (its place there, in code points, end exclusive), mask_start and mask_end (what the
    assistant is trained on: its words and the closing mark; equal where train is false). A view's text is its rows'
    ``rendered`` in the order of ``start``. System turns are in every view and are no participant's. A null role is the
    speaker ``unknown``, a null text is empty; equal turns are ordered by speaker and text, a null turn comes first;
    repeated rows are repeated turns. Marks within a text are changed (``<|im_`` to ``<|im-``), so that none can forge a turn. A conversation of system turns alone has no views. Other columns are not read.

    A turn's place is the sum before it: of its chunk of turns (aggregated before the shuffle) and within the chunk, so no
    task gathers a long conversation.
    """
    own = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("speaker"), F.replace(F.coalesce(text_col, F.lit("")), F.lit("<|im_"), F.lit("<|im-")).alias("words")
    )
    views = own.filter(~F.col("speaker").isin(*system)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("view")).distinct()
    rows = own.join(views, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    is_system, mine = F.col("speaker").isin(*system), F.col("speaker") == F.col("view")
    as_role = F.when(is_system, F.lit("system")).when(mine, F.lit("assistant")).otherwise(F.lit("user"))
    head = _open(as_role, F.when(~is_system & ~mine, _name(F.col("speaker"))))
    rows = rows.withColumns({"size": (F.length(head) + F.length("words") + len(CLOSE)).cast("long"), "chunk": F.floor(F.col("turn") / CHUNK)})
    view = ["conv_id", "view"]
    chunks = rows.groupBy(*view, "chunk").agg(F.sum("size").alias("size"))
    before = W.partitionBy(*view).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(*[F.col(c).alias(f"_{c}") for c in (*view, "chunk")], F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    rows = rows.join(chunks, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("view") == F.col("_view")) & F.col("chunk").eqNullSafe(F.col("_chunk")))
    inside = W.partitionBy(*view, "chunk").orderBy("turn", "speaker", "words").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.withColumns({"as_role": as_role, "train": ~is_system & mine, "rendered": F.concat(head, "words", F.lit(CLOSE))})
    rows = rows.withColumns({"end": F.col("start") + F.col("size"), "mask_start": F.col("start") + F.length(head)})
    rows = rows.withColumn("mask_end", F.when(F.col("train"), F.col("end") - 1).otherwise(F.col("mask_start")))
    return rows.select("conv_id", "view", "turn", "speaker", "as_role", "train", "start", "end", "mask_start", "mask_end", "rendered")
