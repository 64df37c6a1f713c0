"""Caption versions: each change gives the changed tables anew, as nothing is written in place.

``captions`` has caption_id and head, ``pins`` caption_id, mode and revision_id for one dataset, ``revisions`` caption_id,
revision_id and content, and parent where it is known. A change names each caption once; captions that it names and that
don't exist are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenset.operators.captions import effective, unused_revisions


def saved(edits: DataFrame, captions: DataFrame, pins: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new revisions, captions, pins) after edits (caption_id, scope, content).

    Scope ``type`` puts a revision on the head, which moves to it; a dataset without a pin follows it from then on. Scope
    ``dataset`` branches from the pinned revision, or from the head without one, and pins the new one. A new revision's
    number is the caption's greatest plus one.
    """
    last = revisions.groupBy("caption_id").agg((F.max("revision_id") + 1).alias("revision_id"))
    pinned = pins.select("caption_id", F.col("mode").alias("was"), F.col("revision_id").alias("pin"))
    own = edits.join(captions, "caption_id").join(last, "caption_id").join(pinned, "caption_id", "left")
    branch = F.col("scope") == "dataset"
    own = own.withColumn("parent", F.when(branch & (F.col("was") == "pinned"), F.coalesce("pin", "head")).otherwise(F.col("head")))
    new = own.select("caption_id", "revision_id", "parent", "content")
    moved = own.filter(~branch).select("caption_id", F.col("revision_id").alias("new"))
    heads = captions.join(moved, "caption_id", "left").select("caption_id", F.coalesce("new", "head").alias("head"))
    follow = own.filter(~branch & F.col("was").isNull()).select("caption_id", F.lit("follow").alias("mode"), F.lit(None).cast("long").alias("revision_id"))
    changed = own.filter(branch).select("caption_id", F.lit("pinned").alias("mode"), "revision_id").unionByName(follow)
    return new, heads, assigned(changed, pins)


def assigned(changes: DataFrame, pins: DataFrame) -> DataFrame:
    """The pins after changes (caption_id, mode, revision_id), which replace those of the same captions."""
    kept = pins.join(changes.select("caption_id"), "caption_id", "left_anti")
    return kept.select("caption_id", "mode", "revision_id").unionByName(changes.select("caption_id", "mode", "revision_id"))


def amended(edits: DataFrame, captions: DataFrame, pins: DataFrame, revisions: DataFrame) -> DataFrame:
    """The revisions with the text in force of each caption in edits (caption_id, content) overwritten."""
    now = effective(captions, pins, revisions).join(edits.select("caption_id", F.col("content").alias("new")), "caption_id").select("caption_id", "revision_id", "new", F.lit(True).alias("hit"))
    own = revisions.join(now, ["caption_id", "revision_id"], "left")
    return own.withColumn("content", F.when(F.col("hit"), F.col("new")).otherwise(F.col("content"))).drop("new", "hit")


def pruned(captions: DataFrame, pins: DataFrame, revisions: DataFrame) -> DataFrame:
    """The revisions that are a head or pinned; a parent that goes becomes null."""
    gone = unused_revisions(captions, pins, revisions).select("caption_id", "revision_id")
    kept = revisions.join(gone, ["caption_id", "revision_id"], "left_anti")
    lost = gone.select("caption_id", F.col("revision_id").alias("parent"), F.lit(True).alias("lost"))
    return kept.join(lost, ["caption_id", "parent"], "left").withColumn("parent", F.when(F.col("lost").isNull(), F.col("parent"))).drop("lost")
