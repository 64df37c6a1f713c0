"""Lifecycles of zones and crops out of event logs.

What is true of a zone or crop follows from the newest event of each kind: a patch counts while no later move, restore or
deletion undoes it. The newest of a kind is a maximum, so events may come late, repeated and in any order, on a table or
on a stream, and the result is the same: the aggregates are the state, combined before the shuffle, and no key's log is
gathered or replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.operators.zones import DETECTED, LEAST_CROP_SIDE, PATCHED, clamped, crop_sha

BOX = ("x", "y", "w", "h")


def _newest(kinds: tuple[str, ...], value: Column, name: str) -> Column:
    hit = F.col("kind").isin(*kinds)
    return F.max(F.when(hit, F.struct(F.col("seq").alias("seq"), value.alias("value")))).alias(name)


def zone_facts(events: DataFrame) -> DataFrame:
    """The newest event of each kind of each zone: the state that a stream keeps.

    ``events``: zone_id, media_id, seq, kind (detect, move, patch, restore, delete), x, y, w, h, patch_sha. A kind that isn't known has no
    effect. Of two events with one number the greater values count, so equal ones are one.
    """
    box = F.struct(*BOX)
    return events.groupBy("zone_id").agg(
        F.max(F.struct("seq", "media_id")).getField("media_id").alias("media_id"), _newest(("detect", "move"), box, "box"), _newest(("detect",), F.lit(True), "made"),
        _newest(("patch",), F.col("patch_sha"), "patch"), _newest(("restore",), F.lit(True), "restored"), _newest(("delete",), F.lit(True), "deleted"),
    )


def zone_states(facts: DataFrame) -> DataFrame:
    """zone_id, media_id, x, y, w, h (inside the image), status and patch_sha of the zones that are there.

    A zone is there from its detection until it is deleted, and again if it is detected anew. A patch goes when the zone moves after it,
    is detected anew, or is restored.
    """
    seq = lambda c: F.coalesce(F.col(f"{c}.seq"), F.lit(-1))
    alive = F.col("made").isNotNull() & (seq("made") > seq("deleted"))
    patched = (seq("patch") > seq("box")) & (seq("patch") > seq("restored")) & (seq("patch") > seq("deleted"))
    own = facts.filter(alive).select("zone_id", "media_id", "box.value.*", F.when(patched, F.col("patch.value")).alias("patch_sha"), patched.alias("patched"))
    return own.select("zone_id", "media_id", *[c.alias(k) for k, c in clamped().items()], F.when(F.col("patched"), PATCHED).otherwise(DETECTED).alias("status"), "patch_sha")


def crop_facts(events: DataFrame) -> DataFrame:
    """The newest events of each crop: ``events``: crop_id, parent_id, seq, kind (create, frame, delete), x, y, w, h in per cent."""
    return events.groupBy("crop_id").agg(
        F.max(F.struct("seq", "parent_id")).getField("parent_id").alias("parent_id"), _newest(("create", "frame"), F.struct(*BOX), "box"), _newest(("create",), F.lit(True), "made"), _newest(("delete",), F.lit(True), "deleted")
    )


def crop_states(facts: DataFrame, parents: DataFrame) -> DataFrame:
    """crop_id, parent_id, sha256, x, y, w, h, same_as of the crops that are there; ``parents``: id, sha256 as it is now.

    A crop's hash is of its parent's content and its rectangle, so it changes with either. Two crops of one hash are one: ``same_as`` is the
    least id of them. Crops whose parent is gone are gone.
    """
    seq = lambda c: F.coalesce(F.col(f"{c}.seq"), F.lit(-1))
    own = facts.filter(F.col("made").isNotNull() & (seq("made") > seq("deleted"))).select("crop_id", "parent_id", "box.value.*")
    own = own.select("crop_id", "parent_id", *[c.alias(k) for k, c in clamped(100.0, LEAST_CROP_SIDE).items()])
    own = own.join(parents.select(F.col("id").alias("parent_id"), F.col("sha256").alias("parent_sha")), "parent_id")
    own = own.withColumn("sha256", crop_sha(F.col("parent_sha"), {k: F.col(k) for k in BOX}))
    first = own.groupBy("sha256").agg(F.min("crop_id").alias("same_as"))
    return own.join(first, "sha256").select("crop_id", "parent_id", "sha256", *BOX, "same_as")


def live_measures(measures: DataFrame, crops: DataFrame) -> DataFrame:
    """Measurements (media_id, sha256 of the pixels measured, ...) that still hold: those of crops whose hash has changed since, or that are gone, are dropped."""
    return measures.join(crops.select(F.col("crop_id").alias("media_id"), "sha256"), ["media_id", "sha256"], "left_semi")


def placed(links: DataFrame, wanted: DataFrame, crops: DataFrame) -> DataFrame:
    """The sets' links (dataset_id, media_id, hidden, repeats) after crops are placed: ``wanted``: dataset_id, crop_id, mode (replace, beside).

    ``replace`` takes the parent's entry with its flags, and does nothing where the parent has none; ``beside`` adds a fresh entry. A crop
    that is linked already, isn't there, or is asked for twice, changes nothing (of two modes, ``beside`` counts).
    """
    own = wanted.groupBy("dataset_id", "crop_id").agg(F.min("mode").alias("mode")).join(crops.select("crop_id", "parent_id"), "crop_id")
    own = own.join(links.select("dataset_id", F.col("media_id").alias("crop_id")), ["dataset_id", "crop_id"], "left_anti")
    entry = links.select("dataset_id", F.col("media_id").alias("parent_id"), F.col("hidden").alias("_hidden"), F.col("repeats").alias("_repeats"))
    own = own.join(entry, ["dataset_id", "parent_id"], "left").filter((F.col("mode") == "beside") | F.col("_repeats").isNotNull())
    swap = F.col("mode") == "replace"
    new = own.select("dataset_id", F.col("crop_id").alias("media_id"), F.when(swap, F.col("_hidden")).otherwise(False).alias("hidden"), F.when(swap, F.col("_repeats")).otherwise(1).alias("repeats"))
    gone = own.filter(swap).select("dataset_id", F.col("parent_id").alias("media_id")).distinct()
    return links.join(gone, ["dataset_id", "media_id"], "left_anti").select(*new.columns).unionByName(new)


def removed(links: DataFrame, gone: DataFrame) -> DataFrame:
    """The sets' links after crops (crop_id, parent_id) are deleted: where a crop stood alone its parent comes back, with fresh flags."""
    hit = links.join(gone.select(F.col("crop_id").alias("media_id"), "parent_id").distinct(), "media_id")
    back = hit.select("dataset_id", F.col("parent_id").alias("media_id")).distinct()
    left = links.join(gone.select(F.col("crop_id").alias("media_id")).distinct(), "media_id", "left_anti").select("dataset_id", "media_id", "hidden", "repeats")
    back = back.join(left.select("dataset_id", "media_id"), ["dataset_id", "media_id"], "left_anti")
    return left.unionByName(back.select("dataset_id", "media_id", F.lit(False).alias("hidden"), F.lit(1).cast(links.schema["repeats"].dataType).alias("repeats")))
