"""Boxes on media: watermark zones, crops, their pixels and their synthetic content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.operators.filters import within

#: A zone's least side as a fraction of the image; a crop's in per cent.
LEAST_ZONE_SIDE, LEAST_CROP_SIDE = 0.005, 1.0
#: Statuses of a zone.
DETECTED, PATCHED = "detected", "patched"


def clamped(whole: float = 1.0, least: float = LEAST_ZONE_SIDE) -> dict[str, Column]:
    """x, y, w, h inside an image of sides ``whole``; each side has ``least`` at least, and the place gives way."""
    side = {k: F.least(F.lit(float(whole)), F.greatest(F.lit(float(least)), F.col(k))) for k in "wh"}
    place = {k: F.least(F.greatest(F.lit(0.0), F.col(k)), F.lit(float(whole)) - side[s]) for k, s in (("x", "w"), ("y", "h"))}
    return {**place, **side}


def pixel_box() -> dict[str, Column]:
    """Pixels (left, top, right, bottom) that a patch covers, grown by dilate_px, inside width x height."""

    def span(at: str, side: str, whole: str) -> tuple[Column, Column]:
        low = F.rint(F.col(at) * F.col(whole)).cast("long") - F.col("dilate_px")
        high = F.rint((F.col(at) + F.col(side)) * F.col(whole)).cast("long") + F.col("dilate_px")
        low = F.greatest(F.lit(0), F.least(low, F.col(whole) - 1))
        return low, F.greatest(low + 1, F.least(high, F.col(whole)))

    (left, right), (top, bottom) = span("x", "w", "width"), span("y", "h", "height")
    return {"left": left, "top": top, "right": right, "bottom": bottom}


def crop_sha(parent: Column, rect: dict[str, Column]) -> Column:
    """A crop's identity: its parent's hash and its rectangle, to four decimals."""
    return F.sha2(F.concat_ws("|", F.concat(F.lit("crop:"), parent), *[F.format_string(f"{k}=%.4f", rect[k]) for k in "xywh"]), 256)


def composite_sha(media: DataFrame, zones: DataFrame) -> DataFrame:
    """id and the hash of a medium with its patched zones, by zone id; media without one don't appear."""
    part = F.format_string("%d:%.5f:%.5f:%.5f:%.5f:%d:%s", "zone_id", "x", "y", "w", "h", "dilate_px", "patch_sha")
    own = zones.filter(F.col("status") == PATCHED).groupBy(F.col("media_id").alias("id"))
    parts = own.agg(F.array_sort(F.collect_list(F.struct("zone_id", part.alias("part")))).alias("parts"))
    text = F.concat_ws("|", F.concat(F.lit("compose:"), F.col("sha256")), F.array_join(F.col("parts.part"), "|"))
    return media.select("id", "sha256").join(parts, "id").select("id", F.sha2(text, 256).alias("sha"))


def statuses(zones: DataFrame) -> DataFrame:
    """media_id and detected while any zone is, else patched."""
    return zones.groupBy("media_id").agg(F.when(F.bool_or(F.col("status") == DETECTED), DETECTED).otherwise(PATCHED).alias("status"))


def watermark_tab(media: DataFrame, zones: DataFrame, tab: str) -> DataFrame:
    """Media with a detected zone (``watermarked``), or with zones of which none is (``patched``)."""
    detected = zones.filter(F.col("status") == DETECTED)
    if tab == "watermarked":
        return within(media, detected)
    if tab == "patched":
        return within(within(media, zones), detected, inside=False)
    raise ValueError(f"no such tab: {tab}")
