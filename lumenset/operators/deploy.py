"""The deploy manifest: wanted files, differences, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest(items: DataFrame) -> DataFrame:
    """A file for each repeat of each visible item that is not missing: media_id, file, caption.

    Media with the same content have the same files; the least media_id's caption goes with each.
    """
    rows = items.filter(~F.col("hidden") & ~F.col("missing")).withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("repeats").cast("int"), F.lit(1)) - 1)))
    name = F.concat("sha256", F.when(F.col("i") > 0, F.concat(F.lit("_"), F.col("i").cast("string"))).otherwise(F.lit("")), F.lit("."), F.col("file_extension"))
    return rows.groupBy(name.alias("file")).agg(F.min("media_id").alias("media_id"), F.min_by("caption", "media_id").alias("caption")).select("media_id", "file", "caption")


def difference(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """What to write, rewrite and delete: file, action."""
    both = wanted.select("file", F.col("caption").alias("w"), F.lit(True).alias("in_w")).join(present.select("file", F.col("caption").alias("p"), F.lit(True).alias("in_p")), "file", "full")
    action = F.when(F.col("in_p").isNull(), "write").when(F.col("in_w").isNull(), "delete").when(~F.col("w").eqNullSafe(F.col("p")), "rewrite")
    return both.select("file", action.alias("action")).filter("action is not null")


def status(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """RED: no file is there; ORANGE: some are missing or have another text; GREEN: all as wanted."""
    both = wanted.join(present.select("file", F.col("caption").alias("p"), F.lit(True).alias("there")), "file", "left")
    right = F.coalesce(F.col("there") & F.col("caption").eqNullSafe(F.col("p")), F.lit(False))
    rows = both.groupBy("media_id").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("any"), F.bool_and(right).alias("all"))
    return rows.select("media_id", F.when(F.col("all"), "GREEN").when(F.col("any"), "ORANGE").otherwise("RED").alias("status"))


def target_size(width: Column, height: Column, resolution: int) -> tuple[Column, Column]:
    """The shorter side brought down to the resolution, never up; half-even rounding, 1 at least."""
    scale = F.least(F.lit(1.0), F.lit(float(resolution)) / F.least(width, height))
    return tuple(F.greatest(F.lit(1), F.bround(x * scale)).cast("long") for x in (width, height))
