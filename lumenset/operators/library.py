"""Coverage, listings and rewrites of the library's link tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenset.operators.filters import normalized_tag, within

#: Floors of sharpness and cleanliness under which an image is flagged.
BLUR_FLOOR, CLEAN_FLOOR = 35.0, 45.0


def flagged(sharpness: Column, cleanliness: Column) -> Column:
    """Blurred or noisy; false for media that were never analysed. A missing cleanliness counts as 0."""
    return sharpness.isNotNull() & ((sharpness < BLUR_FLOOR) | (F.coalesce(cleanliness, F.lit(0.0)) < CLEAN_FLOOR))


def passes_static(score: Column, min_score: float, long_side: Column, min_side: int, sharpness: Column, favorite: Column | None = None) -> Column:
    """The composer's filters; what isn't known (score, side, sharpness) passes."""
    known = lambda c, ok: c.isNull() | ok
    out = known(score, score >= min_score) & known(long_side, long_side >= min_side) & known(sharpness, sharpness >= BLUR_FLOOR)
    return out & favorite if favorite is not None else out


def exclusion(score: Column, min_score: float, sharpness: Column, subject: Column, gate: float) -> Column:
    """The first reason why a candidate can't be picked: quality, blur or subject; empty for none."""
    return F.when(score < min_score, "quality").when(sharpness < BLUR_FLOOR, "blur").when(subject < gate, "subject").otherwise("")


def with_tag_sets(media_tag: DataFrame, required: list[str], excluded: list[str]) -> DataFrame:
    """media_id of media that have all of the required tags and none of the excluded, by normalized spelling."""
    name = normalized_tag(F.col("name"))
    hits = media_tag.groupBy("media_id").agg(
        F.countDistinct(F.when(name.isin(*required), name)).alias("has"), F.count_if(name.isin(*excluded)).alias("bad")
    )
    return hits.filter((F.col("has") == len(set(required))) & (F.col("bad") == 0)).select("media_id")


def tag_listing(media_tag: DataFrame) -> DataFrame:
    """media_id and its tags: those of the library first, then by name."""
    rows = F.array_sort(F.collect_set(F.struct(F.col("source").isNull().alias("later"), "name")))
    return media_tag.groupBy("media_id").agg(F.array_join(rows["name"], ", ").alias("tags"))


def provenance(media_tag: DataFrame) -> DataFrame:
    """One link for each medium and tag; a link that the library made stays the library's."""
    return media_tag.groupBy("media_id", "name").agg(F.max("source").alias("source"))


def top_tags(media_tag: DataFrame, most: int = 12) -> DataFrame:
    """The commonest tags, with the share of media that have them in per cent."""
    n = media_tag.agg(F.countDistinct("media_id").alias("all"))  # one row
    counts = media_tag.groupBy("name").agg(F.countDistinct("media_id").alias("n")).orderBy(F.col("n").desc(), "name").limit(most)
    return counts.join(F.broadcast(n), F.lit(True)).select("name", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("share"))


def step_counts(media: DataFrame, steps: dict[str, DataFrame]) -> DataFrame:
    """library_id, step, done, total: media that each step's table (media_id) has; library null: all media, once each."""
    marked = reduce(lambda df, s: df.join(s[1].select(F.col("media_id").alias("id")).distinct().withColumn(s[0], F.lit(1)), "id", "left"), steps.items(), media.select("id", "library_id"))
    sums = [F.count(s).alias(s) for s in steps]
    both = marked.groupBy("library_id").agg(F.count("*").alias("total"), *sums)
    every = marked.agg(F.lit(None).cast("long").alias("library_id"), F.count("*").alias("total"), *sums)
    return both.unionByName(every).unpivot(["library_id", "total"], list(steps), "step", "done")


def folder_tree(files: DataFrame, path: str = "rel_path", samples: int = 3) -> DataFrame:
    """folder, own and total number of files, and its first own files by name; dotted folders and what they hold don't count.

    Each file gives a row for each folder above it, counted before the shuffle.
    """
    parts = F.split(path, "/")
    rows = files.filter(~F.exists(parts, lambda p: p.startswith(".")) & (F.size(parts) > 1)).select(F.col(path).alias("path"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"), parts.alias("parts"))
    rows = rows.select("path", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("folder"), (F.col("k") == F.size("parts") - 1).alias("own"))
    place = F.row_number().over(W.partitionBy("folder").orderBy("path"))
    first = rows.filter("own").select("folder", "path").distinct().withColumn("n", place).filter(F.col("n") <= samples)
    first = first.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("samples"))
    return rows.groupBy("folder").agg(F.count_if("own").alias("own"), F.count("*").alias("total")).join(first, "folder", "left")


def merged_names(files: DataFrame) -> DataFrame:
    """file_id and its stem in a merged library: the least id keeps the stem, later ones get _2, _3 and so on."""
    n = F.row_number().over(W.partitionBy("stem").orderBy("file_id"))
    return files.select("file_id", F.when(n == 1, F.col("stem")).otherwise(F.concat_ws("_", F.col("stem"), n.cast("string"))).alias("stem"))


def purge(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables (media_id) without the rows of media that ``gone`` (media_id) names."""
    return {k: t.join(gone.select("media_id"), "media_id", "left_anti") for k, t in tables.items()}


def new_sidecars(heads: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecar captions (media_id, text) that aren't blank and differ from the head's content once both are trimmed."""
    own = heads.select("media_id", F.trim("content").alias("was"))
    both = sidecars.withColumn("text", F.trim("text")).filter("text <> ''").join(own, "media_id", "left")
    return both.filter(F.col("was").isNull() | (F.col("was") != F.col("text"))).select("media_id", "text")


def in_any(media: DataFrame, scopes: list[DataFrame]) -> DataFrame:
    """Media in at least one of the scopes (media_id)."""
    return within(media, reduce(DataFrame.unionByName, [s.select("media_id") for s in scopes]))
