"""Filters, joins and orders of the media library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIDEO = ("mp4", "mov", "avi", "mkv")


def live_scope(media: DataFrame, library_id: int | None = None, images_only: bool = False) -> DataFrame:
    """Neither deleted, hidden nor discarded; one library's, or images, if asked."""
    out = media.filter("not hidden and not deleted and not discarded")
    if library_id is not None:
        out = out.filter(F.col("library_id") == library_id)
    return out.filter(~F.lower("file_extension").isin(*VIDEO)) if images_only else out


def tagged(media: DataFrame, media_tag: DataFrame, names: list[str], match: str = "any") -> DataFrame:
    """Media with any, or all, of the tags. All: semi-joins in a row, which shuffle ids and prune at each step."""
    own = media_tag.select(F.col("media_id").alias("id"), "name")
    if match == "any":
        return media.join(own.filter(F.col("name").isin(*names)), "id", "left_semi")
    hits = own.filter(F.col("name").isin(*names)).groupBy("id").agg(F.countDistinct("name").alias("n")).filter(F.col("n") == len(set(names)))
    return media.join(hits, "id", "left_semi")


def untagged(media: DataFrame, media_tag: DataFrame, names: list[str]) -> DataFrame:
    return media.join(media_tag.filter(F.col("name").isin(*names)).select(F.col("media_id").alias("id")), "id", "left_anti")


def within(media: DataFrame, links: DataFrame, inside: bool = True) -> DataFrame:
    """Media that the link table (media_id) has, or has not."""
    return media.join(links.select(F.col("media_id").alias("id")), "id", "left_semi" if inside else "left_anti")


def pending(media: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Media that ``done`` (media_id) lacks; all of them by force."""
    return media if force else within(media, done, inside=False)


def order_by(sort: str, metric: str = "score") -> list[Column]:
    """The allowed orders; missing values come last in both directions, and the newest id decides."""
    column = {"quality": metric, "dimension": "area"}.get(sort.rpartition("_")[0])
    down = sort.endswith("_desc")
    if sort in ("date_asc", "date_desc"):
        return [F.col("id").desc() if down else F.col("id").asc()]
    if column is None or not sort.endswith(("_asc", "_desc")):
        raise ValueError(f"no such order: {sort}")
    return [F.col(column).isNull().asc(), F.col(column).desc() if down else F.col(column).asc(), F.col("id").desc()]


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page: a sort that keeps offset + limit rows for each task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def effective_file(files: DataFrame) -> DataFrame:
    """The oldest file that still exists of each medium: media_id, path."""
    return files.filter("present").groupBy("media_id").agg(F.min_by("path", "file_id").alias("path"))


def orphans(media: DataFrame, files: DataFrame, dataset_media: DataFrame) -> DataFrame:
    """Live media with no file, in no dataset."""
    return within(within(live_scope(media), files, inside=False), dataset_media, inside=False)


def tag_relevance(query: str) -> Column:
    """0 the name itself, 1 a prefix, 2 a suffix, 3 within; case doesn't count."""
    q, name = query.lower(), F.lower("name")
    return F.when(name == q, 0).when(name.startswith(q), 1).when(name.endswith(q), 2).otherwise(3)


def search_tags(tags: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Tags that hold ``query`` (with % and _ as wildcards): used ones first, by relevance, usage, length, name."""
    hits = tags.filter(F.col("name").ilike(f"%{query}%")).withColumn("relevance", tag_relevance(query))
    return hits.orderBy((F.col("usage") > 0).desc(), "relevance", F.col("usage").desc(), F.length("name"), "name").limit(limit)


def normalized_tag(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", "_")


def canonical_tags(tags: DataFrame, reserved: str = "library") -> DataFrame:
    """Spellings of one normalized tag: the canonical is the least name outside the reserved category, else the least."""
    key = normalized_tag(F.col("name"))
    order = F.struct((F.col("source") == reserved).alias("reserved"), "name")
    return tags.withColumn("key", key).groupBy("key").agg(F.min_by("name", order).alias("canonical"), F.countDistinct("name").alias("spellings"))
