"""Listings, states and rewrites of the library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def discarded(media: DataFrame) -> DataFrame:
    """Media that were discarded and not deleted."""
    return media.filter(F.col("discarded") & ~F.col("deleted"))


def caption_target(extension: Column, present: Column, caption: Column) -> Column:
    """``ok`` where a caption can be scored, else why not: video, missing, empty. Null counts as missing and as empty."""
    blank = F.trim(F.coalesce(caption, F.lit(""))) == ""
    return F.when(extension == "mp4", "video").when(~F.coalesce(present, F.lit(False)), "missing").when(blank, "empty").otherwise("ok")


def zones_of(zones: DataFrame) -> DataFrame:
    """A row for each medium with zones: their number and ids, ascending."""
    return zones.groupBy("media_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("zone_id")).alias("zone_ids"))


def dominant_tag(media_tag: DataFrame) -> DataFrame:
    """One row: the tag of most media (ties: the first by name) and its share of all tagged media, in percent."""
    counts = media_tag.groupBy("name").agg(F.countDistinct("media_id").alias("n"))
    best = counts.agg(F.max(F.col("n")).alias("n")).join(counts, "n").agg(F.min("name").alias("name"), F.max("n").alias("n"))
    every = media_tag.agg(F.countDistinct("media_id").alias("every"))
    return best.join(F.broadcast(every), F.lit(True)).filter("every > 0").select("name", "n", F.bround(100.0 * F.col("n") / F.col("every"), 4).alias("share"))


def candidate_order(sort: str) -> list[Column]:
    """The order of candidates: by gain or score, greatest first (no score: last), or by name; ties by lower-cased name, then id."""
    name, score = F.lower("name"), F.coalesce("score", F.lit(-1.0))
    return {"gain": [F.col("gain").desc(), name, F.col("id")], "name": [name, F.col("id")], "score": [score.desc(), name, F.col("id")]}[sort]


def worst_first() -> list[Column]:
    """Members without a score first, then the least score, then id."""
    return [F.col("score").asc_nulls_first(), F.col("id").asc()]


def trigger_prefix(words: DataFrame) -> DataFrame:
    """For each dataset its trigger words (dataset_id, place, word), ``w. `` each, in the order of ``place``."""
    own = words.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return own.select("dataset_id", F.array_join(F.transform("w", lambda x: F.concat(x["word"], F.lit(". "))), "").alias("prefix"))


def rejected(changes: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims with the flag of changes (media_id, claim_no, rejected)."""
    new = changes.select("media_id", "claim_no", F.col("rejected").alias("new"))
    return claims.join(new, ["media_id", "claim_no"], "left").withColumn("rejected", F.coalesce("new", "rejected")).drop("new")


def flagged(changes: DataFrame, media: DataFrame, flag: str) -> DataFrame:
    """The media with one flag set by changes (id, value); others keep theirs."""
    return media.join(changes.select("id", F.col("value").alias("_value")), "id", "left").withColumn(flag, F.coalesce("_value", flag)).drop("_value")


def without_scores(scores: DataFrame, metric_ids: list[str], media: DataFrame | None = None) -> DataFrame:
    """The scores but for those of these metrics, of all media or of the given ones."""
    gone = scores.filter(F.col("metric_id").isin(*metric_ids)).select("media_id", "metric_id").distinct()
    if media is not None:
        gone = gone.join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return scores.join(gone, ["media_id", "metric_id"], "left_anti")


def merged_tags(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (media_id, name, source) with tags renamed by names (old, new); of links that meet one stays, with a source if any has one."""
    own = links.join(names, F.col("name") == F.col("old"), "left").withColumn("name", F.coalesce("new", "name"))
    return own.groupBy("media_id", "name").agg(F.min("source").alias("source"))


def enriched_findings(findings: DataFrame, runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of known runs, with the rule's name where the rule still exists."""
    return findings.join(runs, "run_id").join(rules, "rule_id", "left")
