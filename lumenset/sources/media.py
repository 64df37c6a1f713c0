"""Media folders, sidecar captions and label files as DataFrames; the deploy sink's manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of videos.
VIDEO = ("mp4", "mov", "avi", "mkv")


def media_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, content: bool = True) -> DataFrame:
    """path, stem, extension, size, modified, is_video and (with ``content``) sha256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit("")))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    sha = [F.sha2("content", 256).alias("sha256")] if content else []
    return files.select("path", stem.alias("stem"), extension.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), extension.isin(*VIDEO).alias("is_video"), *sha)


def with_sidecars(spark: SparkSession, files: DataFrame, folder: str, extension: str = "txt") -> DataFrame:
    """``files`` with the stripped text of the file that has their stem and ``extension``; empty where there is none."""
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").text(folder)
    texts = texts.select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/").alias("p"), F.trim("value").alias("caption"))
    texts = texts.select(F.regexp_replace("p", r"\.[^./]*$", "").alias("stem"), "caption")
    own = files.withColumn("stem", F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"\.[^./]*$", ""))
    return own.join(texts, "stem", "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def ingest(files: DataFrame, known: DataFrame) -> DataFrame:
    """Each file with the media it belongs to: by path, else by content, else new (null id); is_fresh: new, or archived.

    ``known`` has id, path, sha256, archived. Copies of one new content are one medium: the least path is its first.
    """
    by_path = known.select(F.col("path"), F.col("id").alias("path_id")).dropDuplicates(["path"])
    by_sha = known.groupBy("sha256").agg(F.min("id").alias("sha_id"), F.min("archived").alias("archived"))
    out = files.join(by_path, "path", "left").join(by_sha, "sha256", "left")
    first = files.groupBy("sha256").agg(F.min("path").alias("first_path"))
    return out.join(first, "sha256").select("path", "sha256", F.coalesce("path_id", "sha_id").alias("id"), "first_path", F.coalesce(F.col("archived"), F.lit(True)).alias("is_fresh"))


def folder_tree(files: DataFrame, path_col: str = "path", samples: int = 3) -> DataFrame:
    """Own and total counts and a few sample paths of each folder and its ancestors; dot-folders are skipped."""
    parts = F.split(path_col, "/")
    kept = files.filter(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith(".")))
    folders = F.slice(parts, 1, F.size(parts) - 1)
    chain = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda i: F.array_join(F.slice(folders, 1, i), "/"))
    rows = kept.select(F.col(path_col).alias("p"), F.array_join(folders, "/").alias("own"), F.explode(chain).alias("folder"))
    first = rows.filter(F.col("own") == F.col("folder")).groupBy("folder").agg(F.min("p").alias("sample"))
    counts = rows.groupBy("folder").agg(F.count("*").alias("total"), F.count_if(F.col("own") == F.col("folder")).alias("own"))
    return counts.join(first, "folder", "left")
