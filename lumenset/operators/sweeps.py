"""Maintenance sweeps: what no link holds, for all categories at once.

Every table marks its keys with a bit, in one tagged union; one shuffle brings a key's bits together, and what lacks the
bits that keep it is swept. Tables of any number and size cost one pass each and one shuffle of small rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEDIA, FILED, LISTED, CAPTIONED, REVISION, HELD = 1, 2, 4, 8, 16, 32
#: Index data that is swept whole.
WHOLE = ("claims", "quality", "embeddings", "index")
VACUUMED = ("media", "captions", "dataset_captions", *WHOLE)


def _marks(df: DataFrame, domain: str, a: Column, bit: int, b: Column | None = None, size: Column | None = None) -> DataFrame:
    none = F.lit(0).cast("long")
    return df.select(F.lit(domain).alias("domain"), a.cast("long").alias("a"), (none if b is None else b.cast("long")).alias("b"), F.lit(bit).alias("bit"), (none if size is None else size.cast("long")).alias("bytes"))


def marked(media: DataFrame, files: DataFrame, links: DataFrame, revisions: DataFrame, heads: DataFrame, pins: DataFrame) -> DataFrame:
    """(domain, a, b, bits, rows, bytes) of each medium (a) and each caption revision (a, b).

    ``media``: id; ``files`` and ``links``: media_id; ``revisions``: media_id, revision_id, content; ``heads`` and ``pins``: media_id, revision_id.
    Null keys are keys of their own; links of things that aren't there have no effect.
    """
    c, size = F.col, F.octet_length("content")
    rows = [
        _marks(media, "media", c("id"), MEDIA), _marks(files, "media", c("media_id"), FILED), _marks(links, "media", c("media_id"), LISTED), _marks(revisions, "media", c("media_id"), CAPTIONED, size=size),
        _marks(revisions, "revision", c("media_id"), REVISION, c("revision_id"), size), _marks(heads, "revision", c("media_id"), HELD, c("revision_id")), _marks(pins, "revision", c("media_id"), HELD, c("revision_id")),
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("domain", "a", "b").agg(F.bit_or("bit").alias("bits"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def _has(bit: int) -> Column:
    return F.col("bits").bitwiseAND(F.lit(bit)) > 0


def swept(marks: DataFrame) -> DataFrame:
    """(category, a, b, bytes) of what goes: media without a file and a set; revisions that are no head and not pinned; captions of media in no set."""
    media, revision = F.col("domain") == "media", F.col("domain") == "revision"
    names = F.array(
        F.when(media & _has(MEDIA) & ~_has(FILED) & ~_has(LISTED), F.struct(F.lit("media").alias("category"), F.lit(0).cast("long").alias("bytes"))),
        F.when(media & _has(CAPTIONED) & ~_has(LISTED), F.struct(F.lit("dataset_captions").alias("category"), F.col("bytes"))),
        F.when(revision & _has(REVISION) & ~_has(HELD), F.struct(F.lit("captions").alias("category"), F.col("bytes"))),
    )
    rows = marks.select("a", "b", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("x"))
    return rows.select("x.category", "a", "b", "x.bytes")


def cleanup_report(marks: DataFrame, whole: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(category, n, bytes, vacuumed): what each sweep would free, categories without anything too.

    ``whole``: tables that are swept as a whole, by category, each with the bytes of a row.
    """
    spark = marks.sparkSession
    found = swept(marks).groupBy("category").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    for name, (table, size) in whole.items():
        found = found.unionByName(table.agg(F.lit(name).alias("category"), F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")))
    names = list(dict.fromkeys(["media", "captions", "dataset_captions", *whole]))
    every = spark.createDataFrame([(n, n in VACUUMED) for n in names], "category string, vacuumed boolean")
    return every.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "vacuumed")


def purged(table: DataFrame, gone: DataFrame, category: str, a: str = "media_id", b: str | None = None) -> DataFrame:
    """``table`` without the rows that a category of ``swept`` names, by ``a`` and, for revisions, ``b``."""
    own = gone.filter(F.col("category") == category).select(F.col("a").alias(a), *([F.col("b").alias(b)] if b else []))
    return table.join(own.distinct(), [a, b] if b else [a], "left_anti")
