"""Quality scores: normalized averages, histograms, grades, pillars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Grades and verdicts by least score, histogram edges, pillar weights.
GRADES = ((90, "A"), (83, "B+"), (75, "B"), (65, "C"))
VERDICTS = ((80, "ready"), (65, "usable"))
EDGES = (0.0, 20.0, 40.0, 60.0, 80.0, 100.01)
WEIGHTS = {"quality": 0.35, "diversity": 0.30, "composition": 0.15, "hygiene": 0.20}


def normalized(score: Column, lo: Column, hi: Column, clamp: bool = True) -> Column:
    """A native score on 0 to 100."""
    inside = F.greatest(lo, F.least(hi, score)) if clamp else score
    return 100 * (inside - lo) / (hi - lo)


def average_scores(scores: DataFrame, metrics: DataFrame, clamp: bool = False) -> DataFrame:
    """media_id and the mean of its normalized scores; an unknown metric counts as 0 to 100. Sorting doesn't clamp."""
    both = scores.join(F.broadcast(metrics), "metric_id", "left")  # a row for each metric of the fixed list
    lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(100.0))
    return both.groupBy("media_id").agg(F.avg(normalized(F.col("score"), lo, hi, clamp)).alias("score"))


def all_scored(scores: DataFrame, metric_ids: list[str]) -> DataFrame:
    hits = scores.filter(F.col("metric_id").isin(*metric_ids)).groupBy("media_id").agg(F.countDistinct("metric_id").alias("n"))
    return hits.filter(F.col("n") == len(set(metric_ids))).select("media_id")


def bucket(score: Column) -> Column:
    """The number of the histogram bucket [lo, hi), from 0; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(EDGES) - 1)):
        out = F.when((score >= EDGES[i]) & (score < EDGES[i + 1]), F.lit(i)).otherwise(out)
    return out


def histogram(scores: DataFrame, col: str = "score") -> DataFrame:
    """Five buckets, empty ones too."""
    spark = scores.sparkSession
    counts = scores.groupBy(bucket(F.col(col)).alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.range(len(EDGES) - 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select(F.col("bucket").cast("long").alias("bucket"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _steps(score: Column, steps: tuple, rest: str) -> Column:
    out = F.lit(rest)
    for least, name in reversed(steps):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return F.when(score.isNotNull(), out)


def grade(score: Column) -> Column:
    return _steps(score, GRADES, "D")


def verdict(score: Column) -> Column:
    return _steps(score, VERDICTS, "needs work")


def overall(pillars: dict[str, Column]) -> Column:
    """The weighted mean of the pillars that are known."""
    pairs = [(F.when(c.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0), F.coalesce(c, F.lit(0.0))) for k, c in pillars.items()]
    total = sum((w for w, _ in pairs), F.lit(0.0))
    return F.when(total > 0, sum((w * c for w, c in pairs), F.lit(0.0)) / total)


def rank_normalized(df: DataFrame, col: str, *ties: str) -> DataFrame:
    """``rank``: ascending place over n - 1, ties by the given columns; 1 for a single row.

    Places come from ranges of the order: each range's size, the sizes before it, and the place within.
    """
    n = df.count()
    placed = global_place(df, [F.col(col).asc(), *[F.col(t).asc() for t in ties]])
    return placed.withColumn("rank", F.lit(1.0) if n <= 1 else F.col("place") / F.lit(float(n - 1))).drop("place")


def best_of(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of each key with the best scores, ties by id, with their ``place`` from 1; each task cuts to as many first."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc_nulls_last(), F.col("id").asc()))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def global_place(df: DataFrame, order: list[Column]) -> DataFrame:
    """``place`` (from 0) in a global order, without one task for all rows."""
    from lumenset.functions.storage import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_in", inside).join(before, "_part").withColumn("place", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def caption_report(scores: DataFrame, model_ids: list[str]) -> DataFrame:
    """Scores of current models: the mean of each medium (one decimal), worst first."""
    return scores.filter(F.col("model_id").isin(*model_ids)).groupBy("media_id").agg(F.bround(F.avg("score"), 1).alias("score"), F.count("*").alias("n")).orderBy("score", "media_id")


def hygiene(media: DataFrame, captions: DataFrame, min_side: int = 1024) -> DataFrame:
    """One row: caption coverage, share of first copies, share of known sizes that are large enough, and their mean."""
    has = captions.filter(F.trim("caption") != "").select(F.col("media_id").alias("id")).distinct().withColumn("captioned", F.lit(1))
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    large = F.least("width", "height") >= min_side
    row = media.join(has, "id", "left").agg(
        F.count("*").alias("n"), F.count("captioned").alias("captioned"), F.countDistinct("sha256").alias("contents"), F.count_if(sized).alias("sized"), F.count_if(sized & large).alias("large")
    )
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b))
    parts = [share("captioned", "n"), share("contents", "n"), share("large", "sized")]
    known = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    mean = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / known
    return row.select("n", parts[0].alias("coverage"), parts[1].alias("unique_share"), parts[2].alias("resolution"), mean.alias("hygiene"))
