"""Issues of pairs and outliers, and the resolutions in force for them, as of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.functions.storage import materialize
from lumenset.operators.vectors import NEIGHBOURS, SIGMA, neighbours

#: What an issue of each kind weighs at least, and the cosine from which two media are copies.
BASE_IMPACT = {"near_dup": 90.0, "low_quality": 70.0, "caption": 55.0, "outlier": 40.0}
NEAR_DUPLICATE, WIDEST = 0.92, 20.0


def _two_digits(x: Column) -> Column:
    return F.format_string("%.2f", x)


def near_duplicate_issues(cosines: DataFrame, groups: DataFrame, quality: DataFrame, least: float = NEAR_DUPLICATE) -> DataFrame:
    """An issue for each pair of copies: key ``dup:a:b``, kind, ids (the one to keep first), value, impact, fingerprint, source.

    ``cosines``: a, b, cosine of at least ``least``; ``groups``: id, representative, similarity (0 to 100) of lookalikes, each member paired with
    its representative; a pair that both know has the cosine. ``quality``: id, score, area; of two media the one with the better score, then the larger area,
    then the lesser id is kept. Pairs with a medium that ``quality`` lacks don't count.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    near = cosines.filter(F.col("a") != F.col("b")).groupBy(lo.alias("a"), hi.alias("b")).agg(F.max("cosine").alias("cosine"))
    own = groups.filter(F.col("id") != F.col("representative")).select(F.col("id").alias("a"), F.col("representative").alias("b"), (F.col("similarity") / 100).alias("alike"))
    own = own.groupBy(lo.alias("a"), hi.alias("b")).agg(F.max("alike").alias("alike"))
    pairs = near.join(own, ["a", "b"], "full").withColumn("value", F.coalesce("cosine", "alike"))
    rank = F.struct(F.coalesce("score", F.lit(-1.0)).alias("score"), F.coalesce("area", F.lit(0)).cast("long").alias("area"), (-F.col("id")).alias("id"))
    side = lambda k: quality.select(F.col("id").alias(k), rank.alias(f"rank_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    keep = F.when(F.col("rank_a") >= F.col("rank_b"), F.array("a", "b")).otherwise(F.array("b", "a"))
    impact = BASE_IMPACT["near_dup"] + F.greatest(F.lit(0.0), (F.col("value") - least) * 100)
    return both.select(
        F.concat(F.lit("dup:"), F.col("a").cast("string"), F.lit(":"), F.col("b").cast("string")).alias("key"), F.lit("near_dup").alias("kind"), keep.alias("ids"), "value", impact.alias("impact"),
        _two_digits(F.col("value")).alias("fingerprint"), F.when(F.col("cosine").isNotNull(), "embedding").otherwise("perceptual").alias("source"),
    )


def outlier_issues(vectors: DataFrame, sigma: float = SIGMA, k: int = NEIGHBOURS) -> DataFrame:
    """An issue for each vector that is far from its ``k`` nearest: key ``out:id``, kind, ids, value (mean distance), impact, fingerprint, nearest (their ids)."""
    near = neighbours(vectors, k)
    own = near.groupBy("id").agg((1 - F.avg("cosine")).alias("value"), F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("near"))  # k rows each
    own = materialize(own, "distances")  # for the level and again for what is over it
    level = own.agg((F.avg("value") + sigma * F.stddev_pop("value")).alias("bar"), F.stddev_pop("value").alias("dev"))
    far = own.join(F.broadcast(level), F.col("dev") > 1e-9).filter(F.col("value") > F.col("bar"))  # one row
    impact = BASE_IMPACT["outlier"] + F.least(F.lit(WIDEST), (F.col("value") - F.col("bar")) * WIDEST)
    return far.select(
        F.concat(F.lit("out:"), F.col("id").cast("string")).alias("key"), F.lit("outlier").alias("kind"), F.array("id").alias("ids"), "value", impact.alias("impact"),
        _two_digits(F.col("value")).alias("fingerprint"), F.transform("near", lambda x: x["other"]).alias("nearest"),
    )


def in_force(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The issues (key, fingerprint, report) with the resolution in force at their report, and why an earlier one isn't.

    ``resolutions``: key, fingerprint, resolution, version; a null resolution takes an earlier one back. Of those of a key up to the
    report's number the newest counts, if its fingerprint is the issue's: ``state`` is ``resolved``, ``changed`` (it was about another
    measurement), or ``open``. The newest is found by an aggregate on key and report, so an issue's history isn't gathered.
    """
    asked = issues.select("key", "report").distinct()
    past = asked.join(resolutions, "key").filter(F.col("version") <= F.col("report"))
    last = past.groupBy("key", "report").agg(F.max_by(F.struct("fingerprint", "resolution", "version"), F.struct("version", "fingerprint")).alias("last"))
    both = issues.join(last, ["key", "report"], "left")
    live = F.col("last.resolution").isNotNull()
    same = F.col("last.fingerprint").eqNullSafe(F.col("fingerprint"))
    state = F.when(live & same, "resolved").when(live, "changed").otherwise("open")
    return both.select(*issues.columns, state.alias("state"), F.when(live & same, F.col("last.resolution")).alias("resolution"), F.when(live, F.col("last.version")).alias("version"))


def stale(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(key, version, why) of the newest resolutions that a report's issues (key, fingerprint) leave without a subject: ``gone`` or ``changed``."""
    newest = resolutions.groupBy("key").agg(F.max_by(F.struct("fingerprint", "resolution", "version"), F.struct("version", "fingerprint")).alias("last")).filter("last.resolution is not null")
    both = newest.join(issues.select("key", F.col("fingerprint").alias("now"), F.lit(True).alias("found")), "key", "left")
    why = F.when(F.col("found").isNull(), "gone").when(~F.col("now").eqNullSafe(F.col("last.fingerprint")), "changed")
    return both.select("key", "last.version", why.alias("why")).filter("why is not null")
