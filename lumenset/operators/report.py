"""The quality report of many sets at once: pillars, grade, what pruning would bring, and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.functions.storage import materialize
from lumenset.operators import captions as C
from lumenset.operators import scores
from lumenset.operators.vectors import SPREAD, pairs_in_sets, unit

#: The window of the composition's spread, the parts of diversity, floors of quality and of the longer side, the
#: recommended sizes, the drift of a framing's share that counts, and how many recommendations are shown.
COMPOSITION, SPREAD_PART, UNIQUE_PART = (0.05, 0.45), 0.75, 0.25
LOW_QUALITY, LONG_SIDE, SIZES, DRIFT, SHOWN = 70.0, 1024, (20, 150), 12.0, 5


def _window(mean: Column, window: tuple[float, float]) -> Column:
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (mean - window[0]) / (window[1] - window[0]))))


def _of_sets(own: DataFrame, *columns: str | Column) -> DataFrame:
    """``own`` with a row for each set that a medium is in."""
    return own.select(*columns, F.explode("sets").alias("set")).select("set.dataset_id", "*").drop("set")


def spreads(own: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """(dataset_id, ``name``): the mean distance of each set's pairs of vectors, in closed form from the sums of its unit vectors; null for fewer than two.

    ``own``: id, sets; a vector is sent once, however many sets it is in.
    """
    u = own.select("id", "sets").join(vectors.filter("vector is not null").select("id", unit().alias("u")), "id")
    axes = _of_sets(u, "u").select("dataset_id", F.posexplode("u").alias("i", "x")).groupBy("dataset_id", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    sums = axes.groupBy("dataset_id").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.max("n").alias("n"))
    return sums.select("dataset_id", F.when(F.col("n") > 1, 1 - (F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias(name))


def pillars(members: DataFrame, media: DataFrame, vectors: DataFrame, depth: DataFrame, groups: DataFrame, captions: DataFrame, near: DataFrame | float) -> DataFrame:
    """A row for each set: images, quality, spread, unique, diversity, composition, hygiene, overall, grade, verdict, and the counts behind them.

    ``members``: dataset_id, id; ``media``: id, sha256, width, height, score (0 to 100 or null); ``vectors`` and ``depth``: id, vector; ``groups``:
    dataset_id, group_id, id, the lookalikes within a set, of which all hashed media have one (their own, if nothing is like them), or group_id, id, those
    of all sets; ``captions``: id, caption; ``near``: pairs (a, b) of near copies, or the least cosine of two, which are counted where they are found. Quality is the mean of known scores. Diversity is the spread of vectors with a quarter of
    the share that stays if each group keeps one. Composition is the spread of depth vectors. Hygiene is the mean of the shares of captions, sound captions, first copies
    and, where sizes are known, long enough sides. What nothing supports is null and doesn't count in the grade. ``projected`` is the grade without
    the media under the floor of quality, where that changes it. Members that ``media`` lacks don't count; repeated ones count once.
    """
    held = members.groupBy("id").agg(F.collect_set(F.struct("dataset_id")).alias("sets"))  # a row a medium: what is joined doesn't grow with its sets
    has = C.checked(captions.select("id", "caption"), "id", "caption", captioned=F.trim(F.coalesce("caption", F.lit(""))) != "")
    has = has.select("id", "captioned", (F.col("captioned") & (F.col("truncated") | F.col("repetition") | F.col("garbage") | F.col("residue"))).alias("bad"))
    own = held.join(media, "id").join(has, "id", "left").withColumns({"captioned": F.coalesce("captioned", F.lit(False)), "bad": F.coalesce("bad", F.lit(False))})
    own = materialize(own.select("id", "sets", "sha256", "width", "height", "score", "captioned", "bad"), "own")  # all parts are made from it
    sized = F.coalesce(F.col("width") > 0, F.lit(False)) & F.coalesce(F.col("height") > 0, F.lit(False))
    floor = F.col("score") >= LOW_QUALITY
    base = _of_sets(own, "*").groupBy("dataset_id").agg(
        F.count("*").alias("images"), F.count("score").alias("scored"), F.avg("score").alias("quality"), F.avg(F.when(floor, F.col("score"))).alias("kept"), F.count_if(~floor).alias("low_quality"),
        F.count_if("captioned").alias("captioned"), F.count_if("bad").alias("degenerate"), (F.count("sha256") - F.countDistinct("sha256")).alias("copies"),
        F.count_if(sized).alias("sized"), F.count_if(sized & (F.greatest("width", "height") >= LONG_SIDE)).alias("large"),
    )
    if "dataset_id" in groups.columns:
        alike = groups.join(_of_sets(own, "id"), ["dataset_id", "id"], "left_semi")
    else:
        alike = _of_sets(own.select("id", "sets").join(groups.select("id", "group_id"), "id"), "group_id")
    unique = alike.groupBy("dataset_id").agg(F.count("*").alias("hashed"), F.countDistinct("group_id").alias("kinds"))
    if isinstance(near, DataFrame):
        member = _of_sets(own, "id")
        pairs = near.select("a", "b").distinct().join(member.withColumnRenamed("id", "a"), "a").join(member.withColumnRenamed("id", "b"), ["dataset_id", "b"]).groupBy("dataset_id").agg(F.count("*").alias("near_pairs"))
    else:
        pairs = pairs_in_sets(vectors, own.select("id", F.filter("sets.dataset_id", lambda x: x.isNotNull()).alias("sets")), near).withColumnsRenamed({"set": "dataset_id", "n": "near_pairs"})
    rows = base
    for part in (spreads(own, vectors, "far"), spreads(own, depth, "deep"), unique, pairs):
        rows = rows.join(part, "dataset_id", "left")
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b))
    spread, same = _window(F.col("far"), SPREAD), F.when(F.col("hashed") > 1, 100.0 * F.col("kinds") / F.col("hashed"))
    parts = [share("captioned", "images"), 100.0 - share("degenerate", "images"), 100.0 - share("copies", "images"), share("large", "sized")]
    sound = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    rows = rows.withColumns({
        "spread": spread, "unique": same, "diversity": F.when(same.isNull(), spread).otherwise(SPREAD_PART * spread + UNIQUE_PART * same),
        "composition": _window(F.col("deep"), COMPOSITION), "hygiene": sound, "near_pairs": F.coalesce("near_pairs", F.lit(0)),
    })
    known = {k: F.col(k) for k in ("quality", "diversity", "composition", "hygiene")}
    pruned = F.when((F.col("low_quality") > 0) & F.col("kept").isNotNull(), scores.overall(known | {"quality": F.col("kept")}))
    rows = rows.withColumn("overall", scores.overall(known)).withColumn("projected", pruned)
    return rows.select(
        "dataset_id", "images", "quality", "spread", "unique", "diversity", "composition", "hygiene", "overall", scores.grade(F.col("overall")).alias("grade"), scores.verdict(F.col("overall")).alias("verdict"),
        "projected", "low_quality", (F.col("images") - F.col("captioned")).alias("uncaptioned"), "degenerate", "copies", "near_pairs",
    )


def framings(members: DataFrame, buckets: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """(dataset_id, bucket, n, share, target) of each set's buckets (``buckets``: id, bucket; none: ``unknown``), and of those that only ``ratios`` has.

    Shares and targets are in per cent; targets are of the ratios but ``any``; a bucket without a ratio has none.
    """
    total = sum(v for k, v in ratios.items() if k != "any")
    own = members.select("dataset_id", "id").distinct().join(buckets.select("id", "bucket"), "id", "left").withColumn("bucket", F.coalesce("bucket", F.lit("unknown")))
    counts = own.groupBy("dataset_id", "bucket").agg(F.count("*").alias("n"))
    sums = counts.groupBy("dataset_id").agg(F.sum("n").alias("all"))
    wanted = F.array(*[F.struct(F.lit(k).alias("bucket"), F.lit(100.0 * v / total).alias("target")) for k, v in ratios.items() if k != "any" and total])
    every = sums.select("dataset_id", F.explode(wanted.cast("array<struct<bucket:string,target:double>>")).alias("w")).select("dataset_id", "w.*")  # the buckets of a recipe
    both = counts.join(every, ["dataset_id", "bucket"], "full").join(sums, "dataset_id")
    return both.select("dataset_id", "bucket", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.col("all")).alias("share"), "target")


def recommendations(report: DataFrame, rows: DataFrame, sizes: tuple[int, int] = SIZES, shown: int = SHOWN) -> DataFrame:
    """(dataset_id, place, head, n, detail): what to do about a set, the first ``shown`` in this order: near copies, low quality, captions, framing, size.

    ``n`` is how many media or pairs it is about; ``detail`` the projected grade, the bucket that drifts most from its target, or the direction of the size.
    """
    drift = F.abs(F.col("share") - F.col("target"))
    off = rows.filter(drift > DRIFT).groupBy("dataset_id").agg(F.max_by(F.struct("bucket", "n", (F.col("share") > F.col("target")).alias("over")), F.struct(drift, "bucket")).alias("off"))
    both = report.join(off, "dataset_id", "left")
    card = lambda when, head, n, detail: F.when(when, F.struct(F.lit(head).alias("head"), n.cast("long").alias("n"), detail.cast("string").alias("detail")))
    c, none = F.col, F.lit(None)
    found = F.array(
        card(c("near_pairs") > 0, "Break near-dup pairs", c("near_pairs"), none),
        card(c("low_quality") > 0, "Prune the floor", c("low_quality"), F.when(c("projected").isNotNull(), F.format_string("%.0f", c("projected")))),
        card(c("uncaptioned") + c("degenerate") > 0, "Fill the caption gaps", c("uncaptioned") + c("degenerate"), none),
        card(c("off").isNotNull(), "Rebalance framing", c("off.n"), F.concat(c("off.bucket"), F.when(c("off.over"), " over").otherwise(" under"))),
        card(c("images") < sizes[0], "Grow the set", c("images"), none), card(c("images") > sizes[1], "Curation beats volume", c("images"), none),
    )
    return both.select("dataset_id", F.posexplode(F.slice(F.filter(found, lambda x: x.isNotNull()), 1, shown)).alias("place", "card")).select("dataset_id", "place", "card.*")
