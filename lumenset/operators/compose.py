"""The composer's preview: what many proposals would make of a set, from sums of the set and of each proposal's changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.operators import scores
from lumenset.operators.vectors import SPREAD, unit

#: What a duplicate costs, the share under which a framing is rare, room above the recommended size, the
#: recommended sizes, and the floor of quality.
DUPLICATE, RARE, ROOM, SIZES, LOW_QUALITY = 22.0, 10.0, 10, (20, 150), 70.0


def moves(proposals: DataFrame, media: DataFrame, dataset: DataFrame) -> DataFrame:
    """(proposal_id, id, sign, ...): the changes that are any: known media that come (1) and aren't in the set, or go (-1) and are.

    ``proposals``: proposal_id, id, sign; repeated changes count once, and of an id that comes and goes nothing is changed.
    """
    own = proposals.groupBy("proposal_id", "id").agg(F.min("sign").alias("sign"), F.max("sign").alias("other")).filter("sign = other").drop("other")
    member = dataset.select("id").distinct().withColumn("member", F.lit(True))
    both = own.join(media, "id").join(member, "id", "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return both.filter((F.col("sign") > 0) != F.col("member")).drop("member")


def _sums(rows: DataFrame, sign: Column, *keys: str) -> list[Column]:
    scored = F.col("score").isNotNull()
    has = F.col("vector").isNotNull()
    square = F.when(has, F.aggregate(unit(), F.lit(0.0), lambda a, x: a + x * x))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [
        total(sign).alias("n"), total(F.when(scored, sign)).alias("scored"), F.coalesce(F.sum(sign * F.col("score")), F.lit(0.0)).alias("score"),
        total(F.when(has, sign)).alias("vectors"), F.coalesce(F.sum(sign * square), F.lit(0.0)).alias("squares"),
    ]


def duplicated(changes: DataFrame, dataset: DataFrame, groups: DataFrame, near: DataFrame) -> DataFrame:
    """(proposal_id, id) of what comes and has a copy in what the set would be: one of its group of lookalikes, or a neighbour of ``near`` (a, b).

    Groups are counted, not paired, so a group of many copies makes no pairs.
    """
    member = groups.select("id", "group_id").distinct()
    base = dataset.select("id").distinct().join(member, "id").groupBy("group_id").agg(F.count("*").alias("held"))
    own = changes.select("proposal_id", "id", "sign").join(member, "id")
    count = own.groupBy("proposal_id", "group_id").agg(F.sum("sign").alias("change")).join(base, "group_id", "left")
    crowded = count.filter(F.col("change") + F.coalesce("held", F.lit(0)) > 1).select("proposal_id", "group_id")
    by_group = own.filter("sign > 0").join(crowded, ["proposal_id", "group_id"], "left_semi").select("proposal_id", "id")
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # not a union, which would make the pairs twice
    links = near.select(F.explode(both).alias("l")).select("l.a", "l.b")
    asked = changes.filter("sign > 0").select("proposal_id", F.col("id").alias("a")).join(links, "a")
    sign = changes.select("proposal_id", F.col("id").alias("b"), F.col("sign").alias("moved"))
    kept = dataset.select(F.col("id").alias("b")).distinct().withColumn("member", F.lit(True))
    there = asked.join(sign, ["proposal_id", "b"], "left").join(kept, "b", "left").filter((F.col("moved") > 0) | (F.col("moved").isNull() & F.col("member")))
    return by_group.union(there.select("proposal_id", F.col("a").alias("id"))).distinct()


def preview(media: DataFrame, dataset: DataFrame, proposals: DataFrame, groups: DataFrame, near: DataFrame, sizes: tuple[int, int] = SIZES) -> DataFrame:
    """A row for each proposal: its pillars, score, grade, and their difference to the set as it is.

    ``media``: id, score (0 to 100 or null), vector (or null); ``dataset``: id; ``proposals``: proposal_id, id, sign (1 comes, -1 goes);
    ``groups``: group_id, id of lookalikes; ``near``: pairs (a, b) of near copies. Quality is the mean of known scores; diversity
    comes in closed form from the sum of unit vectors, |S + D|^2 = |S|^2 + 2 S.D + |D|^2, so a proposal costs as many rows as
    it changes and not as the set has; hygiene loses for each copy that comes. A pillar that nothing supports is null.
    An empty set and proposals that change nothing are right too; ``dataset`` may name media that are not known.
    """
    changes = moves(proposals, media, dataset)
    members = media.join(dataset.select("id").distinct(), "id", "left_semi")
    sign = F.col("sign")
    base = members.agg(*_sums(members, F.lit(1)))
    axes = members.filter("vector is not null").select(F.posexplode(unit()).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))  # a row for each dimension
    whole = axes.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("length"))
    sums = changes.groupBy("proposal_id").agg(
        *_sums(changes, sign), F.count_if(sign > 0).alias("comes"), F.count_if(sign < 0).alias("goes"), F.count_if((sign > 0) & (F.coalesce("score", F.lit(0.0)) < LOW_QUALITY)).alias("low_quality")
    )
    moved = changes.filter("vector is not null").select("proposal_id", "sign", F.posexplode(unit()).alias("i", "x")).groupBy("proposal_id", "i").agg(F.sum(sign * F.col("x")).alias("d"))
    cross = moved.join(axes, "i", "left").groupBy("proposal_id").agg(F.sum(2 * F.coalesce("s", F.lit(0.0)) * F.col("d") + F.col("d") * F.col("d")).alias("cross"))
    copies = duplicated(changes, dataset, groups, near).groupBy("proposal_id").agg(F.count("*").alias("duplicates"))
    rows = proposals.select("proposal_id").distinct().join(sums, "proposal_id", "left").join(cross, "proposal_id", "left").join(copies, "proposal_id", "left")
    rows = rows.select("proposal_id", *[F.coalesce(c, F.lit(0)).alias(f"d_{c}") for c in ("n", "scored", "score", "vectors", "squares", "cross", "comes", "goes", "low_quality", "duplicates")])
    rows = rows.join(F.broadcast(base.join(whole, F.lit(True))), F.lit(True))  # one row

    def pillars(scored: Column, score: Column, vectors: Column, squares: Column, length: Column, copies: Column) -> dict[str, Column]:
        mean = 1 - (length - squares) / (vectors * (vectors - 1))
        spread = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (mean - SPREAD[0]) / (SPREAD[1] - SPREAD[0])))
        return {"quality": F.when(scored > 0, score / scored), "diversity": F.when(vectors > 1, spread), "hygiene": F.greatest(F.lit(0.0), 100.0 - DUPLICATE * copies)}

    c = F.col
    now = pillars(c("scored"), c("score"), c("vectors"), c("squares"), c("length"), F.lit(0))
    then = pillars(*[c(k) + c(f"d_{k}") for k in ("scored", "score", "vectors", "squares")], c("length") + c("d_cross"), c("d_duplicates"))
    rows = rows.select("*", *[v.alias(f"base_{k}") for k, v in now.items()], *[v.alias(k) for k, v in then.items()])
    rows = rows.withColumn("score", scores.overall({k: c(k) for k in then})).withColumn("base_score", scores.overall({k: c(f"base_{k}") for k in now}))
    total = c("n") + c("d_n")
    return rows.select(
        "proposal_id", "quality", "diversity", "hygiene", c("d_duplicates").alias("duplicates"), "base_quality", "base_diversity", "score", "base_score", (c("score") - c("base_score")).alias("delta"),
        scores.grade(c("score")).alias("grade"), c("n").alias("base"), c("d_comes").alias("comes"), c("d_goes").alias("goes"), total.alias("total"), (total > sizes[1]).alias("over"),
        F.least(F.lit(100.0), 100.0 * total / (sizes[1] + ROOM)).alias("percent"), c("d_low_quality").alias("low_quality"),
    )


def framing(media: DataFrame, dataset: DataFrame, proposals: DataFrame, buckets: DataFrame) -> DataFrame:
    """(proposal_id, bucket, base, added, total, share, under): what each bucket has, and what a proposal adds to it or takes from it.

    ``buckets``: id, bucket; media without one are ``unknown``. Buckets that neither side has don't appear.
    """
    named = buckets.select("id", "bucket")
    of = F.coalesce("bucket", F.lit("unknown")).alias("bucket")
    changes = moves(proposals, media.select("id"), dataset).join(named, "id", "left").groupBy("proposal_id", of).agg(F.sum("sign").alias("added"))
    base = dataset.select("id").distinct().join(named, "id", "left").groupBy(of).agg(F.count("*").alias("base"))  # a row for each bucket
    every = proposals.select("proposal_id").distinct().join(F.broadcast(base), F.lit(True))
    rows = every.join(changes, ["proposal_id", "bucket"], "full").select("proposal_id", "bucket", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("added", F.lit(0)).alias("added"))
    sums = rows.groupBy("proposal_id").agg(F.sum(F.col("base") + F.col("added")).alias("all"))
    share = F.when(F.col("all") > 0, 100.0 * F.col("total") / F.col("all")).otherwise(0.0)
    return rows.withColumn("total", F.col("base") + F.col("added")).join(sums, "proposal_id").select("proposal_id", "bucket", "base", "added", "total", share.alias("share"), (share < RARE).alias("under"))
