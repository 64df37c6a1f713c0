"""Swapping members of a selection for newcomers: each is offered to one member at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenset.functions.storage import discard, materialize
from lumenset.operators.vectors import cosine, nearest, nearest_of, unit

#: What a tag and a name are worth, and how many are listed with and without a search.
TAG, NAME, SEARCHED, NEIGHBOURS = 2, 1, 5, 3


def _parts(rows: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """(key, token): all parts of a text of the given lengths, lower-cased, once each."""
    t = F.lower(text)

    def of_size(n: int):
        parts = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, parts).otherwise(F.array().cast("array<string>"))

    cut = [of_size(n) for n in sizes]
    return rows.select(key, F.explode(F.array_distinct(F.flatten(F.array(*cut)))).alias("token"))


#: Members of a kind that one row of an expansion meets at most; a kind of more is dealt into several.
DEALT = 4096


def _scored(requests: DataFrame, media: DataFrame, media_tag: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Searches, kinds of newcomers, and what they score, each once: (id, search), (other, kind), (search, kind, points, why); None without a word.

    A search is a set of words, a kind a set of names and tags. So texts are compared once for all that have them.
    """
    words = requests.select("id", F.explode(F.filter(F.split(F.lower("q"), "[^a-z0-9_]+"), lambda x: x != "")).alias("token"))
    asked = materialize(words.groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("words")), "asked")
    searches = materialize(asked.select("words").distinct().withColumn("search", F.monotonically_increasing_id()), "searches")
    tokens = searches.select("search", F.explode("words").alias("token"))
    sizes = sorted(r.n for r in tokens.select(F.length("token").alias("n")).distinct().collect())  # lengths of words
    if not sizes:
        return None
    texts = media.select("id", "name", F.lit(False).alias("tag"))
    texts = texts.unionByName(media_tag.select(F.col("media_id").alias("id"), "name", F.lit(True).alias("tag")).join(media.select("id"), "id", "left_semi"))
    own = texts.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("tag", "name"))).alias("texts"))
    own = materialize(own, "newcomers")
    kinds = materialize(own.select("texts").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    has = kinds.select("kind", F.explode("texts").alias("t")).select("kind", "t.*")
    hits = _parts(has.select("name").distinct(), "name", "name", sizes).join(tokens.select("token").distinct(), "token")
    has = has.join(hits, "name").groupBy("kind", "token").agg(F.max("tag").alias("tag"), F.bool_or(~F.col("tag")).alias("named"))
    both = tokens.join(has, "token").groupBy("search", "kind").agg(F.array_sort(F.collect_set(F.when(F.col("tag"), F.col("token")))).alias("tags"), F.bool_or("named").alias("named"))
    points = TAG * F.size("tags") + F.when(F.col("named"), NAME).otherwise(0)
    why = F.when(F.size("tags") > 0, F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " ")).otherwise("name match")
    scored = materialize(both.select("search", "kind", points.alias("points"), why.alias("why")), "scored")
    return asked.join(searches, "words").select("id", "search"), own.join(kinds, "texts").select(F.col("id").alias("other"), "kind"), scored


def searched(requests: DataFrame, media: DataFrame, media_tag: DataFrame) -> DataFrame:
    """(id, other, points, why): newcomers that a search finds, two points for each of its words that is part of a tag, one if any is part of the name.

    ``requests``: id, q; ``media``: id, name of the newcomers. Words are runs of letters, digits and underscores. A word meets the parts of
    its length of each text by an equi-join. The rows found are made by joins alone, and aren't shuffled or gathered again.
    """
    parts = _scored(requests, media, media_tag)
    if parts is None:
        return requests.select("id", F.col("id").alias("other"), F.lit(0).alias("points"), F.lit("").alias("why")).limit(0)
    asked, kinds, scored = parts
    kinds = materialize(kinds, "kind-of")
    deals = kinds.groupBy("kind").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("deals"))
    wanted = asked.join(scored, "search").join(deals, "kind").select("id", "kind", "points", "why", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    wanted = wanted.repartition(int(media.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "kind")  # many rows come of each of these few
    dealt = kinds.join(deals, "kind").select("other", "kind", F.pmod(F.xxhash64("other"), F.col("deals")).cast("int").alias("deal"))
    return wanted.join(dealt, ["kind", "deal"]).filter("id <> other").select("id", "other", "points", "why")


def _first_found(requests: DataFrame, media: DataFrame, media_tag: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """(id, other, points, cosine, why): of what each search finds the first ``most``, without making all pairs.

    Newcomers of a search with the same points are a level; a level counts if those above have ``most`` members or fewer. Of a level only the nearest
    ``most`` with a vector can be among the first, and the ``most + 1`` least ids (of those without one, or of all for a member without one).
    """
    parts = _scored(requests, media, media_tag)
    if parts is None:
        return requests.select("id", F.col("id").alias("other"), F.lit(0).alias("points"), F.lit(0.0).alias("cosine"), F.lit("").alias("why")).limit(0)
    asked, kinds, scored = parts
    known = vectors.filter("vector is not null").select("id", "vector")
    kinds = materialize(kinds.join(known.select(F.col("id").alias("other"), F.lit(True).alias("has")), "other", "left").withColumn("has", F.coalesce("has", F.lit(False))), "kind-of")
    level = scored.join(kinds.groupBy("kind").agg(F.count("*").alias("n")), "kind").groupBy("search", "points").agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(W.partitionBy("search").orderBy(F.col("points").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    levels = level.withColumn("above", above).filter(F.col("above") <= most).select("search", "points")
    live = materialize(scored.join(levels, ["search", "points"]), "levels")
    members = live.join(kinds, "kind").select("search", "points", "other", "has")
    least = lambda rows: rows.withColumn("n", F.row_number().over(W.partitionBy("search", "points").orderBy("other"))).filter(F.col("n") <= most + 1).drop("n", "has")
    own = asked.join(known.select("id", "vector"), "id", "left")
    low = least(members.filter("not has")).unionByName(least(members)).distinct()
    pairs = own.select("id", "search").join(low, "search").select("id", "other", "points")
    near = nearest_of(own.filter("vector is not null").join(levels, "search"), members.filter("has").join(known.withColumnRenamed("id", "other"), "other"), ["search", "points"], most)
    pairs = pairs.unionByName(near.select("id", "other", "points")).filter("id <> other").distinct()
    u = known.select("id", unit().alias("u"))
    both = pairs.join(u.withColumnRenamed("u", "a"), "id", "left").join(u.select(F.col("id").alias("other"), F.col("u").alias("b")), "other", "left")
    both = both.select("id", "other", "points", F.coalesce(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), cosine("a", "b")), F.lit(0.0)).alias("cosine"))
    order = W.partitionBy("id").orderBy(F.col("points").desc(), F.col("cosine").desc(), "other")
    first = both.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")
    return first.join(kinds.select("other", "kind"), "other").join(asked, "id").join(scored.select("search", "kind", "why"), ["search", "kind"]).select("id", "other", "points", "cosine", "why")


def swap_lists(requests: DataFrame, media: DataFrame, media_tag: DataFrame, vectors: DataFrame, most: int = SEARCHED, near: int = NEIGHBOURS) -> DataFrame:
    """(id, other, points, cosine, why): what may stand in for each asked member, best first by points, then cosine, then id.

    With a search the ``most`` that it finds (unknown cosines count as 0); without one the ``near`` nearest vectors. ``media`` are the
    newcomers: no member is among them.
    """
    with_q = F.coalesce(F.trim("q"), F.lit("")) != ""
    first = _first_found(requests.filter(with_q), media, media_tag, vectors, most)
    asked = vectors.join(requests.filter(~with_q).select("id").distinct(), "id", "left_semi")
    visual = nearest(asked, vectors.join(media.select("id"), "id", "left_semi"), near)
    return first.unionByName(visual.select("id", "other", F.lit(0).alias("points"), "cosine", F.lit("visual neighbour").alias("why")))


def assigned(lists: DataFrame, rounds: int = 200) -> DataFrame:
    """The listed pairs that are offered: each member and each newcomer once, the best pairs first.

    The same as going through all pairs in order (points, cosine, ids) and taking those of which neither is taken. In each round every
    member and newcomer names its best pair, and pairs that both name are settled: nothing better can come for either. What
    touches a settled pair leaves; a round settles the best pair that is left at least.
    """
    rank = F.struct(F.col("points").alias("p"), F.col("cosine").alias("c"), (-F.col("id")).alias("i"), (-F.col("other")).alias("o"))
    left, done = materialize(lists.dropDuplicates(["id", "other"]).withColumn("rank", rank), "swaps"), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        own = left.groupBy("id").agg(F.max("rank").alias("own"))
        new = left.groupBy("other").agg(F.max("rank").alias("new"))
        settled = materialize(left.join(own, "id").join(new, "other").filter((F.col("rank") == F.col("own")) & (F.col("rank") == F.col("new"))).select(*left.columns), "settled")
        done.append(settled)
        rest = materialize(left.join(settled.select("id"), "id", "left_anti").join(settled.select("other"), "other", "left_anti").select(*left.columns), "swaps")
        discard(left)
        left = rest
    else:
        raise RuntimeError(f"pairs did not settle in {rounds} rounds")
    out = left
    for d in done:
        out = out.unionByName(d)
    return out.drop("rank")
