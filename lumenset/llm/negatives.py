"""Hard negatives by exact inner-product search over lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster, rows are sorted once by what their product with any member can be at
most: the row's length times the cosine of its angle to the centre, less the cluster's widest angle. Each member walks
this list from the top until the next bound is under what it still needs, so that what it found is certain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.llm.blocks import BLOCK, Lists, best, in_cells, matrix, numbered, usable, widened
from lumenset.llm.common import materialize

#: Centres are fitted on so many anchors at most (those with the least hashes); so many rows of a list are scored at once.
SAMPLE, CENTRES, STEP = 2048, 16, 512


def centres_of(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres at length 1 of spherical k-means, seeded by the farthest points from the first."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    x = vectors[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
    if not len(x):
        return np.zeros((1, vectors.shape[1]))
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _angles(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length of each row and its angle to the centre; a row of zeros lies at the centre."""
    length = np.linalg.norm(x, axis=1)
    cosine = np.divide(x @ centre, length, out=np.ones(len(x)), where=length > 0)
    return length, np.arccos(np.clip(cosine, -1, 1))


def shared_list(members: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order and bounds: no member's product with a row exceeds its own length times the bound."""
    width = _angles(members, centre)[1].max()
    length, angle = _angles(rows, centre)
    bound = length * np.cos(np.maximum(0, angle - width - 1e-7)) + 1e-9 * length
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def _walk(members: np.ndarray, rows: np.ndarray, centre: np.ndarray, needs, take) -> None:
    """Scores the list step by step for the members whose ``needs()`` (a score that must be reached) a bound still reaches."""
    order, bound = shared_list(members, rows, centre)
    length = np.linalg.norm(members, axis=1)
    for at in range(0, len(order), STEP):
        most = length * bound[at] + 1e-6 * (1 + length * abs(bound[at]))
        active = np.flatnonzero(most >= needs())
        if not len(active):
            return
        part = order[at : at + STEP]
        take(active, part, members[active] @ rows[part].T)


def _by_cluster(q: pa.Table):
    cluster = q["cluster"].to_numpy()
    for c in np.unique(cluster):
        yield c, np.flatnonzero(cluster == c)


def _anchors(own: DataFrame, anchors: Column, group: int) -> tuple[DataFrame, int, np.ndarray]:
    """The anchors with their cluster and group, the number of groups, and the centres.

    A cluster of more than ``group`` anchors is dealt out into several groups; small clusters share one.
    """
    asks = own.filter(anchors)
    sample = asks.select("vector", F.xxhash64("uid").alias("h"), "uid").orderBy("h", "uid").limit(SAMPLE).toArrow()
    centres = centres_of(matrix(sample["vector"]), max(1, min(CENTRES, sample.num_rows // 8)))

    @F.pandas_udf("int")
    def nearest(vectors):
        x, c = widened(matrix(pa.array(vectors)), centres)
        return pd.Series(np.argmax(x @ c.T, axis=1).astype(np.int32), index=vectors.index)

    asks = asks.withColumn("cluster", nearest("vector"))
    counts = {r.cluster: r["count"] for r in asks.groupBy("cluster").count().collect()}  # a row a centre
    begins, groups, room = {}, 0, 0
    for c, n in sorted(counts.items()):
        if n > group:
            begins[c], groups, room = (groups, -(-n // group)), groups + -(-n // group), 0
        else:
            if room < n:
                groups, room = groups + 1, group
            begins[c], room = (groups - 1, 1), room - n
    first, parts = (F.create_map(*[F.lit(x) for c, v in begins.items() for x in (c, v[i])])[F.col("cluster")] for i in (0, 1)) if begins else (F.lit(0), F.lit(1))
    return asks.withColumn("grp", first + F.pmod(F.xxhash64("uid"), parts)), max(1, groups), centres


def mine(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label",
    positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), group: int = 1024, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and each of its positives.

    ``vectors`` holds whole numbers; a score is an inner product (exact below 2^53, in double precision), greater ones come first, ties by the least id. ``anchors`` is
    a condition on the column ``id``. An anchor's positives are its first other rows of the same label; for each, the
    first ``negatives`` rows of other labels follow whose score is within ``window`` per cent of the positive's. A pair
    without such a row has none. Rows without an id or a label, or whose vector is null or has components that are null or not
    finite, take no part. Equal rows are rows of their own; shorter vectors count as filled up with zeros. An empty table
    gives no rows. Every anchor meets every row, in cells of a group and a block; nothing is cut short but by the bounds.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = numbered(own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")), "rows")
    asks, groups, centres = _anchors(own, anchors, group)
    names = ["uid", "id", "label", "vector"]

    def same(q: pa.Table, x: pa.Table):
        a, b, c = widened(matrix(q["vector"]), matrix(x["vector"]), centres)
        ids, uids, labels = x["id"].to_numpy(), x["uid"].to_numpy(), np.array(x["label"].to_pylist())
        asked, wanted = q["uid"].to_numpy(), np.array(q["label"].to_pylist())
        for cluster, who in _by_cluster(q):
            lists = Lists(len(who), positives)

            def take(active, part, score, who=who, lists=lists):
                fits = (labels[part][None, :] == wanted[who[active]][:, None]) & (uids[part][None, :] != asked[who[active]][:, None])
                i, j = np.nonzero(fits & (score >= lists.least[active][:, None]))
                lists.add(active[i], score[i, j], ids[part[j]], uids[part[j]])

            _walk(a[who], b, c[cluster], lambda lists=lists: lists.least, take)
            cols = [asked[who[lists.key]], lists.order, lists.at, lists.score.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["asked", "positive_id", "found", "positive_score"])

    found = in_cells(asks.select(*names, "cluster", "grp"), own.select(*names), groups, block, same, "asked long, positive_id long, found long, positive_score long")
    order = lambda score, name: [F.col(score).desc(), F.col(name).asc(), F.col("found").asc()]
    pairs = best(found, ["asked"], order("positive_score", "positive_id"), positives, "place").drop("found")
    lists = pairs.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("pairs"))  # ``positives`` at most
    chosen = materialize(asks.join(lists.withColumnRenamed("asked", "uid"), "uid"), "anchors")  # the second walk and the result read it

    def other(q: pa.Table, x: pa.Table):
        a, b, c = widened(matrix(q["vector"]), matrix(x["vector"]), centres)
        ids, uids, labels = x["id"].to_numpy(), x["uid"].to_numpy(), np.array(x["label"].to_pylist())
        asked, wanted, held = q["uid"].to_numpy(), np.array(q["label"].to_pylist()), q["pairs"].to_pylist()
        for cluster, who in _by_cluster(q):
            top = np.full((len(who), positives), np.nan)
            for n, k in enumerate(who):
                for p in held[k]:
                    top[n, p["place"] - 1] = p["positive_score"]
            low, high = window[0] * top, window[1] * top
            lists = Lists(len(who) * positives, negatives)
            floor = np.where(low <= high, low / 100, np.inf)  # no score fits a negative positive

            def needs(lists=lists, floor=floor):
                return np.maximum(floor, lists.least.reshape(floor.shape)).min(axis=1)

            def take(active, part, score, who=who, lists=lists, low=low, high=high):
                apart = labels[part][None, :] != wanted[who[active]][:, None]
                for p in range(positives):
                    key = active * positives + p
                    i, j = np.nonzero(apart & (100 * score >= low[active, p][:, None]) & (100 * score <= high[active, p][:, None]) & (score >= lists.least[key][:, None]))
                    lists.add(key[i], score[i, j], ids[part[j]], uids[part[j]])

            _walk(a[who], b, c[cluster], needs, take)
            cols = [asked[who[lists.key // positives]], (lists.key % positives + 1).astype(np.int32), lists.order, lists.at, lists.score.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["asked", "place", "negative_id", "found", "negative_score"])

    schema = "asked long, place int, negative_id long, found long, negative_score long"
    found = in_cells(chosen.select(*names, "cluster", "grp", "pairs"), own.select(*names), groups, block, other, schema)
    first = best(found, ["asked", "place"], order("negative_score", "negative_id"), negatives, "rank")
    own_pairs = chosen.select(F.col("uid").alias("asked"), F.col("id").alias("anchor_id"), F.inline("pairs"))
    out = first.join(own_pairs, ["asked", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
