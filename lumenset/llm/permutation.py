"""Approximate nearest neighbours by a permutation index.

A vector goes by its nearest pivots in order. Each block of the index posts its vectors in one inverted file a pivot, with
the pivot's place in the vector's order. A query adds up, over the files of its own nearest pivots, how far apart the two
places are (Spearman's footrule; a pivot that is missing counts as the last place). The part of the block that is nearest
by this distance is compared in the original space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.llm.blocks import BLOCK, best, in_cells, matrix, numbered, usable, widened
from lumenset.llm.common import release

#: Pivots (of a sample of as many vectors, at most half of all), how many a vector is posted under, the part of a block that is reranked
#: and how many rows of it at least.
PIVOTS, POSTED, SHARE, LEAST = 512, 128, 0.45, 256


def pivots_of(vectors: DataFrame, most: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """The vectors with the least hashes of their ids: ``most`` of them, or half of all, but one at least. This bounded sample is all that comes to the driver."""
    n = min(most, max(1, vectors.count() // 2))
    rows = vectors.select("vector", F.xxhash64("id", "vector", F.lit(seed)).alias("h"), "uid").orderBy("h", "uid").limit(n).select("vector").toArrow()
    return matrix(rows["vector"])


def _orders(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first, ties by number."""
    x, pivots = widened(x, pivots)
    return np.argsort((pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T, axis=1, kind="stable")[:, :posted].astype("<u2")


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, posted: int = POSTED) -> DataFrame:
    """The index as a written table (uid, id, vector, places): ``places`` holds the numbers of the nearest pivots, two bytes each.

    Vectors that are null, all zeros or have components that are null or not finite take no part, nor do rows without an
    id. Equal rows are rows of their own. Other columns of ``vectors`` are not read. An empty table makes an empty index.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = numbered(own.filter(F.col("id").isNotNull() & usable("vector")).filter(F.exists("vector", lambda x: x != 0)), "vectors")
    if own.isEmpty():
        return own.withColumn("places", F.lit(None).cast("binary"))
    chosen = pivots_of(own, pivots)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = [r.tobytes() for r in _orders(matrix(batch["vector"]), chosen, posted)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("uid", "id", "vector")), pa.array(rows, pa.binary())], ["uid", "id", "vector", "places"])
        release()

    return own.select("uid", "id", "vector").mapInArrow(run, "uid long, id long, vector array<double>, places binary")


def _places(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype="<u2").reshape(len(raw), -1)


class InvertedFiles:
    """One file a pivot: the rows that have it among their nearest, and its place in their order."""

    def __init__(self, places: np.ndarray):
        self.n, self.posted = places.shape
        flat = places.ravel()
        order = np.argsort(flat, kind="stable")
        self.rows, self.at = (order // self.posted).astype(np.int32), (order % self.posted).astype(np.int32)
        self.start = np.searchsorted(flat[order], np.arange(int(flat.max()) + 2))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """The footrule distance of each row to a query's order."""
        out = np.full(self.n, self.posted * len(query), dtype=np.int32)
        for place, pivot in enumerate(query):
            if pivot + 1 < len(self.start):
                a, b = self.start[pivot], self.start[pivot + 1]
                out[self.rows[a:b]] += np.abs(self.at[a:b] - place) - self.posted
        return out


def search(index: DataFrame, queries: Column, k: int = 10, *, share: float = SHARE, least: int = LEAST, group: int = 1024, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each indexed row for which ``queries`` holds, itself apart.

    ``score`` is the Euclidean distance of the original vectors, in double precision; ties go to the least id. In each
    block the ``share`` nearest by footrule, ``least`` rows at least, are compared. All rows are posted and every query
    looks into every block, so the share is the same at every size. Equal rows are found like any others.
    """
    asks = index.filter(queries)
    groups = max(1, -(-asks.count() // group))
    asks = asks.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))

    def run(q: pa.Table, x: pa.Table):
        a, b = widened(matrix(q["vector"]), matrix(x["vector"]))
        files, ids, uids = InvertedFiles(_places(x["places"])), x["id"].to_numpy(), x["uid"].to_numpy()
        take = min(len(ids), max(least, int(np.ceil(share * len(ids)))) + 1)  # itself may be among them
        out = []
        for i, (uid, order) in enumerate(zip(q["uid"].to_numpy(), _places(q["places"]), strict=True)):
            near = files.footrule(order)
            rows = np.argpartition(near, take - 1)[:take]
            rows = rows[uids[rows] != uid]
            distance = np.sqrt(((b[rows] - a[i]) ** 2).sum(axis=1))
            first = np.lexsort((uids[rows], ids[rows], distance))[:k]
            out.append((np.full(len(first), i), rows[first], distance[first]))
        i, j, d = (np.concatenate(c) for c in zip(*out, strict=True))
        cols = [q["uid"].to_numpy()[i], q["id"].to_numpy()[i], ids[j], uids[j], d]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["asked", "query_id", "vec_id", "found", "score"])

    columns = ["uid", "id", "vector", "places"]
    found = in_cells(asks.select(*columns, "grp"), index.select(*columns), groups, block, run, "asked long, query_id long, vec_id long, found long, score double")
    first = best(found, ["asked"], [F.col("score").asc(), F.col("vec_id").asc(), F.col("found").asc()], k, "rank")
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
