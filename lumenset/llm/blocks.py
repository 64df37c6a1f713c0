"""Queries against all rows, in cells of a group of queries and a block of rows; pieces that vector searches share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenset.llm.common import materialize


def usable(vector: str) -> Column:
    """Whether a vector is there, and all its components are and are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """A written table of ``rows`` with a number ``uid`` that tells equal rows apart."""
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), name)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors in double precision; shorter ones are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(size.max()) if len(size) else 0
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def widened(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices with zeros added until all are as wide as the widest."""
    width = max(m.shape[1] for m in matrices)
    return [m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices]


#: Rows of a block at most, about; small tables have blocks of fewer rows, but of this many at least, so that all cores have one.
BLOCK, SMALL = 32_768, 1024


def in_cells(queries: DataFrame, items: DataFrame, groups: int, block: int, run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` on each group of queries with each block of items: every query meets every item in one cell.

    Both sides have a column ``uid``; ``queries`` has ``grp``, from 0 to ``groups`` - 1. A block has about ``block`` items at most,
    dealt by a hash of their number, so neither a common vector nor a common id fills one. A task goes through its cells
    in sorted order and holds one at a time; a lost executor costs the cells it was at.
    """
    n = items.count()
    blocks = max(1, -(-n // block), min(n // SMALL, items.sparkSession.sparkContext.defaultParallelism))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = queries.withColumns({"blk": every(blocks), "asks": F.lit(True)})
    others = items.withColumns({"grp": every(groups), "blk": F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"), "asks": F.lit(False)})
    both = asks.withColumn("grp", F.col("grp").cast("int")).unionByName(others, allowMissingColumns=True)
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(max(n, min(groups * blocks, 4 * n)), "grp", "blk").sortWithinPartitions("grp", "blk", F.col("asks").desc(), "uid")

    def cells(batches):
        held: list[pa.RecordBatch] = []
        at = None

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            asking = table["asks"]
            one, two = table.filter(asking), table.filter(pc.invert(asking))
            if one.num_rows and two.num_rows:
                yield from run(one, two)

        for batch in batches:
            g, b = (batch[c].to_numpy(zero_copy_only=False) for c in ("grp", "blk"))
            edge = 1 + np.flatnonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1])) if len(g) else []
            for s, e in zip([0, *edge], [*edge, len(g)], strict=True):
                if s == e:
                    continue
                if at is not None and at != (g[s], b[s]):
                    yield from done()
                    held = []
                at = (g[s], b[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield from done()

    return dealt.mapInArrow(cells, schema)


def best(rows: DataFrame, keys: list[str], order: list[Column], most: int, rank: str) -> DataFrame:
    """The first ``most`` rows of each key, numbered from 1; those of each task are cut to as many before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(rank, place).filter(F.col(rank) <= most)


class Lists:
    """The best ``most`` (score, number) of each key, greatest score first, ties by the least number; grown in steps."""

    def __init__(self, keys: int, most: int):
        self.most = most
        self.key, self.score, self.order, self.at = (np.zeros(0, dtype=t) for t in (np.int64, np.float64, np.int64, np.int64))
        self.least = np.full(keys, -np.inf)  # the score of the last place; open places have none

    def add(self, key: np.ndarray, score: np.ndarray, order: np.ndarray, at: np.ndarray) -> None:
        if not len(key):
            return
        key, score, order, at = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.order, order), (self.at, at)))
        by = np.lexsort((at, order, -score, key))
        key, score, order, at = key[by], score[by], order[by], at[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        last = place == self.most - 1
        self.least[key[last]] = score[last]
        kept = place < self.most
        self.key, self.score, self.order, self.at = key[kept], score[kept], order[kept], at[kept]
