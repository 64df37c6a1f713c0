"""Bounded-space online packing of token pieces into windows of a fixed size."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenset.llm.common import materialize, release
from lumenset.llm.tokens import tokenizer

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"
#: Sequence ids: the writer's number in the high bits, its own count in the low ones; merged leftovers above all.
LOW_BITS, MERGED = 32, 1 << 62


class OpenWindows:
    """A fixed number of open windows. ``place`` gives those that closed, as lists of (piece, offset)."""

    def __init__(self, size: int, keep: int):
        self.size, self.keep = size, keep
        self.free: list[tuple[int, int]] = []  # room left and number, ascending
        self.held: dict[int, list] = {}
        self.count = 0

    def place(self, piece, length: int) -> list[tuple[int, list]]:
        """Best fit: the fullest window with room. None fits: a new one, for which the fullest goes if all are open."""
        closed = []
        at = bisect_left(self.free, (length, -1))
        if at == len(self.free):
            if len(self.free) >= self.keep:
                closed.append(self._close(0))
            number, room = self.count, self.size
            self.count += 1
            self.held[number] = []
        else:
            room, number = self.free.pop(at)
        self.held[number].append((piece, self.size - room))
        insort(self.free, (room - length, number))
        if self.free[0][0] == 0:
            closed.append(self._close(0))
        return closed

    def _close(self, at: int) -> tuple[int, list]:
        _, number = self.free.pop(at)
        return number, self.held.pop(number)

    def rest(self) -> list[tuple[int, list]]:
        out = sorted(self.held.items())
        self.free, self.held = [], {}
        return out


def _slices(batch: pa.RecordBatch, column: str, most: int = 6_000_000):
    """Parts of a batch with about ``most`` bytes of text each."""
    size = max(1, batch.column(column).nbytes)
    step = max(1, batch.num_rows * most // size)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 1,
    keep: int = 64,
    merge: int = 32,
) -> DataFrame:
    """Packs each row's ids, with ``end_id`` at their end, into sequences of at most ``size`` ids.

    A row's ids are cut at each multiple of ``size``; its full pieces are sequences of their own, the last one goes to
    the best of ``keep`` open windows of its partition. Windows still open at a partition's end meet those of ``merge``
    partitions in one task, which packs their pieces anew, longest first: at most ``keep * merge`` windows, whatever the
    input. No hot key exists, as nothing is dealt out by one.

    Columns: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text gives the end
    id alone. Repeated rows are packed once each. Other columns of ``docs`` are not read, so their names don't matter.
    An empty input gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("words"))
    kind = docs.schema["key"].dataType.simpleString()
    out_schema = f"key {kind}, {PIECE}, sequence_id long, offset long, open boolean"

    def run(batches):
        tok, windows, writer, full = tokenizer(tokenizer_path), OpenWindows(size, keep), TaskContext.get().partitionId(), 0
        key_type, rows = None, []

        def emit(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.bool_())],
                ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"],
            )

        def close(closed, still=False):
            for number, pieces in closed:
                rows.extend((*p, writer << LOW_BITS | 2 * number, offset, still) for p, offset in pieces)

        for batch in (part for whole in batches for part in _slices(whole, "words")):
            key_type = batch.column("key").type
            ids, starts = tok.batch(batch.column("words"))
            for k, key in enumerate(batch.column("key").to_pylist()):
                own = np.append(ids[starts[k] : starts[k + 1]], end_id).astype("<u4")
                for at in range(0, len(own), size):
                    cut = own[at : at + size]
                    piece = (key, at, len(cut), zlib.crc32(cut.tobytes()), len(own))
                    if len(cut) == size:
                        rows.append((*piece, writer << LOW_BITS | 2 * full + 1, 0, False))
                        full += 1
                    else:
                        close(windows.place(piece, len(cut)))
            del ids, starts
            if rows:
                yield emit(rows)
                rows = []
        close(windows.rest(), still=True)
        if rows:
            yield emit(rows)
        release()

    placed = materialize(docs.mapInArrow(run, out_schema), "packed")

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        """The pieces of a few partitions' open windows, longest first."""
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        windows, where = OpenWindows(size, len(pdf) + 1), {}
        for i, n in enumerate(pdf["length"]):
            for number, pieces in windows.place(i, int(n)):
                where.update((p, (number, offset)) for p, offset in pieces)
        for number, pieces in windows.rest():
            where.update((p, (number, offset)) for p, offset in pieces)
        base = MERGED | int(pdf["team"].iloc[0]) << LOW_BITS
        return pdf.assign(sequence_id=[base | where[i][0] for i in range(len(pdf))], offset=[where[i][1] for i in range(len(pdf))])

    left = placed.filter("open").withColumn("team", F.shiftright("sequence_id", LOW_BITS).cast("long") / merge)
    left = left.withColumn("team", F.floor("team"))
    merged = left.groupBy("team").applyInPandas(again, left.schema)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return (
        placed.filter("not open").select("key", *names).unionByName(merged.select("key", *names)).withColumnRenamed("key", id_col)
    )
