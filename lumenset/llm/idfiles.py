"""Token ids in binary files: one zstandard frame for each document, with a dictionary that all frames share.

A shard file: 8 bytes ``LSIDS001``; the dictionary's hash (XXH64, 8 bytes; 0 for none); width of an id in bytes (4
bytes); the frames; the index (for each document: doc_id, a null flag, place, length of the frame, ids: five 64-bit
integers); the index's place and its number of documents (8 bytes each). All integers are little-endian. A document is
read with three reads, whatever the shard's size: the file's end, the index, its frame.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenset.llm.common import fresh_path, materialize, release
from lumenset.llm.packing import _slices
from lumenset.llm.tokens import tokenizer

MAGIC = b"LSIDS001"
HEAD = len(MAGIC) + 12
INDEX = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("at", "<i8"), ("size", "<i8"), ("n", "<i8")])
MANIFEST = "shard long, file string, n_docs long, n_tokens long, least long, greatest long"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def train_dictionary(docs: DataFrame, tokenizer_path: str, sample: int = 2000, most_chars: int = 20_000, size: int = 65_536) -> bytes:
    """A zstandard dictionary from at most ``sample`` texts, those with the least hash; of longer ones a part of ``most_chars`` characters.

    Where that part begins follows from the hash. Hashes alone find the bound, so that no task gathers texts from all
    others. Repeated rows count once. Too few or too uniform texts for the trainer give no dictionary: empty bytes.
    """
    h = F.xxhash64("doc_id", "text")
    at = F.pmod(h, F.greatest(F.lit(1).cast("long"), F.length("text") - most_chars + 1)).cast("int") + 1
    few = docs.select(F.substr("text", at, F.lit(most_chars)).alias("text"), h.alias("h"))
    bound = few.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    few = few.filter(F.col("h") <= F.lit(bound)).groupBy("h").agg(F.min("text").alias("text")).select("text")

    def run(batches):
        tok = tokenizer(tokenizer_path)
        for batch in batches:
            ids, starts = tok.batch(batch.column(0))
            kind = _width(tok)
            yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].astype(kind).tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in few.mapInArrow(run, "ids binary").collect() if r.ids]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _width(tok) -> str:
    return "<u2" if len(tok.spaced) <= 1 << 16 else "<u4"


def write(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, shards: int | None = None, level: int = 3, dictionary: bytes | None = None
) -> tuple[DataFrame, str]:
    """Writes the ids of each text, ``end_id`` after them, in ascending doc_id order; gives the manifest and the folder.

    One shuffle by ranges of doc_id puts each shard's documents in order. A task names its file anew at each attempt,
    and only files that the written manifest names count, so a lost executor leaves no half shard behind. Null doc_ids
    come first; rows with the same doc_id are ordered by a hash of their texts, so that they may fall into several shards.
    A null text counts as empty: the end id alone. No other column is read. An empty input gives an empty manifest. The
    manifest has each shard's least and greatest doc_id (null: none but null).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer_path)
    folder = fresh_path(spark, "ids")
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary") as f:
        f.write(dictionary)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        tok, shard = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        kind = _width(tok)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        fs, path = _open(folder)
        name, index, at, tokens = f"shard-{shard:07d}-{uuid.uuid4().hex}", [], HEAD, 0
        out = None
        for batch in (part for whole in batches for part in _slices(whole, "text")):
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}")
                out.write(MAGIC + np.array([dictionary_hash(dictionary)], "<u8").tobytes() + np.array([int(kind[-1])], "<u4").tobytes())
            ids, starts = tok.batch(batch.column("text"))
            for k, key in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[starts[k] : starts[k + 1]], end_id).astype(kind)
                frame = zip_.compress(own.tobytes())
                out.write(frame)
                index.append((key or 0, key is None, at, len(frame), len(own)))
                at, tokens = at + len(frame), tokens + len(own)
        release()
        if out is not None:
            out.write(np.array(index, dtype=INDEX).tobytes() + np.array([at, len(index)], "<i8").tobytes())
            out.close()
            known = [x[0] for x in index if not x[1]] or [None]
            cols = [shard, name, len(index), tokens, known[0], known[-1]]
            kinds = [pa.string() if c == "file" else pa.int64() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(cols, kinds, strict=True)], names)

    names = [x.split()[0] for x in MANIFEST.split(", ")]
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    placed = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return materialize(placed.mapInArrow(run, MANIFEST), "ids-manifest"), folder


def dictionary_hash(dictionary: bytes) -> int:
    return xxhash.xxh64_intdigest(dictionary) if dictionary else 0


class Shard:
    """Reads one shard file, checking that the dictionary is the one it was written with."""

    def __init__(self, fs, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head = self.file.read_at(HEAD, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no file of ids")
        if np.frombuffer(head[8:16], "<u8")[0] != dictionary_hash(dictionary):
            raise ValueError(f"{path} was written with another dictionary")
        self.kind = f"<u{np.frombuffer(head[16:20], '<u4')[0]}"
        at, n = np.frombuffer(self.file.read_at(16, size - 16), "<i8")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the shard's document number k."""
        row = self.index[k]
        return np.frombuffer(self.unzip.decompress(self.file.read_at(int(row["size"]), int(row["at"]))), self.kind).astype("<u4")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The documents of all shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard, frame_bytes."""
    spark = manifest.sparkSession
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/dictionary") as f:
        dictionary = f.read()
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.withColumn("before", before).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")

    def run(frames):
        fs, path = _open(folder)
        for pdf in frames:
            for row in pdf.itertuples():
                shard, start = Shard(fs, f"{path}/{row.file}", dictionary), row.before
                for a in range(0, len(shard.index), 10_000):
                    index = shard.index[a : a + 10_000]
                    crc = [zlib.crc32(shard.ids(a + k).tobytes()) for k in range(len(index))]
                    starts = start + np.concatenate([[0], np.cumsum(index["n"])])
                    start = starts[-1]
                    doc_id = pd.Series(index["doc_id"].astype("int64"), dtype="Int64").mask(index["null"] == 1)
                    yield pd.DataFrame({"doc_id": doc_id, "start": starts[:-1], "n_tokens": index["n"], "ids_crc32": crc, "shard": row.shard, "frame_bytes": index["size"]})

    return parts.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, frame_bytes long")


def fetch(spark: SparkSession, manifest: DataFrame, folder: str, doc_id: int) -> np.ndarray:
    """One document's ids: three reads in each shard that may have it by the manifest."""
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/dictionary") as f:
        dictionary = f.read()
    for row in manifest.filter(F.lit(doc_id).between(F.col("least"), F.col("greatest"))).orderBy("shard").toLocalIterator():
        shard = Shard(fs, f"{path}/{row.file}", dictionary)
        hit = np.flatnonzero((shard.index["doc_id"] == doc_id) & (shard.index["null"] == 0))
        if len(hit):
            return shard.ids(int(hit[0]))
    raise KeyError(doc_id)
