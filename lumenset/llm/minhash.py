"""One-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.llm.common import mixed, shingle_hashes

BINS, BITS, WIDTH = 512, 4, 5
#: Where each empty bin looks: the filled bin with the least number in its row of this table, an endless probe sequence.
_PROBES: dict[int, np.ndarray] = {}


def _probes(bins: int) -> np.ndarray:
    if bins not in _PROBES:
        _PROBES[bins] = (mixed(np.arange(1, bins * bins + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(bins, bins)
    return _PROBES[bins]


def fingerprint(text: bytes, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> bytes:
    """Packed low-order bits of the least shingle hash in each bin; no words: no bytes.

    ``bins`` is a power of two, ``bits`` 1, 2, 4 or 8. Each shingle is hashed once: its high bits choose the bin, the
    others are its value. Words are taken as they are; fewer than ``width`` words are one shingle.
    """
    words = text.split()
    if not words:
        return b""
    h = np.sort(shingle_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), width))
    bin_ = (h >> np.uint64(64 - int(bins).bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bin_[1:] != bin_[:-1]]))
    filled, values = bin_[first], np.zeros(bins, dtype=np.uint8)
    values[filled] = (h[first] & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        values[empty] = values[filled[_probes(bins)[empty[:, None], filled].argmin(axis=1)]]
    unpacked = (values[:, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(unpacked.reshape(-1)).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """The estimated Jaccard similarity of the shingle sets: equal values less those expected by chance, in 0 to 1."""
    if not a or not b:
        return float(a == b)
    diff = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits)
    same = 1 - diff.any(axis=1).mean()
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprints(text_col: str = "text", bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> Column:
    """The fingerprint of a text column as hexadecimal digits; null counts as empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, bins, bits, width).hex())

    return run(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def likenesses(a: Column, b: Column, bits: int = BITS) -> Column:
    """The likeness of two columns of fingerprints."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(bytes.fromhex(i), bytes.fromhex(j), bits) for i, j in zip(x, y, strict=True)])

    return run(a, b)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows dealt so that each stands before the next one by descending id: columns part, halo, k, key, words, ordered.

    Ids fall into ranges by approximate quantiles. The first row of a range goes to the range before it as well (marked
    ``halo``), so one shuffle of the texts serves all; the last range's is the first of all. Equal ids are ordered by text,
    null ids come last. Only the ranges' bounds and first ids come to the driver.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    null = -(1 << 63)
    own = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(text_col, F.lit("")).alias("words"))
    own = own.withColumn("k", F.coalesce("key", F.lit(null)))
    bounds = own.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10_000).alias("b")).first().b or []
    bounds = sorted(set(bounds))
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)] or [[]]
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<long>")
    under = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("k")))
    # the group of bounds first, then the place in it: the square root of their number twice, for each row
    group = F.greatest(under(longs([g[0] for g in groups if g])) - 1, F.lit(0))
    part = group * wide + under(F.get(F.array(*map(longs, groups)), group))
    heads = sorted((r.part, r.k) for r in own.select(part.alias("part"), "k").groupBy("part").agg(F.max("k").alias("k")).collect())
    head, goes = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (p, k) in enumerate(heads):
        head[p], goes[p] = k, heads[(i + 1) % len(heads)][0]
    halo = F.when(F.col("k") == F.get(longs(head), part), F.get(longs(goes), part).cast("int"))
    here = F.struct(part.alias("part"), F.lit(False).alias("halo"))
    there = F.struct(halo.alias("part"), F.lit(True).alias("halo"))
    own = own.withColumn("p", F.explode(F.when(halo.isNull(), F.array(here)).otherwise(F.array(here, there)))).select("p.part", "p.halo", "k", "key", "words")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(n, "part").sortWithinPartitions("part", "halo", F.col("k").desc(), "words")


def neighbour_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """Each text's fingerprint against those of an edited text and of the next row by descending id (the last's: the first).

    The edited text has its last floor(n_chars / 3) code points replaced by the next text's first as many, or all of
    them. A null text counts as empty; two texts without words have likeness 1, one with and one without 0. Repeated
    ids are ordered by text. Other columns aren't read. An empty input gives no rows.
    """
    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(frames):
        fp = lambda s: fingerprint(s.encode(), bins, bits, width)
        last, at_part, done = None, None, False  # the row that waits for its next one; whether the part's halo was met
        for pdf in frames:
            out = []
            for part, halo, key, text in zip(pdf["part"], pdf["halo"], pdf["key"], pdf["words"], strict=True):
                if part != at_part:
                    last, at_part, done = None, part, False
                if done:
                    continue
                own = (key, text, fp(text))
                if last is not None:
                    n = len(last[1])
                    edited = last[1][: n - n // 3] + text[: n // 3]
                    e = fp(edited)
                    out.append((last[0], n, hashlib.sha256(edited.encode()).hexdigest(), last[2].hex(), e.hex(), likeness(last[2], e, bits), likeness(last[2], own[2], bits)))
                last, done = own, bool(halo)
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
            yield frame.astype({id_col: "Int64"})

    return with_next(docs, id_col=id_col, text_col=text_col, parts=parts).select("part", "halo", F.col("key"), "words").mapInPandas(run, schema)
