"""Small pieces that several operators share: words and hashes; written tables come from the library."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.functions.storage import discard, fresh_path, materialize, shared_dir  # noqa: F401

#: The separators of words: space and U+0009 to U+000D. ``bytes.split()`` splits at just these six.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(column: str = "text") -> Column:
    """The text's UTF-8 bytes (null: empty), which Python splits into words without decoding them."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a whole text (null: empty): h1 and h2, two hashes with different seeds."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release() -> None:
    """Gives memory that Arrow and the C library hold, but don't use, back to the system; a worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_FACTOR = 0x9E3779B97F4A7C15


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of ``width`` word hashes; of the whole sequence where it is shorter; none for none.

    A polynomial in the words' hashes, put together from runs whose lengths are powers of two.
    """
    if not len(words):
        return words
    width = min(width, len(words))
    factor = lambda n: np.uint64(pow(_FACTOR, n, 1 << 64))
    out, have, part, size = None, 0, words, 1
    while True:
        if width & size:
            out = part if out is None else out[: len(words) - have - size + 1] * factor(size) + part[have:]
            have += size
        if have == width:
            return mixed(out + np.uint64(width))
        part, size = part[:-size] * factor(size) + part[size:], 2 * size
