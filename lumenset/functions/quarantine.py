"""Errors as data: a step's failures go to a table of their own, and the rest goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenset.functions.storage import materialize

REASON = "_reason"


def _tried(step: Callable[[pd.DataFrame], pd.DataFrame], part: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, str | None]]:
    """The step's results; where it fails on several rows, on each half of them, down to the rows that are at fault."""
    try:
        out = step(part.reset_index(drop=True))
    except Exception as e:  # noqa: BLE001  the step is the caller's, and any failure of it is a row's
        if len(part) == 1:
            yield part, f"{type(e).__name__}: {e}"
            return
        half = len(part) // 2
        yield from _tried(step, part.iloc[:half])
        yield from _tried(step, part.iloc[half:])
        return
    yield out, None


def isolated(rows: DataFrame, key: str, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, attempts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``step`` makes of ``rows``, and the rows on which it fails: (``key``, reason, attempts). Both are written, by one run.

    ``step`` takes some rows as a pandas frame and returns a frame of ``schema``, which has ``key``; it may fail on any of them. A batch that fails is
    tried again by halves, so one bad row costs the logarithm of the batch. The step may see a row several times, so it should only compute.
    ``attempts`` (``key``, attempts): earlier ones, which count. A lost worker isn't a failure of a row: Spark runs its task again.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for out, reason in _tried(step, frame) if len(frame) else ():
                part = out[names] if reason is None else out[[key]].reindex(columns=names)
                yield part.assign(**{REASON: reason})

    whole = materialize(rows.mapInPandas(run, f"{schema}, {REASON} string"), "isolated")
    bad = whole.filter(F.col(REASON).isNotNull()).select(key, F.col(REASON).alias("reason"))
    if attempts is None:
        bad = bad.withColumn("attempts", F.lit(1).cast("long"))
    else:
        bad = bad.join(attempts.select(key, F.col("attempts").alias("_before")), key, "left").select(key, "reason", (F.coalesce("_before", F.lit(0)) + 1).cast("long").alias("attempts"))
    return whole.filter(F.col(REASON).isNull()).drop(REASON), bad


def retried(rows: DataFrame, key: str, quarantine: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Runs the step again on quarantined rows with fewer than ``most`` attempts: what it makes of them, and the new quarantine.

    Rows that were given up stay in the quarantine as they are; those that are gone from ``rows`` leave it.
    """
    open_ = quarantine.filter(F.col("attempts") < most)
    good, bad = isolated(rows.join(open_.select(key), key, "left_semi"), key, step, schema, open_)
    return good, bad.unionByName(quarantine.filter(F.col("attempts") >= most).select(key, "reason", "attempts"))
