"""Change propagation between snapshots: keyed differences, and derived tables brought up to date for changed keys alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.functions.storage import materialize


def content(*columns: str) -> tuple[Column, Column]:
    """128 bits of the columns' values, nulls told apart from empty texts: h1 and h2."""
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and change (insert, update, delete) of the keys whose rows aren't the same in both snapshots.

    A key may have several rows; their contents are summed up before the shuffle, whatever their order. Columns other than the
    keys are compared; both snapshots have the same ones. Null keys are a key.
    """
    rest = [c for c in old.columns if c not in keys]

    def summed(df: DataFrame, name: str) -> DataFrame:
        own = df.select(*keys, *content(*rest))
        total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
        return own.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), total("h1").alias("a"), total("h2").alias("b")).alias(name))

    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = summed(old, "was").alias("l").join(summed(new, "now").alias("r"), same, "full")
    change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") != F.col("now"), "update")
    named = [F.when(F.col("was").isNull(), F.col(f"r.{k}")).otherwise(F.col(f"l.{k}")).alias(k) for k in keys]
    return both.select(*named, change.alias("change")).filter("change is not null")


def dependants(changed: DataFrame, links: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """The keys ``of`` of a derived table that hang on changed keys: ``links`` has both."""
    return links.join(changed.select(*keys).distinct(), keys, "left_semi").select(*of).distinct()


def refreshed(derived: DataFrame, changed: DataFrame, keys: list[str], recompute: Callable[[DataFrame], DataFrame], name: str = "derived") -> DataFrame:
    """``derived`` without the changed keys' rows, and with what ``recompute`` makes of them; a written table.

    ``recompute`` gets the changed keys alone (a written table, once each) and returns rows of ``derived``'s columns; for a
    key that is gone it returns none. Rows of other keys are carried over as they are, and nothing that they came from is read.
    """
    touched = materialize(changed.select(*keys).distinct(), f"{name}-keys")
    kept = derived.join(touched, keys, "left_anti").select(*derived.columns)
    return materialize(kept.unionByName(recompute(touched).select(*derived.columns)), name)
