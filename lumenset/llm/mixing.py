"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.llm.common import WORD, discard, free_name, materialize
from lumenset.operators.scores import global_place


def n_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size, target for a written table (source, source_size) with a row for each source.

    Sources weigh ``weights``, repeating, in code-point order, null last, and share the sum of all sizes. A target stops
    at ``most`` times its source's size; the excess is shared out again by weight until none is above. Each round is one
    aggregate over the table of sources, of which only the sums come to the driver; a round that stops no more targets is
    the last one. Sources are numbered by ranges, not in one task.
    """
    numbered = global_place(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("most")), "sources")
    level = None
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("most")
        s = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("most"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("weight")
        ).first()
        if not s["weight"]:
            break
        new = (float(s["all"]) - float(s["full"] or 0)) / s["weight"]
        if level is not None and new <= level:
            break
        level = new
    target = F.least(F.col("most"), F.col("weight") * F.lit(level or 0.0))
    return sources.select("source", "source_size", target.cast("double").alias("target"))


#: Seeds that a source's draws may have.
SEEDS = 64


def _draw(key: Column, seed: Column) -> Column:
    """A number from 0 to 1 that a row's hash and a seed give."""
    return F.pmod(F.xxhash64(key, seed), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mixed_rows(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights=(5, 2, 1), most: float = 3.0) -> DataFrame:
    """``docs`` with one more column (struct ``mix``: size, source_size, target, copies).

    A source's rate is its target over its size; each row is taken floor(rate) times, and once more with the rate's fraction
    as its probability: if the number drawn from its key, text and a seed is under it. Each source has the one of ``SEEDS`` seeds
    whose draws bring its words nearest to its target, so that small sources come near theirs too; for a given seed every
    row's draw is its own. Reruns agree, and no source is gathered: the words that each seed would take are summed up before the shuffle. Repeated rows draw the
    same number. Null texts have size 0, null sources are a source. The table of sources is joined as Spark sees fit.
    """
    mix = free_name(docs, "mix")
    size, key = n_words(F.col(text_col)), F.xxhash64(F.col(key_col), F.col(text_col), F.lit(seed))
    rows = materialize(docs.select(F.col(source_col).alias("s"), size.alias("size"), key.alias("key")), "sizes")
    sizes = materialize(rows.groupBy(F.col("s").alias("source")).agg(F.sum("size").alias("source_size")), "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = materialize(source_targets(sizes, weights, most).select("source", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part")), "targets")
    taken = [F.sum(F.when(_draw(F.col("key"), F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"w{k}") for k in range(SEEDS)]
    sums = rows.join(targets, F.col("s").eqNullSafe(F.col("source"))).groupBy("source", "source_size", "target", "whole", "part").agg(*taken)
    off = [F.struct(F.abs(F.col(f"w{k}") - F.col("part") * F.col("source_size")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]
    chosen = materialize(sums.select("source", "source_size", "target", "whole", "part", F.least(*off)["seed"].alias("seed")), "seeds")
    own = docs.join(chosen.select(F.struct("*").alias(mix)), F.col(source_col).eqNullSafe(F.col(f"{mix}.source")), "left")
    copies = F.col(f"{mix}.whole") + (_draw(key, F.col(f"{mix}.seed")) < F.col(f"{mix}.part")).cast("long")
    discard(rows)
    return own.select(*docs.columns, F.struct(size.alias("size"), F.col(f"{mix}.source_size"), F.col(f"{mix}.target"), copies.alias("copies")).alias(mix))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it."""
    rows = mixed_rows(docs, **options)
    mix = next(c for c in rows.columns if c not in docs.columns)
    return rows.filter(F.col(f"{mix}.copies") > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(f"{mix}.copies"))).alias(mix)).select(docs.columns)
