"""Greedy selection of a diverse set, many picks a pass.

A pick changes what every other candidate is worth, so the plain loop goes through the pool once a pick. But worths only
fall (but for the penalty of crowded places, which has a bound of its own): what a candidate was worth at an earlier
moment is at least what it is worth now. So each pass writes, for all candidates, their distance to the picks and their
worth; the few that are worth most come to the driver, and picks are settled among them for as long as the best is worth
more than the first that didn't come was. Then the pool is brought up to date with all these picks at once. The result
is that of the plain loop.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.functions.arrays import matrix
from lumenset.functions.storage import discard, materialize
from lumenset.operators.selection import quotas
from lumenset.operators.vectors import RADIUS, unit

#: Weights of quality, diversity and subject (without a subject: of the first two), the cosine from which two media
#: are copies, and the penalty of crowded places: its weight, the share of picks allowed near by, and from how many picks on.
SUBJECT_WEIGHTS, NEUTRAL_WEIGHTS = (0.32, 0.40, 0.28), (0.45, 0.55, 0.0)
NEAR_DUPLICATE = 0.92
CROWDED, ALLOWED, FROM_PICKS = 0.85, 0.22, 4
BUILDER_WEIGHTS = (0.3, 0.7, 0.0)

#: Candidates that come to the driver in a pass, and how many picks the bound of a penalty looks ahead.
FETCHED, AHEAD = 1024, 64
DIGITS = 9


@dataclass(frozen=True)
class Worth:
    """What a candidate is worth: weights of quality, diversity, subject; the cosine distance that counts as full diversity; whether
    crowded places lose; and whether copies of picks (by cosine or group) are passed over."""

    weights: tuple[float, float, float] = NEUTRAL_WEIGHTS
    full: float = RADIUS
    rebalance: bool = False
    veto: bool = True

    def gain(self, far):
        return np.minimum(1.0, far / self.full)

    def of(self, score, subject, far, near, taken: int, ahead: int = 0):
        """The worth after ``taken`` picks; with ``ahead``, what it may come to at most within so many more."""
        quality, diversity, match = self.weights
        base = quality * score / 100 + diversity * self.gain(far) + match * subject
        if self.rebalance and taken >= FROM_PICKS:
            base = base - CROWDED * np.maximum(0.0, near / (taken + ahead) - ALLOWED)
        return np.round(base, DIGITS)


@dataclass
class Picks:
    """Picks that the written pool doesn't show yet."""

    ids: list[int] = field(default_factory=list)
    groups: set = field(default_factory=set)
    rows: list[tuple[int, float, bool]] = field(default_factory=list)  # place, gain, whether it is a copy
    vectors: list[np.ndarray] = field(default_factory=list)


STATE = "id long, bucket string, favorite boolean, eligible boolean, scored boolean, score double, subject double, grp long, u array<double>, far double, near double, copy boolean, worth double, bound double, place long, gain double, near_dup boolean"


class Pool:
    """The candidates between passes: a written table, replaced in each."""

    def __init__(self, candidates: DataFrame, worth: Worth, fetched: int = FETCHED):
        self.worth, self.fetched, self.taken, self.pending, self.passes = worth, fetched, 0, Picks(), 0
        optional = lambda c, kind, other: F.coalesce(F.col(c), F.lit(other)).cast(kind) if c in candidates.columns else F.lit(other).cast(kind)
        has = F.col("vector").isNotNull() & (F.size("vector") > 0)
        self.state = materialize(
            candidates.select(
                F.col("id").cast("long"), F.col("bucket").cast("string"), optional("favorite", "boolean", False).alias("favorite"), optional("eligible", "boolean", True).alias("eligible"),
                F.col("score").isNotNull().alias("scored"), optional("score", "double", 0.0).alias("score"), optional("subject", "double", 0.0).alias("subject"),
                (F.col("group_id") if "group_id" in candidates.columns else F.lit(None)).cast("long").alias("grp"), F.when(has, unit()).alias("u"),
                F.when(has, 2.0).otherwise(0.0).alias("far"), F.lit(0.0).alias("near"), F.lit(False).alias("copy"), F.lit(0.0).alias("worth"), F.lit(0.0).alias("bound"),
                F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("gain"), F.lit(None).cast("boolean").alias("near_dup"),
            ), "pool",
        )
        self.fold()

    def fold(self) -> None:
        """Writes the pool anew, with the picks since the last time: one pass over it, whatever their number."""
        worth, picks, taken = self.worth, self.pending, self.taken
        at = dict(zip(picks.ids, picks.rows, strict=True))
        names = [f.split()[0] for f in STATE.split(", ")]

        def run(batches):
            for batch in batches:
                col = {c: batch[c] for c in names}
                u, has = matrix(batch["u"], max([0, *map(len, picks.vectors)]))
                far, near, copy = (col[c].to_numpy(zero_copy_only=False).copy() for c in ("far", "near", "copy"))
                if picks.vectors and len(u):
                    wide = np.zeros((len(picks.vectors), u.shape[1]))
                    for row, v in zip(wide, picks.vectors, strict=True):
                        row[: len(v)] = v
                    cosine = u @ wide.T
                    far = np.where(has, np.minimum(far, np.clip(1 - cosine.max(axis=1), 0, None)), 0.0)
                    near += np.where(has, (np.clip(1 - cosine, 0, None) < RADIUS).sum(axis=1), 0)
                    copy |= has & (cosine.max(axis=1) >= NEAR_DUPLICATE)
                if picks.groups:
                    copy |= np.array([g in picks.groups for g in col["grp"].to_pylist()], dtype=bool)
                score, subject = (col[c].to_numpy(zero_copy_only=False) for c in ("score", "subject"))
                col |= {"far": far, "near": near, "copy": copy, "worth": worth.of(score, subject, far, near, taken), "bound": worth.of(score, subject, far, near, taken, AHEAD)}
                old = list(zip(*(batch[c].to_pylist() for c in ("id", "place", "gain", "near_dup")), strict=True))
                new = [at.get(i, rest) for i, *rest in old]
                for k, (c, kind) in enumerate((("place", pa.int64()), ("gain", pa.float64()), ("near_dup", pa.bool_()))):
                    col[c] = pa.array([r[k] for r in new], kind)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in col.values()], names)

        written = materialize(self.state.mapInArrow(run, STATE), "pool")
        discard(self.state)
        self.state, self.pending, self.passes = written, Picks(), self.passes + 1

    def _rows(self, where: Column, order: list[Column], most: int):
        """The first rows of those not taken, as arrays."""
        if self.pending.ids:
            self.fold()
        rows = self.state.filter(F.col("place").isNull() & where).orderBy(*order).limit(most).toArrow()
        out = {c: rows[c].to_numpy() for c in ("id", "scored", "score", "subject", "far", "near", "copy", "bound")} | {"grp": rows["grp"].to_pylist()}
        out["u"], out["has"] = matrix(rows["u"])
        out["far"], out["near"], out["copy"] = out["far"].copy(), out["near"].copy(), out["copy"].copy()
        return out

    def _take(self, rows: dict, i: int, near_dup: bool) -> None:
        """Settles a row, and tells the other rows."""
        p, u = self.pending, rows["u"][i]
        p.ids.append(int(rows["id"][i]))
        p.rows.append((self.taken, float(self.worth.gain(rows["far"][i])), near_dup))
        self.taken += 1
        if (g := rows["grp"][i]) is not None:
            p.groups.add(g)
            rows["copy"] |= np.array([x == g for x in rows["grp"]])
        if rows["has"][i]:
            p.vectors.append(u)
            cosine = rows["u"] @ u
            distance = np.clip(1 - cosine, 0, None)
            rows["far"] = np.where(rows["has"], np.minimum(rows["far"], distance), 0.0)
            rows["near"] += rows["has"] & (distance < RADIUS)
            rows["copy"] |= rows["has"] & (cosine >= NEAR_DUPLICATE)

    def take_listed(self, ids: list[int]) -> None:
        """Takes these, in their order, eligible or not; those that the pool lacks or that are taken are passed over."""
        ids = list(dict.fromkeys(ids))
        for k in range(0, len(ids), self.fetched):
            part = ids[k : k + self.fetched]
            rows = self._rows(F.col("id").isin(part), [F.col("id")], len(part))
            place = {int(x): n for n, x in enumerate(rows["id"])}
            for x in part:
                if x in place:
                    self._take(rows, place[x], False)

    def take_favorites(self, where: Column, most: int) -> int:
        """Takes favourites, the best score first (no score: last), then the least id; returns how many."""
        done = 0
        while done < most:
            size = min(self.fetched, most - done)
            rows = self._rows(where & F.col("favorite") & F.col("eligible"), [F.col("scored").desc(), F.col("score").desc(), F.col("id").asc()], size)
            for i in range(len(rows["id"])):
                self._take(rows, i, False)
            done += len(rows["id"])
            if len(rows["id"]) < size:
                break
        return done

    def fill(self, where: Column, most: int, copies: bool = True) -> int:
        """Takes the candidate that is worth most, again and again; without ``copies`` those of picks are passed over. Returns how many."""
        done = 0
        where = where & F.col("eligible") & (F.lit(True) if copies else ~F.col("copy"))
        ties = [F.col("scored").desc(), F.col("score").desc(), F.col("id").asc()]
        while done < most:
            rows = self._rows(where, [F.col("bound").desc(), *ties], self.fetched + 1)
            n = len(rows["id"])
            if not n:
                break
            left = None
            if n > self.fetched:  # what didn't come is worth this at most
                left = (rows["bound"][-1], rows["scored"][-1], rows["score"][-1], -rows["id"][-1])
            open_, before = np.arange(n) < self.fetched, done
            while done < most and (not self.worth.rebalance or left is None or done - before <= AHEAD):
                able = np.flatnonzero(open_ & (copies | ~rows["copy"]))
                if not len(able):
                    break
                worth = self.worth.of(rows["score"][able], rows["subject"][able], rows["far"][able], rows["near"][able], self.taken)
                i = able[np.lexsort((rows["id"][able], -rows["score"][able], ~rows["scored"][able], -worth))[0]]
                if left is not None and (worth.max(), rows["scored"][i], rows["score"][i], -rows["id"][i]) < left:
                    break
                self._take(rows, i, copies and self.worth.veto)
                open_[i] = False
                done += 1
            if done == before:
                if left is None:
                    break
                best = self._rows(where, [F.col("worth").desc(), *ties], 1)  # the penalty hides the best: take it alone
                self._take(best, 0, copies and self.worth.veto)
                done += 1
        return done

    def picked(self) -> DataFrame:
        """(id, bucket, place, gain, near_dup) of all picks: ``gain`` is the diversity that a pick added, ``near_dup`` that it is a copy taken for want of others."""
        if self.pending.ids:
            self.fold()
        return self.state.filter("place is not null").select("id", "bucket", "place", "gain", "near_dup")


def _in_bucket(name: str) -> Column:
    return F.lit(True) if name == "any" else F.col("bucket") == name


def studio_select(
    candidates: DataFrame, size: int, ratios: dict[str, float], *, forced: list[int] = (), dropped: list[int] = (), subject: bool = False, rebalance: bool = False, fetched: int = FETCHED
) -> DataFrame:
    """The studio's proposal: (id, bucket, place, gain, near_dup).

    ``candidates``: id, bucket, favorite, eligible, score (0 to 100 or null), subject (0 to 1), group_id (of lookalikes, or null), vector
    (or null). In this order: forced ids; favourites, best score first, up to ``size``; for each bucket of ``ratios`` (``any``: all) its
    quota by worth, without copies of picks; what is still open from all that are eligible, and only then with copies. Dropped ids
    never enter. Ids are unique. Nulls: no favourite, eligible, no subject. An empty pool gives no rows.
    """
    gone = F.col("id").isin(list(dropped)) if dropped else F.lit(False)
    pool = Pool(candidates.filter(~gone), Worth(SUBJECT_WEIGHTS if subject else NEUTRAL_WEIGHTS, RADIUS, rebalance), fetched)
    pool.take_listed([i for i in forced if i not in set(dropped)])
    pool.take_favorites(F.lit(True), max(0, size - pool.taken))
    for bucket, quota in quotas(size, ratios).items():
        pool.fill(_in_bucket(bucket), min(quota, size - pool.taken), copies=False)
    for copies in (False, True):
        pool.fill(F.lit(True), size - pool.taken, copies=copies)
    return pool.picked()


def pick_diverse(candidates: DataFrame, size: int, weights: dict[str, float], diversity: float = BUILDER_WEIGHTS[1], quality: float = BUILDER_WEIGHTS[0], fetched: int = FETCHED) -> DataFrame:
    """The builder's farthest-point selection: (id, bucket, place).

    ``candidates``: id, bucket, favorite, score (0 to 100, or null), vector. For each bucket of ``weights`` (``any``: all)
    its favourites, best score first, up to the quota; then, one after another, the candidate with the greatest
    diversity * (1 - cosine to the nearest pick) / 2 + quality * score / 100 (no vector: no distance; ties: score, least
    id); what buckets leave open goes to all that are in a bucket.
    """
    pool, wanted = Pool(candidates, Worth((quality, diversity, 0.0), 2.0, veto=False), fetched), quotas(size, weights)
    for bucket, quota in wanted.items():
        n = pool.take_favorites(_in_bucket(bucket), quota)
        pool.fill(_in_bucket(bucket), quota - n)
    every = F.lit(False)
    for bucket in wanted:
        every = every | _in_bucket(bucket)
    if wanted:
        pool.fill(every, size - pool.taken)
    return pool.picked().select("id", "bucket", "place")


def prepared(media: DataFrame, groups: DataFrame, buckets: DataFrame, min_quality: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The builder's candidates, and one row of counters: pool_size, quality_dropped, unscored_dropped, duplicates_dropped, unknown_count.

    ``media``: id, favorite, score (0 to 100 or null), width, height, vector; ``groups``: group_id, id of lookalikes; ``buckets``: id, bucket.
    With a bar, media under it go, and so do those without a score. Of what is left of a group one stays: a favourite, then one
    with a score, the best score, the largest area, the least id. A medium without a bucket is ``unknown``.
    """
    score, low = F.col("score"), F.lit(min_quality > 0)
    own = media.join(groups.select("id", "group_id"), "id", "left").join(buckets.select("id", "bucket"), "id", "left").withColumn("bucket", F.coalesce("bucket", F.lit("unknown")))
    own = own.withColumn("why", F.when(low & score.isNull(), "unscored").when(low & (score < min_quality), "quality"))
    area = F.coalesce(F.col("width"), F.lit(0)).cast("long") * F.coalesce(F.col("height"), F.lit(0)).cast("long")
    rank = F.struct(F.coalesce("favorite", F.lit(False)).alias("favorite"), score.isNotNull().alias("scored"), F.coalesce("score", F.lit(0.0)).alias("score"), area.alias("area"), (-F.col("id")).alias("id"))
    best = own.filter(F.col("why").isNull() & F.col("group_id").isNotNull()).groupBy("group_id").agg(F.max_by("id", rank).alias("keeper"))
    own = own.join(best, "group_id", "left").withColumn("why", F.coalesce("why", F.when(F.col("keeper") != F.col("id"), "duplicate")))
    kept = F.col("why").isNull()
    counters = own.agg(
        F.count_if(kept).alias("pool_size"), F.count_if(F.col("why") == "quality").alias("quality_dropped"), F.count_if(F.col("why") == "unscored").alias("unscored_dropped"),
        F.count_if(F.col("why") == "duplicate").alias("duplicates_dropped"), F.count_if(kept & (F.col("bucket") == "unknown")).alias("unknown_count"),
    )
    return own.filter(kept).select("id", "favorite", "score", "bucket", "vector"), counters
