"""Perceptual hashes: distances, near-duplicate pairs and groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenset.operators.graph import components


def from_hex(h: Column) -> tuple[Column, Column]:
    """The two 32-bit halves of 16 hexadecimal digits."""
    half = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    return half(1), half(9)


def similarity_to_distance(similarity: float) -> int:
    return max(0, int((100 - similarity) / 3 + 1e-9))


def distance_to_similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - 3 * distance))


def sign_hashes(vectors: DataFrame) -> DataFrame:
    """id and two 64-bit hashes of a vector: signs, and signs of the steps between neighbours (bit 63: 0)."""

    def packed(bit) -> Column:
        # most significant bit first, in two 32-bit halves, each exact in a long
        half = lambda a: F.aggregate(F.sequence(F.lit(a), F.lit(a + 31)), F.lit(0).cast("long"), lambda acc, i: acc * 2 + bit(i))
        return F.struct(half(0).alias("hi"), half(32).alias("lo"))

    v = F.col("vector")
    p = packed(lambda i: F.when(F.get(v, i) > 0, 1).otherwise(0))
    d = packed(lambda i: F.when((i < 63) & (F.get(v, i + 1) > F.get(v, i)), 1).otherwise(0))
    out = vectors.select("id", p.alias("p"), d.alias("d"))
    return out.select("id", F.col("p.hi").alias("p_hi"), F.col("p.lo").alias("p_lo"), F.col("d.hi").alias("d_hi"), F.col("d.lo").alias("d_lo"))


def distance(a: str, b: str, h: str) -> Column:
    x = lambda half: F.bit_count(F.col(f"{a}.{h}_{half}").bitwiseXOR(F.col(f"{b}.{h}_{half}")))
    return (x("hi") + x("lo")).cast("int")


#: From so many bits on bands are too narrow to tell hashes apart; a tile has about so many hashes.
WIDE, TILE = 8, 4096


def lookalike_pairs(hashes: DataFrame, most: int, tile: int = TILE) -> DataFrame:
    """Pairs a < b whose two hashes both differ in at most ``most`` bits: a, b, p_dist, d_dist.

    Few bits: two hashes within them agree on one of ``most + 1`` bands, so an equi-join on the bands finds every pair, and it counts
    at the first band on which they agree, once. Many bits: bands would be a few bits wide and the join larger than all pairs; hashes lie
    in tiles by their population count, each two tiles whose counts are in reach are compared once, by exclusive-or and bit counts in
    numpy, and a task holds two tiles. Both are exact. Rows with a null hash have no pair.
    """
    known = hashes.filter(F.col("p_hi").isNotNull() & F.col("p_lo").isNotNull() & F.col("d_hi").isNotNull() & F.col("d_lo").isNotNull())
    return _banded(known, most) if most < WIDE else _tiled(known, most, tile)


def _banded(hashes: DataFrame, most: int) -> DataFrame:
    bands, edge = most + 1, [round(64 * i / (most + 1)) for i in range(most + 2)]

    def band(i: int, of: str = "") -> Column:
        a, b = edge[i], edge[i + 1]
        part = lambda lo, hi, col: F.shiftright(F.col(of + col), 32 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        if b <= 32:
            return part(a, b, "p_hi")
        if a >= 32:
            return part(a - 32, b - 32, "p_lo")
        return F.shiftleft(part(a, 32, "p_hi"), b - 32).bitwiseOR(part(0, b - 32, "p_lo"))

    dealt = hashes.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), band(i).alias("value")) for i in range(bands)])))
    a, b = dealt.alias("a"), dealt.alias("b")
    first = F.coalesce(*[F.when(band(i, "a.") == band(i, "b."), i) for i in range(bands)])
    near = (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")) & (first == F.col("a.k.band")) & (distance("a", "b", "p") <= most) & (distance("a", "b", "d") <= most)
    return a.join(b, near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance("a", "b", "p").alias("p_dist"), distance("a", "b", "d").alias("d_dist"))


def _tiled(hashes: DataFrame, most: int, tile: int) -> DataFrame:
    whole = lambda h: F.shiftleft(F.col(f"{h}_hi"), 32).bitwiseOR(F.col(f"{h}_lo"))
    own = hashes.select("id", whole("p").alias("p"), whole("d").alias("d")).withColumn("band", F.floor(F.bit_count("p") / (most + 1)).cast("int"))
    counts = {r.band: r["count"] for r in own.groupBy("band").count().collect()}  # 65 bands at most
    salts = {b: -(-n // tile) for b, n in sorted(counts.items())}
    start, at = {}, 0
    for b, n in salts.items():
        start[b], at = at, at + n
    of = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("band")]
    if not salts:
        return own.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("p_dist"), F.lit(0).alias("d_dist")).limit(0)
    reach = {b: (min(start[x] for x in salts if abs(x - b) <= 1), max(start[x] + salts[x] - 1 for x in salts if abs(x - b) <= 1)) for b in salts}
    own = own.withColumn("tile", (of(start) + F.pmod(F.xxhash64("id"), of(salts))).cast("int"))
    others = F.explode(F.sequence(of({b: lo for b, (lo, _) in reach.items()}), of({b: hi for b, (_, hi) in reach.items()})))
    dealt = own.select("id", "p", "d", "tile", others.alias("other")).select("id", "p", "d", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))

    def run(cell: pa.Table) -> pa.Table:
        tiles, lo, hi = cell["tile"].to_numpy(), cell["lo"][0].as_py(), cell["hi"][0].as_py()
        ids, p, d = cell["id"].to_numpy(), cell["p"].to_numpy().astype(np.uint64), cell["d"].to_numpy().astype(np.uint64)
        x, y, found = np.flatnonzero(tiles == lo), np.flatnonzero(tiles == hi), []
        for k in range(0, len(x), 256):
            i, j = np.nonzero(np.bitwise_count(p[x[k : k + 256], None] ^ p[None, y]) <= most)
            i, j = x[k + i], y[j]
            hit = (np.bitwise_count(d[i] ^ d[j]) <= most) & ((i < j) if lo == hi else (ids[i] != ids[j]))
            found.append(np.stack([i[hit], j[hit]]))
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        far = lambda h: np.bitwise_count(h[i] ^ h[j]).astype(np.int32)
        return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "p_dist": far(p), "d_dist": far(d)})

    return dealt.groupBy("lo", "hi").applyInArrow(run, "a long, b long, p_dist int, d_dist int")


def lookalike_groups(hashes: DataFrame, most: int, rank: DataFrame | None = None) -> DataFrame:
    """Transitive groups of two or more: group_id (least id), id, representative, similarity to it, members.

    ``rank`` (id, score, area, and favorite if there is one) chooses the representative: a favourite, then the best score, then area, then least id.
    """
    hash_ = ["p_hi", "p_lo", "d_hi", "d_lo"]
    alike = hashes.groupBy(*hash_).agg(F.min("id").alias("id"))  # equal hashes are one row among the pairs, and a star
    same = hashes.join(alike.withColumnRenamed("id", "b"), hash_).filter("id <> b").select(F.col("id").alias("a"), "b")
    links = lookalike_pairs(alike, most).select("a", "b").unionByName(same)
    roots = components(links).select(F.col("node").alias("id"), F.col("root").alias("group_id"))
    own = roots.join(hashes, "id")
    own = own.join(rank, "id", "left") if rank is not None else own.withColumns({"score": F.lit(None).cast("double"), "area": F.lit(None).cast("long")})
    own = own if "favorite" in own.columns else own.withColumn("favorite", F.lit(False))
    best = own.groupBy("group_id").agg(
        F.max_by("id", F.struct(F.coalesce("favorite", F.lit(False)), F.coalesce("score", F.lit(-1.0)), F.coalesce("area", F.lit(0).cast("long")), -F.col("id"))).alias("representative"), F.count("*").alias("members")
    )
    rep = best.join(hashes.withColumnRenamed("id", "representative"), "representative").select("group_id", "representative", "members", *[F.col(c).alias(f"r_{c}") for c in ("p_hi", "p_lo", "d_hi", "d_lo")])
    own = own.join(rep, "group_id")
    dist = lambda h: F.bit_count(F.col(f"{h}_hi").bitwiseXOR(F.col(f"r_{h}_hi"))) + F.bit_count(F.col(f"{h}_lo").bitwiseXOR(F.col(f"r_{h}_lo")))
    similarity = distance_to_similarity(F.greatest(dist("p"), dist("d")))
    return own.select("group_id", "id", "representative", similarity.cast("long").alias("similarity"), "members")


def keep_best(groups: DataFrame) -> DataFrame:
    """What may go: every member but its group's representative."""
    return groups.filter(F.col("id") != F.col("representative")).select("id", "group_id")


def uniqueness(groups: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row: the share of hashed media, in percent, that would stay if each group kept one; null for fewer than two."""
    extra = groups.filter(F.col("id") != F.col("group_id")).agg(F.count("*").alias("extra"))
    every = hashes.agg(F.count("*").alias("n"))
    return every.join(F.broadcast(extra), F.lit(True)).select(F.when(F.col("n") > 1, 100 * (1 - F.col("extra") / F.col("n"))).alias("uniqueness"), "extra", "n")


def exact_duplicates(media: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows whose content an earlier row (by id) has."""
    first = media.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("first"))
    return media.join(first, key).filter(F.col("id") != F.col("first")).select("id", "first")


def active_groups(groups: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Groups with a member that was not dismissed."""
    seen = groups.join(reviewed.select("id").distinct().withColumn("seen", F.lit(True)), "id", "left")
    return seen.withColumn("all_seen", F.min(F.coalesce("seen", F.lit(False))).over(W.partitionBy("group_id"))).filter(~F.col("all_seen")).drop("seen", "all_seen")
