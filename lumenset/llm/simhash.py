"""SimHash fingerprints and their exact near-duplicate components, compared tile by tile."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.llm.common import discard, free_name, materialize, mixed, release, shingle_hashes, text_key, utf8
from lumenset.operators.graph import components

SEED = 42
#: Groups of fingerprints up to this size are compared by shifts, larger ones by growing a spanning tree.
SHIFTS = 32


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority of each bit over the XXH64 of all word shingles, repeats included; A-Z lower-cased. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp", width: int = 3) -> DataFrame:
    """``docs`` with its fingerprint as a (signed) long. A null text counts as empty."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")

    @F.pandas_udf("long")
    def run(texts):
        out = texts.map(lambda t: np.uint64(fingerprint(t, width)).astype(np.int64))
        release()
        return out

    return docs.withColumn(name, run(utf8(text_col)))


def _linked(fp: np.ndarray, pop: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span one group: from a fingerprint to those not yet reached, among the population counts in reach."""
    left, out = np.arange(len(fp)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            a, b = np.searchsorted(pop[left], [pop[i] - radius, pop[i] + radius + 1])
            hit = a + np.flatnonzero(np.bitwise_count(fp[left[a:b]] ^ fp[i]) <= radius)
            if len(hit):
                out.append((np.full(len(hit), i), left[hit]))
                todo.extend(left[hit].tolist())
                left = np.delete(left, hit)
    return out


def _tile_links(fp: np.ndarray, pop: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of rows that begin at ``start``; each group is ordered by population count."""
    fp = fp.astype(np.uint64)  # bit counts of negative numbers are of their absolute values
    ends = np.append(start[1:], len(fp))
    size, left, right = ends - start, [], []
    for k in np.flatnonzero(size > SHIFTS):
        for a, b in _linked(fp[start[k] : ends[k]], pop[start[k] : ends[k]], radius):
            left.append(a + start[k])
            right.append(b + start[k])
    end = np.repeat(np.where(size > SHIFTS, start, ends), size)
    i = np.arange(len(fp))
    for d in range(1, SHIFTS):
        i = i[i + d < end[i]]
        i = i[pop[i + d] - pop[i] <= radius]  # ordered: what differs too much now differs too much further on
        if not len(i):
            break
        hit = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        left.append(hit)
        right.append(hit + d)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _masks(radius: int, blocks: int) -> list[int]:
    """Two words within ``radius`` bits agree on all bits of at least one of these masks."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tiled(dealt: DataFrame, salted: str, radius: int, tile: int) -> DataFrame:
    """Rows (mask, part, pop, ...) dealt to pairs of tiles: with lo and hi, the tiles' codes, and whether a row is of the second.

    What agrees on a mask and its part, in more than ``tile`` rows, lies in tiles by bands of ``radius + 1`` population counts
    and a hash of ``salted``; a tile meets those of its band and the two beside it, as others differ too much. Smaller groups stay one tile.
    """
    dealt = dealt.withColumn("band", F.floor(F.col("pop") / (radius + 1)).cast("int"))
    each = dealt.groupBy("mask", "part", "band").agg(F.count("*").alias("n"))
    hot = (
        each.groupBy("mask", "part")
        .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / tile).cast("int")))).alias("salts"))
        .filter(F.col("n") > tile)
        .drop("n")
    )
    salt = F.pmod(F.xxhash64(salted), F.col("salts")[F.col("band")]).cast("long")
    code: Column = F.col("band").cast("long") * (1 << 32) + salt
    reach = F.flatten(
        F.transform(
            F.filter(F.map_keys("salts"), lambda q: F.abs(q - F.col("band")) <= 1),
            lambda q: F.transform(F.sequence(F.lit(0), F.col("salts")[q] - 1), lambda s: q.cast("long") * (1 << 32) + s),
        )
    )
    none = F.lit(-1).cast("long")
    cold = F.array(F.struct(none.alias("lo"), none.alias("hi"), F.lit(False).alias("second")))
    pairs = F.transform(reach, lambda u: F.struct(F.least(u, code).alias("lo"), F.greatest(u, code).alias("hi"), (code > u).alias("second")))
    tiles = F.explode(F.when(F.col("salts").isNull(), cold).otherwise(pairs)).alias("t")
    return dealt.join(hot, ["mask", "part"], "left").select(*dealt.columns, tiles).select(*dealt.columns, "t.*").drop("band")


def links(words: DataFrame, radius: int = 3, tile: int = 2048, col: str = "fp") -> DataFrame:
    """(a, b): links between distinct words of 64 bits that span all pairs within ``radius`` bits.

    Words that differ in few bits agree on one of a few masks. Within what agrees on a mask, words lie in tiles by
    their population count; a tile is compared, with numpy's exclusive-or and bit counts, to those tiles alone whose
    population counts are within the radius, and a full tile is dealt into several by hash. So no task has more than two tiles' words,
    however many agree on a mask. The number of masks follows from the number of words: more of them, with more bits
    each, for more words. Every choice is exact. From each pair of tiles come at most as many links as it has words
    (times a constant), which connect all that its pairs connect.
    """
    spark = words.sparkSession
    n = words.count()
    blocks = radius + 1
    while blocks < 2 * radius + 1 and n > tile << 64 * (blocks - radius) // blocks:
        blocks += 1
    masks = [F.struct(F.lit(k).alias("mask"), F.col(col).bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(_masks(radius, blocks))]
    dealt = words.select(F.col(col).alias("fp"), F.bit_count(col).alias("pop"), F.explode(F.array(*masks)).alias("m")).select("fp", "pop", "m.*")
    dealt = _tiled(dealt, "fp", radius, tile).drop("second")
    keys = ["mask", "part", "lo", "hi"]
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "pop", "fp")

    def run(batches):
        held: pa.Table | None = None

        def found(t: pa.Table, start: np.ndarray):
            fp, pop = t["fp"].to_numpy(), t["pop"].to_numpy().astype(np.int64)
            a, b = _tile_links(fp, pop, start, radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            cols = [t[k].to_numpy() for k in keys]
            new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            start = np.concatenate([[0], 1 + np.flatnonzero(new)])
            held = t.slice(start[-1])  # the last group may go on in the next batch
            if len(start) > 1:
                yield found(t.slice(0, start[-1]), start[:-1])
        if held is not None and held.num_rows:
            yield found(held, np.array([0]))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, tile: int = 2048) -> DataFrame:
    """``id_col``, fp (long), component_id (the least id that links reach, its own included) for each row of ``docs``.

    Rows with the same fingerprint are one word in the comparison, however many they are. Null and empty texts have the
    fingerprint 0, linked like any other. Repeated rows get the same values. A null id is never a component's id, unless
    it has no other. Other columns of ``docs`` are not read. An empty input gives no rows.
    """
    own = materialize(with_fingerprint(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("words")), "words", width=width).select("key", "fp"), "fingerprints")
    return components_of(own, radius=radius, tile=tile).withColumnRenamed("key", id_col)


def components_of(own: DataFrame, *, radius: int = 3, tile: int = 2048) -> DataFrame:
    """component_id for rows (key, fp), which should be a written table."""
    words = materialize(own.groupBy("fp").agg(F.min("key").alias("least")), "words")
    roots = components(links(words.select("fp"), radius, tile))
    named = words.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "component_id"), "fp").select("key", "fp", "component_id")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The hashes of a text's shingles, sorted without repeats; of the whole text where it is shorter."""
    words = [xxhash.xxh64_intdigest(w) for w in text.lower().split()]
    return np.unique(shingle_hashes(np.array(words, dtype=np.uint64), width))


#: A row for each of so many min-hashes: at similarity 0.8 all differ for three pairs of a million.
KEYS = 8
_SEEDS = mixed(np.arange(1, KEYS + 1, dtype=np.uint64))


#: Parities of the smallest and the largest sets.
FEWEST, MOST = 256, 32768


def sketch(text: bytes, width: int) -> bytes:
    """SimHash of the text's set of shingles, how many it has, its ``KEYS`` min-hashes and its parities, as 64-bit integers.

    The parities are, for each part of all hashes, whether the set has an odd number there: two sets differ in at least as many
    shingles as their parities differ in. There are as many parts as the set has shingles, or up to twice as many (a power of two,
    within ``FEWEST`` and ``MOST``); with fewer, the parities of any two large sets differ in half of the parts. No words: zeros.
    """
    own = shingle_set(text, width)
    if not len(own):
        return bytes(8 * (2 + KEYS) + FEWEST // 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(own), 4096):
        ones += np.unpackbits(own[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(2 * ones > len(own), bitorder="little").tobytes()
    parts = min(MOST, max(FEWEST, 1 << (len(own) - 1).bit_length()))
    odd = (np.bincount((own >> np.uint64(32) & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1).astype(np.uint8)
    least = np.array([mixed(own ^ seed).min() for seed in _SEEDS], dtype=np.uint64)
    return fp + np.uint64(len(own)).tobytes() + least.tobytes() + np.packbits(odd).tobytes()


class _Parities:
    """Sizes and parities of a tile's sets. Those of a larger set fold to those of fewer parts, so any two sets compare by the smaller's."""

    def __init__(self, odd: list[bytes]):
        self.size = np.frombuffer(b"".join(o[:8] for o in odd), dtype=np.uint64).astype(np.float64)
        self.words = np.array([len(o) // 8 - 1 for o in odd], dtype=np.int64)
        self.at, rows, table, w = {}, np.zeros(0, dtype=np.int64), np.zeros((0, 2 * MOST // 64), dtype=np.uint64), MOST // 64
        while w >= FEWEST // 64:  # of each number of words: the sets that have as many or more, and where they are
            own = np.flatnonzero(self.words == w)
            table = table[:, :w] ^ table[:, w:]
            table = np.concatenate([table, np.frombuffer(b"".join(odd[k][8:] for k in own), dtype=np.uint64).reshape(-1, w)])
            rows = np.concatenate([rows, own])
            place = np.full(len(odd), -1)
            place[rows] = np.arange(len(rows))
            self.at[w] = place, table
            w //= 2


def _able(x: _Parities, y: _Parities, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (i of x, j of y) may have the similarity: of sets with Jaccard s, the smaller has s of the larger's size
    at least, and they differ in ``(1 - s) / (1 + s)`` of the sum of sizes at most."""
    na, nb = x.size[i], y.size[j]
    left = np.flatnonzero(np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-6)
    most = (na + nb) * (1 - similarity) / (1 + similarity) + 1e-6
    words = np.minimum(x.words[i], y.words[j])

    def within(some: np.ndarray, w: int) -> np.ndarray:
        (p, a), (q, b) = x.at[w], y.at[w]
        out = [some[:0]]
        for s in range(0, len(some), step := max(1, (1 << 18) // w)):
            k = some[s : s + step]
            differ = np.bitwise_count(a[p[i[k]]] ^ b[q[j[k]]]).sum(axis=1, dtype=np.int64)
            out.append(k[differ <= most[k]])
        return np.concatenate(out)

    left = within(left, FEWEST // 64)
    return np.sort(np.concatenate([left[words[left] == FEWEST // 64], *[within(left[words[left] == w], w) for w in np.unique(words[left]) if w > FEWEST // 64]]))


def _first_pairs(members: DataFrame, radius: int) -> DataFrame:
    """(a, b): each text, and the first one that has a min-hash with it, if their words lie within ``radius`` bits."""
    first = members.groupBy("mask", "part").agg(F.min(F.struct("hash", "fp")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    both = members.join(first, ["mask", "part"]).filter((F.col("hash") > F.col("first.hash")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= radius))
    return both.select(F.col("first.hash").alias("a"), F.col("hash").alias("b")).distinct()


def _other_pairs(members: DataFrame, radius: int, similarity: float, most: int, tile: int = 2048) -> DataFrame:
    """(a, b, more): pairs of texts that have a min-hash in common, words within ``radius`` bits, and no root in common.

    A text gets the ``most`` nearest ones after it in its tile, but for those whose parities show that they can't have the
    similarity, and ``more`` says that there are others. Texts lie in tiles; a tile is compared, with
    numpy's exclusive-or and bit counts, to those alone whose population counts are in reach.
    """
    several = members.groupBy("mask", "part").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("mask", "part")
    own = members.join(several, ["mask", "part"], "left_semi").withColumn("pop", F.bit_count("fp"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["mask", "part", "lo", "hi"]

    def run(batches):
        held, parities, at = {False: [], True: []}, {False: [], True: []}, None

        def found():
            one, two = ([np.concatenate(c) for c in zip(*held[k], strict=True)] if held[k] else None for k in (False, True))
            if one is None or two is None and at[2] != at[3]:
                return
            fp, h, root = one
            fp2, h2, root2 = one if two is None else two
            odd = _Parities(parities[False])
            odd2 = odd if two is None else _Parities(parities[True])
            for x in range(0, len(fp), 256):
                i, j = np.nonzero((np.bitwise_count(fp[x : x + 256, None] ^ fp2[None, :]) <= radius) & (root[x : x + 256, None] != root2[None, :]))
                i += x
                if two is None:
                    i, j = i[i < j], j[i < j]
                able = _able(odd, odd2, i, j, similarity)
                i, j = i[able], j[able]
                by = np.lexsort((np.bitwise_count(fp[i] ^ fp2[j]), i))
                i, j = i[by], j[by]
                start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
                size = np.diff(np.append(start, len(i)))
                few = np.arange(len(i)) - np.repeat(start, size) < most
                a, b, cut = h[i[few]], h2[j[few]], np.repeat(size > most, size)[few]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cut)], ["a", "b", "more"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, h, root = (batch[c].to_numpy() for c in ("fp", "hash", "root"))
            cols = [batch[c].to_numpy() for c in keys]
            odd = batch["odd"].to_pylist()
            second = batch["second"].to_numpy(zero_copy_only=False)
            edge = 1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in (*cols, second)], axis=0))
            for s, e in zip([0, *edge], [*edge, len(fp)], strict=True):
                if at != (now := tuple(c[s] for c in cols)):
                    yield from found() if at else ()
                    held, parities, at = {False: [], True: []}, {False: [], True: []}, now
                parities[bool(second[s])].extend(odd[s:e])
                held[bool(second[s])].append((fp[s:e].astype(np.uint64), h[s:e].copy(), root[s:e].copy()))  # bit counts of negative numbers are of their absolute values
        if at:
            yield from found()

    dealt = _tiled(own, "hash", radius, tile).repartition(n, *keys).sortWithinPartitions(*keys, "second")
    return dealt.mapInArrow(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The similarity of two sets of shingles, each sorted without repeats; two empty ones are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def alike(found: DataFrame, texts: DataFrame, similarity: float, width: int, *, square: bool, bucket: int = 64) -> DataFrame:
    """(a, b): those of the pairs whose whole texts have ``similarity``, but for what others in the same task connect.

    ``texts`` has a row (hash, words) for each text. The pairs of a bucket of texts are verified together, or, with
    ``square``, those of two buckets.
    """
    buckets = max(1, texts.count() // bucket)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    dealt = found.withColumn("block", of("a") * buckets + of("b") if square else of("b"))
    needs = dealt.select("block", F.col("a").alias("hash")).union(dealt.select("block", "b")).distinct()
    sent = needs.join(texts, "hash").select("block", F.lit(None).cast("long").alias("a"), F.col("hash").alias("b"), "words")
    sent = sent.unionByName(dealt.select("block", "a", "b", F.lit(None).cast("binary").alias("words")))

    def run(batches):
        at, known, root = None, {}, {}

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            out = []
            for block, a, b, text in zip(*(batch[c].to_pylist() for c in ("block", "a", "b", "words")), strict=True):
                if block != at:
                    at, known, root = block, {}, {}
                if a is None:
                    known[b], root[b] = shingle_set(text, width), b
                elif (x := top(a)) != (y := top(b)) and jaccard(known[a], known[b]) >= similarity:
                    root[x] = y
                    out.append((a, b))
            cols = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, "block").sortWithinPartitions("block", F.col("a").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _verified(kept: DataFrame, uid: str, text_col: str, radius: int, width: int, similarity: float) -> DataFrame:
    """(key, component_id) for each row by the verified pairs of its text.

    Texts that have a min-hash in common are compared to one of them; what this doesn't connect is compared in tiles, each
    text to the nearest ones, to more of them in each round, until none is left that isn't connected and wasn't compared.
    So large groups of copies make few pairs, and texts that have only a frequent shingle in common make none.
    """

    @F.pandas_udf("binary")
    def sketches(texts):
        out = texts.map(lambda t: sketch(t, width))
        release()
        return out

    rows = materialize(kept.select(F.col(uid).alias("key"), *text_key(F.col(text_col)), sketches(utf8(text_col)).alias("s")), "rows")
    nodes = rows.groupBy("h1", "h2").agg(F.min("key").alias("hash"), F.first("s").alias("s"))  # a text goes by the least key of its rows
    nodes = nodes.mapInArrow(_unpacked, "h1 long, h2 long, hash long, fp long, odd binary, least array<long>")
    nodes = materialize(nodes, "texts")
    members = nodes.select("hash", "fp", "odd", F.posexplode("least").alias("mask", "part"))
    roots = edges = done = None
    most = 1
    while True:
        if roots is None:
            found = new = materialize(_first_pairs(members, radius).withColumn("more", F.lit(True)), "pairs")
        else:
            own = members.join(roots.withColumnRenamed("node", "hash"), "hash", "left").withColumn("root", F.coalesce("root", "hash"))
            found = materialize(_other_pairs(own, radius, similarity, most), "pairs")
            new = materialize(found.select("a", "b").join(done, ["a", "b"], "left_anti"), "new-pairs")
            most *= 8
        wanted = nodes.join(new.select("a").union(new.select("b")).toDF("hash").distinct(), "hash", "left_semi").select("hash")
        texts = materialize(kept.select(F.col(uid).alias("hash"), utf8(text_col).alias("words")).join(wanted, "hash").select("hash", "words"), "wanted")
        links = materialize(alike(new.select("a", "b"), texts, similarity, width, square=roots is not None), "alike")
        discard(texts)
        if roots is None:  # a min-hash that one text has links nothing
            shared = members.groupBy("mask", "part").agg(F.count("*").alias("n")).filter("n > 1").select("mask", "part")
            members = materialize(members.join(shared, ["mask", "part"], "left_semi"), "shared")
        else:
            discard(roots, new)
        done = found.select("a", "b") if done is None else done.unionByName(found.select("a", "b"))
        edges = links if edges is None else edges.unionByName(links)
        roots = materialize(components(edges), "roots")
        if found.filter("more").isEmpty():
            break
    named = nodes.select("h1", "h2", "hash").join(roots.withColumnRenamed("node", "hash"), "hash", "left").select("h1", "h2", F.coalesce("root", "hash").alias("component_id"))
    return rows.select("key", "h1", "h2").join(named, ["h1", "h2"]).select("key", "component_id")


def _unpacked(batches):
    """The parts of sketches."""
    head = 8 * (2 + KEYS)
    for batch in batches:
        whole = batch["s"].to_pylist()
        x = np.frombuffer(b"".join(s[:head] for s in whole), dtype=np.int64).reshape(-1, 2 + KEYS)
        odd = [s[8:16] + s[head:] for s in whole]
        least = pa.ListArray.from_arrays(pa.array(np.arange(0, KEYS * len(x) + 1, KEYS), pa.int32()), pa.array(x[:, 2:].reshape(-1)))
        cols = [batch["h1"], batch["h2"], batch["hash"], pa.array(x[:, 0]), pa.array(odd, pa.binary()), least]
        yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "hash", "fp", "odd", "least"])


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, similarity: float | None = None) -> DataFrame:
    """``docs`` with the one row of each component that has the least id; its other columns stay as they are.

    Of rows that share this id, the one with the least hash of its columns stays (one of them, if all columns agree).
    With ``similarity``, two texts link only if their sets of shingles of ``width`` words have it (Jaccard) as well.
    """
    fp, uid = free_name(docs, "fp"), free_name(docs, "uid")
    if similarity is None:
        kept = materialize(with_fingerprint(docs, text_col, fp, width).withColumn(uid, F.monotonically_increasing_id()), "fingerprints")
        classes = components_of(kept.select(F.col(uid).alias("key"), F.col(fp).alias("fp")), radius=radius).drop("fp")
    else:
        kept = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
        classes = _verified(kept, uid, text_col, radius, width, similarity)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("hash"), F.col(uid).alias("uid"))
    best = classes.join(kept.select(F.col(uid).alias("key"), order.alias("order")), "key").groupBy("component_id").agg(F.min("order").alias("order"))
    return kept.join(best.select(F.col("order.uid").alias(uid)), uid, "left_semi").select(*docs.columns)
