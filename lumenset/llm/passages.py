"""Near-duplicate passages by compact windows over token min-hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenset.llm.common import discard, materialize, mixed, release, shingle_hashes, utf8
from lumenset.operators.graph import components

#: Groups of up to this many texts make their pairs at once; larger ones in pairs of blocks of so many, dealt to many tasks.
BLOCK = 256
#: Matching places of two texts are held for so many at once.
PLACES = 2_000_000
#: About so many texts a bucket; the pairs of a bucket's texts are verified together.
BUCKET = 64
#: Rounds in which the texts of a key are compared to one of them; what is then left is compared pair by pair.
STARS = 3
#: More texts than these with one key in one batch are compared to one of them there; only it meets other batches' texts.
TOGETHER = 16


@dataclass(frozen=True)
class Plan:
    """What follows from the parameters, in words and in places of shingles.

    Two stretches of ``words`` words with Jaccard ``similarity`` of their shingles share ``few`` of ``least`` shingles. The
    others are broken at most ``breaks`` times, as a changed word costs ``width`` shingles (a word left out, one less). So
    at least one run of ``run`` words stands in both, word for word.
    """

    words: int
    width: int
    similarity: float
    hashes: int

    @property
    def least(self) -> int:
        return self.words - self.width + 1

    @property
    def few(self) -> int:
        return int(np.ceil(2 * self.similarity / (1 + self.similarity) * self.least - 1e-9))

    @property
    def breaks(self) -> int:
        return (self.least - self.few) // max(1, self.width - 1)

    @property
    def run(self) -> int:
        return -(-self.few // (self.breaks + 1)) + self.width - 1

    @property
    def gram(self) -> int:
        """Words of a token of the min-hashes."""
        return max(1, 2 * self.run // 5)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(text: bytes, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; none for fewer words."""
    words = word_hashes(text)
    return shingle_hashes(words, width) if len(words) >= width else words[:0]


def _run_minima(h: np.ndarray, least: int) -> np.ndarray:
    """The least of each ``least`` neighbours, by doubling."""
    out, have = h, 1
    while have < least:
        step = min(have, least - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


def compact_windows(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, value): runs of ``least`` positions that begin at ``begin`` or after, but before the next one, have the least hash ``value``.

    They are the nodes of the Cartesian tree of ``h`` that span ``least`` positions, each with the runs it is the least of. Such
    runs lie side by side, so the tree isn't built node by node.
    """
    if len(h) < least:
        return np.zeros(0, dtype=np.int64), h[:0]
    low = _run_minima(h, least)
    begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return begin, low[begin]


def signatures(words: np.ndarray, plan: Plan, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(begin, signature): runs of ``plan.run`` words from ``begin`` on, up to the next one, have these min-hashes under all functions.

    The windows of the functions are joined where they overlap, so a signature stands for many runs. ``words`` may be those
    of many texts, which end at ``ends``: then no run has words of two.
    """
    if len(words) < plan.run:
        return np.zeros(0, dtype=np.int64), words[:0]
    grams = shingle_hashes(words, plan.gram)
    each = [compact_windows(mixed(grams ^ seed), plan.run - plan.gram + 1) for seed in mixed(np.arange(1, plan.hashes + 1, dtype=np.uint64))]
    begin = np.concatenate([x for x, _ in each])
    if ends is not None:
        begin = np.concatenate([begin, ends[:-1][ends[:-1] <= len(words) - plan.run]])
    begin = np.unique(begin)
    if ends is not None:
        begin = begin[begin + plan.run <= ends[np.searchsorted(ends, begin, side="right")]]
    out = np.zeros(len(begin), dtype=np.uint64)
    for own, value in each:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + value[np.searchsorted(own, begin, side="right") - 1])
    return begin, out


def _runs(same: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Maximal stretches covered by windows of ``least`` positions of which ``share`` agree."""
    if len(same) < least:
        return []
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[least:] - total[:-least] >= share * least)
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > least) + 1
    return [(int(g[0]), int(g[-1]) + least) for g in np.split(good, cut)]


def _stretches(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def by_value(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of ``h`` in the order of its values, and the values."""
    order = np.argsort(h, kind="stable")
    return order, h[order]


def shared_passages(a: np.ndarray, b: np.ndarray, plan: Plan, ordered: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Stretches of two texts' shingles that are near copies, from the whole texts: those of the first, those of the second.

    A shingle of one text counts at each place where the other has it. In a stretch of ``plan.least`` places, the shingles
    that both have, on diagonals that differ by no more than a fifth of that, must be the plan's similarity of all
    (Jaccard): ``2s / (1 + s)`` of each text's, for as many on both sides. Every band of diagonals is looked at that holds a
    run of ``plan.run`` words that isn't covered yet, those with most of them first, so a passage may drift on as it will, and stand at
    several places. ``ordered`` is ``by_value(b)``, where that is known.
    """
    least, few, whole = plan.least, plan.few, plan.run - plan.width + 1
    drift, need = max(2, least // 10), 2 * plan.similarity / (1 + plan.similarity)
    order, values = by_value(b) if ordered is None else ordered
    lo, hi = np.searchsorted(values, a), np.searchsorted(values, a, side="right")
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    if total[-1] < few:
        return [], []
    in_a, in_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    begin = 0
    while begin + least <= len(a):
        end = max(int(np.searchsorted(total, total[begin] + PLACES, side="right")) - 1, begin + 2 * least)
        end = min(end, len(a))
        count = (hi - lo)[begin:end]
        i = np.repeat(np.arange(begin, end), count)
        at = np.arange(len(i)) - np.repeat(total[begin:end] - total[begin], count)
        j = order[np.repeat(lo[begin:end], count) + at]
        by = np.argsort(i - j, kind="stable")
        i, j = i[by], j[by]
        d = i - j
        edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])) if len(d) else by
        size = np.diff(np.append(edge, len(d)))
        long = np.repeat(size >= whole, size)
        if long.any():
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            last = np.searchsorted(d, d[first] + 2 * drift, side="right")
            upto = np.concatenate([[0], np.cumsum(long)])
            wider = np.concatenate([[True], last[1:] > last[:-1]])  # else the band before has all that this one has
            able = wider & (last - first >= few) & (upto[last] > upto[first])
            first, last, todo = first[able], last[able], np.ones(int(able.sum()), dtype=bool)
            while len(todo):
                gain = (upto[last] - upto[first]) * todo
                k = int(gain.argmax())
                if not gain[k]:
                    break
                todo[k] = False
                x, y = i[first[k] : last[k]], j[first[k] : last[k]]
                base, top = max(begin, int(x.min()) - least), min(end, int(x.max()) + least + 1)
                same = np.zeros(top - base, dtype=bool)
                same[x - base] = True
                runs = _runs(same, least, need)
                for s, t in runs:
                    own = (x >= base + s) & (x < base + t)
                    xs, ys = x[own], y[own]
                    value, n = np.unique(xs - ys, return_counts=True)
                    near = np.lexsort((np.abs(xs - ys - value[n.argmax()]), xs))
                    hit = ys[near[np.concatenate([[True], np.diff(xs[near]) > 0])]]
                    in_a[base + s : base + t] = True
                    in_b[hit.min() : hit.max() + 1] = True
                if runs:
                    upto = np.concatenate([[0], np.cumsum(long & ~(in_a[i] & in_b[j]))])
        if end == len(a):
            break
        begin = end - least + 1
    return _stretches(in_a), _stretches(in_b)


ROWS = "key long, a long, b long"


def _rows(key: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    other = pa.nulls(len(key), pa.int64()) if b is None else pa.array(b.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(a.view(np.int64)), other], ["key", "a", "b"])


def _stars(key: np.ndarray, text: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows, ordered by key and text, go on alone; and for the others where the row is that they are compared to."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    first = np.repeat(start, size)
    alone = (np.repeat(size, size) <= together) | (first == np.arange(len(key)))
    return alone, first


def _windows(docs: DataFrame, plan: Plan) -> DataFrame:
    """(key, a, null) for a text with a signature, (key, a, b) for two that a batch has in plenty. A task sends a text once."""

    def some(batch, sent: set[int]):
        """Word hashes of texts not sent before, many texts at once, and their hashes."""
        words, texts, size = [], [], 0
        for text, h in zip(batch["words"].to_pylist(), batch["hash"].to_pylist(), strict=True):
            if h in sent:
                continue
            sent.add(h)
            words.append(word_hashes(text))
            texts.append(h)
            size += len(words[-1])
            if size > 1 << 15:
                yield words, texts
                words, texts, size = [], [], 0
        if words:
            yield words, texts

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            keys, texts = [], []
            for words, h in some(batch, sent):
                ends = np.cumsum([len(w) for w in words])
                begin, s = signatures(np.concatenate(words), plan, ends)
                keys.append(s)
                texts.append(np.array(h, dtype=np.int64)[np.searchsorted(ends, begin, side="right")])
            if not sum(map(len, keys)):
                continue
            key, text = np.concatenate(keys), np.concatenate(texts)
            by = np.lexsort((text, key))
            key, text = key[by], text[by]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
            key, text = key[new], text[new]
            alone, first = _stars(key, text, TOGETHER)
            yield _rows(key[alone], text[alone], None)
            if not alone.all():
                yield _rows(key[~alone], text[first[~alone]], text[~alone])
        release()

    return docs.mapInArrow(run, ROWS)


def _met(batches) -> Iterator[pa.RecordBatch]:
    """(a, b): each text of a key, and the key's first one. Rows are ordered by key and text; of a key only the first is held."""
    at: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        done = batch["b"].is_valid().to_numpy(zero_copy_only=False)
        both = batch.filter(pa.array(done))
        if both.num_rows:
            yield pa.RecordBatch.from_arrays([both["a"], both["b"]], ["a", "b"])
        key, text = (batch[c].to_numpy()[~done] for c in ("key", "a"))
        if not len(key):
            continue
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = text[start]
        if at is not None and at[0] == key[0]:
            first[0] = at[1]
        at = int(key[-1]), int(first[-1])
        first = np.repeat(first, np.diff(np.append(start, len(key))))
        new = first != text
        if new.any():
            yield pa.RecordBatch.from_arrays([pa.array(first[new]), pa.array(text[new])], ["a", "b"])


def _star_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a before b, from rows (key, a, b)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, F.when(F.col("b").isNull(), F.col("key")).otherwise(F.col("b"))).sortWithinPartitions(F.col("b").isNotNull(), "key", "a")
    met = dealt.mapInArrow(_met, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _whole(run):
    """A mapInArrow function that gives ``run`` whole groups of rows, many at once, of input sorted by ``key`` and ``tile``."""

    def go(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            cols = [t[k].to_numpy() for k in ("key", "tile")]
            start = np.concatenate([[0], 1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))])
            if held and all(held[-1][k][-1].as_py() == t[k][0].as_py() for k in ("key", "tile")):
                start = start[1:]
            if not len(start):
                held.append(t)
                continue
            held.append(t.slice(0, start[0]))
            yield from run(pa.concat_tables(held).combine_chunks())
            if len(start) > 1:
                yield from run(t.slice(start[0], start[-1] - start[0]))
            held = [t.slice(start[-1])]
        if held:
            yield from run(pa.concat_tables(held).combine_chunks())

    return go


def _groups(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, tile = t["key"].to_numpy(), t["tile"].to_numpy()
    if not len(key):
        return key, key
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
    return start, np.append(start[1:], len(key))


def _tile_pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """All pairs of texts between the two blocks of each tile, or within its one block."""
    text, side = t["text"].to_numpy(), t["side"].to_numpy()
    for s, e in zip(*_groups(t), strict=True):
        one, two = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
        if len(two):
            x, y = np.repeat(one, len(two)), np.tile(two, len(one))
        else:
            x, y = (s + k for k in np.triu_indices(e - s, 1))
        yield pa.RecordBatch.from_arrays([pa.array(text[x]), pa.array(text[y])], ["a", "b"])


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a before b: all pairs of texts with one key, from distinct rows (key, a).

    A key's texts fall into blocks by hash, as many as ``BLOCK`` asks for; each two blocks meet in a task of their own.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumnRenamed("key", "k")
    own = rows.join(sizes, F.col("key") == F.col("k")).select("key", F.col("a").alias("text"), F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"), "blocks")
    each = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct((F.least("block", other) * F.col("blocks") + F.greatest("block", other)).alias("tile"), (F.col("block") > other).cast("long").alias("side")),
    )
    dealt = own.select("key", "text", F.explode(each).alias("t")).select("key", "text", "t.*")
    found = dealt.repartition(n, "key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_whole(_tile_pairs), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _zipped(batches):
    """(key, hash, n, words): the number of words, and the words compressed."""
    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        words = batch["words"].to_pylist()
        n = pa.array([len(w.split()) for w in words], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["key"], batch["hash"], n, pa.array(map(zip_.compress, words), pa.binary())], ["key", "hash", "n", "words"])


def _texts(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(hash, words) of each text in ``pairs``, compressed: that of one row."""
    wanted = ids.select("key", "hash").join(pairs.select("a").union(pairs.select("b")).toDF("hash").distinct(), "hash", "left_semi")
    wanted = wanted.groupBy("hash").agg(F.min(F.struct(F.col("key").isNull(), "key")).alias("m")).select("hash", F.col("m.key").alias("k"))
    found = ids.select("key", "hash", "words").join(wanted, "hash").filter(F.col("key").eqNullSafe(F.col("k")))
    return materialize(found.select("hash", "words").dropDuplicates(["hash"]), "passage-texts")


FOUND = "hash long, other long, s long, e long, key long"


def _verified(pairs: DataFrame, texts: DataFrame, plan: Plan, *, first: bool, square: bool = False) -> DataFrame:
    """The stretches of each pair's texts, and the runs that both texts have, by which they met, but that no stretch has.

    Rows (hash, other, s, e, null) are stretches of words; rows (hash, null, null, null, key) are keys under which a text
    must meet others: a key stands for the whole run of words. The pairs of a bucket of texts are verified together, so that a
    text comes once for many pairs; with ``square``, those of two buckets.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, texts.count() // BUCKET)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    dealt = pairs.withColumn("block", of("b") * buckets + of("a") if square else of("b"))
    needs = dealt.select("block", F.col("a").alias("hash")).union(dealt.select("block", "b")).distinct()
    sent = needs.join(texts, "hash").select("block", F.lit(None).cast("long").alias("a"), F.col("hash").alias("b"), "words")
    sent = sent.unionByName(dealt.select("block", "a", "b", F.lit(None).cast("binary").alias("words")))

    def runs(words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where a text's signatures of this round begin and end, the signatures, in order too, and the hash of each run in full."""
        full = shingle_hashes(words, plan.run) if len(words) >= plan.run else words[:0]
        begin, sig = signatures(words, plan) if first else (np.arange(len(full)), full)
        return begin, np.append(begin[1:], len(full)), sig, np.sort(sig), full

    def left_over(one: tuple, other: tuple, stretches: list) -> np.ndarray:
        """The hashes of the runs, with a signature that the other text has too, that no stretch covers."""
        begin, end, sig, _, full = one
        there = other[3]
        hit = np.flatnonzero(there[np.minimum(np.searchsorted(there, sig), len(there) - 1)] == sig) if len(there) else there
        at = np.repeat(begin[hit], (end - begin)[hit]) if len(hit) else hit
        if len(at):
            at = at + np.arange(len(at)) - np.repeat(np.cumsum((end - begin)[hit]) - (end - begin)[hit], (end - begin)[hit])
        if len(at) and stretches:
            s, e = np.array(stretches).T
            k = np.searchsorted(s, at, side="right") - 1
            at = at[(k < 0) | (at + plan.run > e[np.maximum(k, 0)] + plan.width - 1)]
        return full[at] if len(at) else full[:0]

    def verify(batches):
        known: dict[int, list] = {}
        unzip, at = zstandard.ZstdDecompressor(), None
        for batch in batches:
            out, left = [], []
            for block, a, b, text in zip(*(batch[c].to_pylist() for c in ("block", "a", "b", "words")), strict=True):
                if block != at:
                    known, at = {}, block
                if a is None:
                    words = word_hashes(unzip.decompress(text))
                    h = shingle_hashes(words, plan.width) if len(words) >= plan.width else words[:0]
                    known[b] = [h, by_value(h), runs(words)]
                    continue
                both = shared_passages(known[a][0], known[b][0], plan, known[b][1])
                for one, two, stretches in zip((a, b), (b, a), both, strict=True):
                    out += [(one, two, s, e + plan.width - 1) for s, e in stretches]
                    keys = left_over(known[one][2], known[two][2], stretches)
                    if len(keys):
                        left.append((np.full(len(keys), one, dtype=np.int64), keys.view(np.int64)))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.nulls(len(out), pa.int64())], ["hash", "other", "s", "e", "key"])
            if left:
                text, key = np.unique(np.stack([np.concatenate(c) for c in zip(*left, strict=True)]), axis=1)
                none = pa.nulls(len(key), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(text), none, none, none, pa.array(key)], ["hash", "other", "s", "e", "key"])
        release()

    sent = sent.repartition(n, "block").sortWithinPartitions("block", F.col("a").asc_nulls_first())
    return materialize(sent.mapInArrow(verify, FOUND), "passage-found")


def _linked(own: DataFrame, ids: DataFrame, plan: Plan) -> DataFrame:
    """(hash, other, s, e) for pairs of texts: the stretches of the one that are near copies of the other's.

    The texts of a key are compared to one of them. Those whose run of words lies in no stretch shared with it meet again, by
    the whole run, without it; after ``STARS`` rounds all that are left with one key meet each other.
    """
    done = tables = None
    rows, last = _windows(own.select("hash", "words"), plan), None
    for k in range(STARS + 1):
        pairs = _star_pairs(rows) if k < STARS else _all_pairs(rows.select("key", "a"))
        pairs = pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "passage-pairs")
        if pairs.isEmpty():
            break
        texts = _texts(ids, pairs)
        found = _verified(pairs, texts, plan, first=not k, square=k == STARS)
        tables = found.filter("key is null") if tables is None else tables.unionByName(found.filter("key is null"))
        done = pairs if done is None else done.unionByName(pairs)
        discard(texts)
        rows = found.filter("key is not null").select("key", F.col("hash").alias("a"), F.lit(None).cast("long").alias("b")).distinct()
        # of a key that one text has nothing can come
        several = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        rows = materialize(rows.join(several, "key", "left_semi"), "passage-left")
        if last is not None:
            discard(last)
        last = rows
    empty = own.sparkSession.createDataFrame([], FOUND)
    return (empty if tables is None else tables).select("hash", "other", "s", "e")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 50, width: int = 5, similarity: float = 0.8, hashes: int = 2) -> DataFrame:
    """Rows with a passage of ``words`` words or more that another row has too, or nearly so.

    ``id_col``, n_words (of the text), passages (merged word spans, ``start-end`` comma-joined), passage_words, n_copies (rows with the very same
    text), class_id (the least id that links reach; a link is a verified passage that two different texts share). Rows
    without such a passage don't appear; null and empty texts never do. Equal texts are compared once; repeated rows are
    copies of each other. Other columns aren't read, so their names don't matter. An empty input gives no rows.

    Runs of words meet by a shuffle on their signature: the min-hashes of all ``hashes`` functions. Two passages of that
    similarity have a run of ``Plan.run`` words in common, so they meet. Pairs are verified on their whole texts.
    """
    plan = Plan(words, width, similarity, hashes)
    own = docs.select(F.col(id_col).cast("long").alias("key"), utf8(text_col).alias("words"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"))
    ids = materialize(own.select("key", "hash", "words").mapInArrow(_zipped, "key long, hash long, n long, words binary"), "passage-rows")
    both = _linked(own, ids, plan)
    last = lambda acc: F.element_at(acc, -1)
    joined_to = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e"))))
    in_order = F.array_sort(F.collect_list(F.struct("s", "e")))
    spans = F.aggregate(F.slice(in_order, 2, F.size(in_order)), F.slice(in_order, 1, 1), lambda acc, x: F.when(last(acc)["e"] >= x["s"], joined_to(acc, x)).otherwise(F.concat(acc, F.array(x))))
    places = both.groupBy("hash", "s").agg(F.max("e").alias("e")).groupBy("hash").agg(spans.alias("spans"))
    roots = components(both.filter("hash < other").select(F.col("hash").alias("a"), F.col("other").alias("b")).distinct())
    copies = ids.groupBy("hash").agg(F.count("*").alias("n_copies"), F.min("key").alias("least"), F.max("n").alias("n"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n").alias("e")))
    several = (F.col("n_copies") > 1) & (F.col("n") >= words)
    nodes = copies.join(places, "hash", "left").filter(several | F.col("spans").isNotNull()).join(roots.withColumnRenamed("node", "hash"), "hash", "left")
    nodes = nodes.select("hash", F.coalesce("root", "hash").alias("root"), F.when(several, whole).otherwise(F.col("spans")).alias("spans"), "n_copies", "least")
    nodes = materialize(nodes, "passage-nodes")
    named = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("class_id")), "root")
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    out = ids.select("key", "hash", "n").join(named, "hash")
    return out.select(F.col("key").alias(id_col), F.col("n").alias("n_words"), joined.alias("passages"), total.alias("passage_words"), "n_copies", "class_id")
