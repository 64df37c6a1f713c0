"""Composing, mapping, sweeping, replaying and issues on hand-made tables: nulls, ties, repeats, empties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenset.operators import compose, issues, rules, snapshots, sweeps


def plain_preview(media, dataset, changes, groups, near):
    """The pillars of one proposal, from the whole set that it would make."""
    known = {m[0]: m for m in media}
    held = {i for i in dataset if i in known}
    comes = {i for i, s in changes if s > 0 and (i, -1) not in changes and i in known and i not in dataset}
    goes = {i for i, s in changes if s < 0 and (i, 1) not in changes and i in held}
    ids = (held - goes) | comes
    scores = [known[i][1] for i in ids if known[i][1] is not None]
    u = [np.array(known[i][2]) / np.linalg.norm(known[i][2]) for i in ids if known[i][2]]
    pairs = [1 - float(a @ b) for k, a in enumerate(u) for b in u[:k]]
    copies = [i for i in comes if any(o != i and ((groups.get(i) is not None and groups.get(i) == groups.get(o)) or (i, o) in near or (o, i) in near) for o in ids)]
    quality = sum(scores) / len(scores) if scores else None
    diversity = max(0, min(100, 100 * (np.mean(pairs) - 0.10) / 0.45)) if pairs else None
    hygiene = max(0, 100 - 22 * len(copies))
    parts = [(0.35, quality), (0.30, diversity), (0.20, hygiene)]
    score = sum(w * x for w, x in parts if x is not None) / sum(w for w, x in parts if x is not None)
    return quality, diversity, hygiene, len(copies), score, len(comes), len(goes), len(ids)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_previews_equal_the_whole_set(spark, seed):
    rng = np.random.default_rng(seed)
    media = [(i, None if rng.random() < 0.2 else float(rng.integers(30, 100)), None if rng.random() < 0.2 else (rng.normal(size=4) + [2, 0, 0, 0]).tolist()) for i in range(40)]
    dataset = [int(i) for i in rng.choice(45, 12, replace=False)]
    groups = {i: int(rng.integers(0, 12)) for i in range(40) if rng.random() < 0.4}
    near = {(int(a), int(b)) for a, b in rng.integers(0, 40, (12, 2)) if a != b}
    proposals = {p: [(int(i), int(s)) for i, s in zip(rng.integers(0, 50, 9), rng.choice([1, 1, -1], 9))] for p in range(8)} | {8: [(999, 1)], 9: [(0, 1), (0, -1), (1, 1), (1, 1)]}
    frames = (
        spark.createDataFrame(media, "id long, score double, vector array<double>"), spark.createDataFrame([(i,) for i in [*dataset, dataset[0]]], "id long"),
        spark.createDataFrame([(p, i, s) for p, x in proposals.items() for i, s in x], "proposal_id long, id long, sign int"), spark.createDataFrame([(g, i) for i, g in groups.items()], "group_id long, id long"), spark.createDataFrame(list(near), "a long, b long"),
    )
    got = {r.proposal_id: r for r in compose.preview(*frames).collect()}
    base = plain_preview(media, set(dataset), [], groups, near)
    for p, changes in proposals.items():
        want, r = plain_preview(media, set(dataset), changes, groups, near), got[p]
        have = (r.quality, r.diversity, r.hygiene, r.duplicates, r.score, r.comes, r.goes, r.total)
        assert all(a == b if b is None else a == pytest.approx(b, abs=1e-9) for a, b in zip(have, want)), p
        assert r.base_score == pytest.approx(base[4]) and r.delta == pytest.approx(want[4] - base[4], abs=1e-9) and r.base == base[7]
    assert compose.preview(frames[0], frames[1].limit(0), frames[2], frames[3].limit(0), frames[4].limit(0)).filter("base_quality is not null or base_diversity is not null").count() == 0
    rows = compose.framing(frames[0], frames[1], frames[2], spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "id long, bucket string")).groupBy("proposal_id").agg(F.sum("share").alias("s")).collect()
    assert len(rows) == 10 and all(r.s == pytest.approx(100) for r in rows)


def test_differences_and_what_is_read_again(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (3, None, 4), (None, "x", 1), (5, "same", 1)], "id long, t string, n int")
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 4), (3, "", 4), (4, "d", 1), (5, "same", 1)], "id long, t string, n int")
    changed = snapshots.difference(old, new, ["id"])
    assert {tuple(r) for r in changed.collect()} == {(2, "update"), (3, "update"), (4, "insert"), (None, "delete")}
    read = []

    def total(keys):
        rows = new.join(keys, "id", "left_semi")
        read.extend(sorted(r.id for r in rows.select("id").distinct().collect()))
        return rows.groupBy("id").agg(F.sum("n").alias("n"))

    known = changed.filter("id is not null")
    derived = old.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    out = snapshots.refreshed(derived, known, ["id"], total)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, new.groupBy("id").agg(F.sum("n").alias("n")).collect()))
    assert read == [2, 3, 4]
    assert snapshots.difference(new, new, ["id"]).count() == 0 and snapshots.difference(old.limit(0), old.limit(0), ["id"]).count() == 0


def test_sweeps_mark_once(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    media, files, links = one([(1,), (2,), (3,), (4,)], "id long"), one([(1,), (1,), (99,)], "media_id long"), one([(1,), (2,)], "media_id long")
    revisions = one([(1, 1, "aé"), (1, 2, "b"), (1, 3, None), (3, 1, "zz"), (7, 1, "w")], "media_id long, revision_id long, content string")
    heads, pins = one([(1, 3), (3, 1), (7, 1)], "media_id long, revision_id long"), one([(1, 2)], "media_id long, revision_id long")
    marks = sweeps.marked(media, files, links, revisions, heads, pins)
    gone = sweeps.swept(marks)
    assert {tuple(r) for r in gone.collect()} == {("media", 3, 0, 0), ("media", 4, 0, 0), ("dataset_captions", 3, 0, 2), ("dataset_captions", 7, 0, 1), ("captions", 1, 1, 3)}
    report = {r.category: (r.n, r.bytes, r.vacuumed) for r in sweeps.cleanup_report(marks, {"thumbs": (media, F.lit(10))}).collect()}
    assert report == {"media": (2, 0, True), "captions": (1, 3, True), "dataset_captions": (2, 3, True), "thumbs": (4, 40, False)}
    left = sweeps.purged(revisions, gone, "captions", b="revision_id")
    assert sorted((r.media_id, r.revision_id) for r in left.collect()) == [(1, 2), (1, 3), (3, 1), (7, 1)]
    assert sorted(r.id for r in sweeps.purged(media, gone, "media", a="id").collect()) == [1, 2]


def test_mapping_moves_files(spark):
    files = spark.createDataFrame([("a",), ("a/b",), ("a/b",), ("a/b/c",), ("d",), ("",)], "folder string")
    before = spark.createDataFrame([("a", "sublib"), ("d", "sublib"), ("a/b/c", "exclude")], "rel_path string, mode string")
    after = spark.createDataFrame([("a", "sublib"), ("a/b", "sublib"), ("d", "keep"), ("z", "sublib")], "rel_path string, mode string")
    out = {r.rel_path: tuple(r)[1:] for r in rules.applied_mapping(files, before, after).collect()}
    assert out == {"a": ("keep", 3, 1), "a/b": ("create", 0, 3), "d": ("prune", 1, 0), "z": ("create", 0, 0)}
    moved = {r.folder: (r.was, r.now, r.was_excluded, r.now_excluded) for r in rules.rerouted(files, before, after).collect()}
    assert moved == {"a/b": ("a", "a/b", False, False), "a/b/c": (None, "a/b", True, False), "d": ("d", None, False, False)}
    assert rules.applied_mapping(files.limit(0), before.limit(0), after.limit(0)).count() == 0


def test_pairs_that_two_sources_know_are_one_issue(spark):
    cosines = spark.createDataFrame([(2, 1, 0.95), (1, 2, 0.95), (3, 4, 0.93), (5, 5, 1.0), (1, 99, 0.99)], "a long, b long, cosine double")
    groups = spark.createDataFrame([(1, 1, 100), (2, 1, 88), (6, 1, 91)], "id long, representative long, similarity long")
    quality = spark.createDataFrame([(1, 50.0, 10), (2, 60.0, 10), (3, None, 5), (4, None, 9), (6, 50.0, 10)], "id long, score double, area long")
    out = {r.key: (r.ids, round(r.impact, 6), r.fingerprint, r.source) for r in issues.near_duplicate_issues(cosines, groups, quality).collect()}
    assert out == {"dup:1:2": ([2, 1], 93.0, "0.95", "embedding"), "dup:3:4": ([4, 3], 91.0, "0.93", "embedding"), "dup:1:6": ([1, 6], 90.0, "0.91", "perceptual")}


def test_resolutions_count_as_of_a_report(spark):
    history = spark.createDataFrame([("k", "1", "ignored", 1), ("k", "2", "fixed", 5), ("k", "2", None, 9), ("m", "7", "ignored", 2), ("gone", "1", "ignored", 1)], "key string, fingerprint string, resolution string, version long")
    found = spark.createDataFrame([("k", "1", 0), ("k", "1", 3), ("k", "1", 6), ("k", "2", 6), ("k", "2", 9), ("m", "8", 9), ("new", "1", 9)], "key string, fingerprint string, report long")
    out = {(r.key, r.fingerprint, r.report): (r.state, r.resolution, r.version) for r in issues.in_force(found, history).collect()}
    assert out == {
        ("k", "1", 0): ("open", None, None), ("k", "1", 3): ("resolved", "ignored", 1), ("k", "1", 6): ("changed", None, 5), ("k", "2", 6): ("resolved", "fixed", 5),
        ("k", "2", 9): ("open", None, None), ("m", "8", 9): ("changed", None, 2), ("new", "1", 9): ("open", None, None),
    }
    assert {tuple(r) for r in issues.stale(found.filter("report = 9"), history).collect()} == {("m", 2, "changed"), ("gone", 1, "gone")}
    assert issues.in_force(found, history.limit(0)).filter("state <> 'open'").count() == 0


def test_reports_of_small_sets(spark):
    from lumenset.operators import report

    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    members = one([(1, 1), (1, 2), (1, 2), (2, 3), (2, 99), (3, 4)], "dataset_id long, id long")
    media = one([(1, "a", 2000, 10, 90.0), (2, "a", 100, 100, 50.0), (3, "c", None, None, None), (4, "d", 1024, 1, 80.0)], "id long, sha256 string, width int, height int, score double")
    vectors = one([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, vector array<double>")
    groups = one([(1, 7, 1), (1, 7, 2), (2, 8, 3), (3, 9, 4)], "dataset_id long, group_id long, id long")
    captions = one([(1, "A fine caption."), (2, "it goes on and"), (4, None)], "id long, caption string")
    near = one([(1, 2), (1, 3)], "a long, b long")
    out = {r.dataset_id: r for r in report.pillars(members, media, vectors, vectors.limit(0), groups, captions, near).collect()}
    r = out[1]
    assert (r.images, r.quality, r.spread, r.unique, r.diversity, r.composition, r.hygiene) == (2, 70.0, 100.0, 50.0, 87.5, None, (100 + 50 + 50 + 50) / 4)
    overall = (0.35 * 70 + 0.30 * 87.5 + 0.20 * 62.5) / 0.85
    assert r.overall == pytest.approx(overall) and r.projected == pytest.approx(overall + 0.35 * 20 / 0.85) and (r.low_quality, r.degenerate, r.copies, r.near_pairs, r.uncaptioned) == (1, 1, 1, 1, 0)
    assert (out[2].images, out[2].quality, out[2].diversity, out[2].overall, out[2].hygiene) == (1, None, None, pytest.approx(200 / 3), pytest.approx(200 / 3))
    assert out[3].projected is None and out[3].uncaptioned == 1
    rows = report.framings(members, one([(1, "x"), (3, "y")], "id long, bucket string"), {"x": 1, "y": 1, "any": 9})
    assert {(r.dataset_id, r.bucket): (r.n, r.share, r.target) for r in rows.collect()}[1, "unknown"] == (1, 50.0, None)
    cards = report.recommendations(report.pillars(members, media, vectors, vectors.limit(0), groups, captions, near), rows, (2, 3)).collect()
    assert [(c.place, c.head, c.n) for c in sorted(cards, key=lambda c: (c.dataset_id, c.place)) if c.dataset_id == 1] == [(0, "Break near-dup pairs", 1), (1, "Prune the floor", 1), (2, "Fill the caption gaps", 1), (3, "Rebalance framing", 0)]
    assert report.pillars(members.limit(0), media, vectors, vectors, groups, captions, near).count() == 0
