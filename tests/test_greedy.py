"""Greedy choices and zones against plain Python."""

import numpy as np

from lumenset.operators import greedy, selection, vectors


def test_suppression_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(m), i, *map(float, rng.integers(0, 40, 2)), *map(float, rng.integers(5, 30, 2)), float(rng.integers(0, 5))) for i, m in enumerate(rng.integers(0, 6, 120))]
    df = spark.createDataFrame(rows, "media_id long, box_no long, x double, y double, w double, h double, score double")

    def inside(a, b):
        w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        return max(0, w) * max(0, h)

    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[6], r[1])):
        over = [(inside(r, k), r[4] * r[5], k[4] * k[5]) for k in kept if k[0] == r[0]]
        if all(i / (a + b - i) <= 0.5 and i / a <= 0.6 for i, a, b in over):
            kept.append(r)
    assert 0 < len(kept) < len(rows)
    assert sorted((r.media_id, r.box_no) for r in selection.suppress(df).collect()) == sorted((r[0], r[1]) for r in kept)
    assert selection.suppress(df.filter("false")).count() == 0


def test_media_of_many_and_of_few_boxes_are_gone_through_alike(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(m), i, *map(float, rng.integers(0, 40, 2)), *map(float, rng.integers(0, 30, 2)), float(rng.integers(0, 5))) for i, m in enumerate(rng.integers(0, 300, 2000))]
    df = spark.createDataFrame(rows, "media_id long, box_no long, x double, y double, w double, h double, score double")
    found = {}
    for few in (0, 6, 64):
        monkeypatch.setattr(selection, "FEW", few)
        found[few] = sorted((r.media_id, r.box_no) for r in selection.suppress(df).collect())
    assert found[0] == found[6] == found[64] and 300 <= len(found[0]) < 2000


def test_diverse_picks_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    vs = rng.normal(size=(30, 4))
    rows = [(i, "ab"[i % 2], i == 7, float(i * 13 % 100) if i % 5 else None, vs[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, bucket string, favorite boolean, score double, vector array<double>")
    u, picks = vs / np.linalg.norm(vs, axis=1, keepdims=True), []
    for bucket, quota in (("a", 4), ("b", 4)):
        own = [r for r in rows if r[1] == bucket]
        mine = [r[0] for r in own if r[2]]
        picks += mine
        while len(mine) < quota:

            def value(r):
                far = (1 - max(float(u[r[0]] @ u[p]) for p in picks)) / 2 if picks else 1.0
                return (-round(0.7 * far + 0.3 * (r[3] or 0) / 100, 9), r[3] is None, -(r[3] or 0), r[0])

            best = min((r for r in own if r[0] not in picks), key=value)
            mine.append(best[0])
            picks.append(best[0])
    out = greedy.pick_diverse(df, 8, {"a": 1, "b": 1}).orderBy("place").collect()
    assert [r.id for r in out] == picks


def test_clusters_split_what_is_apart(spark):
    rng = np.random.default_rng(7)
    near = lambda at, n, first: [(first + i, (np.array(at) + rng.normal(scale=0.02, size=3)).tolist()) for i in range(n)]
    df = spark.createDataFrame([*near([1, 0, 0], 12, 0), *near([0, 1, 0], 8, 100), (500, None)], "id long, vector array<double>")
    out = {r.id: r.cluster for r in vectors.kmeans(df, 2).collect()}
    assert out == {**dict.fromkeys(range(12), 0), **dict.fromkeys(range(100, 108), 1)}


def test_projection_keeps_the_widest_direction(spark):
    angle = np.linspace(0, 1, 9)
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate(angle)], "id long, vector array<double>")
    out = vectors.project(df).orderBy("id").collect()
    x = np.array([r.x for r in out])
    v = np.stack([np.cos(angle), np.sin(angle)], 1)
    _, _, axes = np.linalg.svd(v - v.mean(0))
    plain = v @ (axes[0] * np.sign(axes[0][np.abs(axes[0]).argmax()]))
    assert np.allclose(x, 100 * (plain - plain.min()) / (plain.max() - plain.min()))


def test_empty_cells(spark):
    at = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    pool = at([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 100.0, 74.0), (4, 50.0, 1.0)])
    assert sorted(map(tuple, vectors.empty_zones(pool, at([(9, 99.0, 73.0)])).collect())) == [(0, 0, 2), (3, 0, 1)]
