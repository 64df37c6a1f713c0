"""The studio's selection and the builder's preparation against plain loops."""

import numpy as np
import pytest

from lumenset.operators import greedy, selection

SCHEMA = "id long, bucket string, favorite boolean, eligible boolean, score double, subject double, group_id long, vector array<double>"


def made(seed, n=90):
    rng = np.random.default_rng(seed)
    centres, rows = rng.normal(size=(7, 5)), []
    for i in range(n):
        v = centres[rng.integers(0, 7)] + rng.normal(size=5) * rng.choice([0.02, 0.5])
        score = None if rng.random() < 0.15 else float(rng.integers(0, 20) * 5)
        rows.append((i, "abc"[rng.integers(0, 3)], bool(rng.random() < 0.06), bool(rng.random() < 0.9), score, float(rng.integers(0, 11)) / 10, int(i // 3) if rng.random() < 0.2 else None, None if rng.random() < 0.1 else v.tolist()))
    return rows


def plain_studio(rows, size, ratios, forced=(), dropped=(), subject=False, rebalance=False):
    rows = [r for r in rows if r[0] not in dropped]
    by = {r[0]: r for r in rows}
    u = {r[0]: np.array(r[7]) / np.linalg.norm(r[7]) for r in rows if r[7]}
    picks, meta = [], {}
    weights = (0.32, 0.40, 0.28) if subject else (0.45, 0.55, 0.0)

    def near(i):
        return [float(u[i] @ u[p]) for p in picks if i in u and p in u]

    def far(i):
        return 0.0 if i not in u else max(0.0, 1 - max(near(i), default=-1.0))

    def gain(i):
        return min(1.0, far(i) / 0.55)

    def copy(i):
        return any(by[p][6] is not None and by[p][6] == by[i][6] for p in picks) or max(near(i), default=0) >= 0.92

    def worth(i):
        base = weights[0] * (by[i][4] or 0) / 100 + weights[1] * gain(i) + weights[2] * by[i][5]
        if rebalance and len(picks) >= 4:
            base -= 0.85 * max(0.0, sum(1 - c < 0.55 for c in near(i)) / len(picks) - 0.22)
        return round(base, 9)

    def commit(i, dup):
        meta[i] = (round(gain(i), 9), dup)
        picks.append(i)

    for i in forced:
        if i in by and i not in meta:
            commit(i, False)
    fans = sorted((r for r in rows if r[2] and r[3] and r[0] not in meta), key=lambda r: (r[4] is None, -(r[4] or 0), r[0]))
    for r in fans[: max(0, size - len(picks))]:
        commit(r[0], False)

    def fill(where, quota, copies):
        n = 0
        while len(picks) < size and n < quota:
            able = [r[0] for r in rows if r[3] and where(r) and r[0] not in meta and (copies or not copy(r[0]))]
            if not able:
                return
            commit(min(able, key=lambda i: (-worth(i), by[i][4] is None, -(by[i][4] or 0), i)), copies)
            n += 1

    for bucket, quota in selection.quotas(size, ratios).items():
        fill(lambda r, b=bucket: b in ("any", r[1]), quota, False)
    for copies in (False, True):
        fill(lambda r: True, size, copies)
    return [(i, n, *meta[i]) for n, i in enumerate(picks)]


CASES = [
    ({"any": 1}, {}), ({"a": 2, "b": 1, "c": 1}, {"subject": True}), ({"a": 1}, {"forced": [5, 70, 5, 999], "dropped": [6, 70]}),
    ({"a": 1, "b": 1}, {"rebalance": True}), ({"c": 9, "any": 1}, {"rebalance": True, "subject": True, "forced": [1]}),
]


@pytest.mark.parametrize("ratios, options", CASES)
@pytest.mark.parametrize("size, fetched", [(30, 6), (85, 1024)])
def test_the_selection_equals_the_plain_loop(spark, ratios, options, size, fetched):
    rows = made(len(ratios) + size)
    df = spark.createDataFrame(rows, SCHEMA)
    got = greedy.studio_select(df, size, ratios, fetched=fetched, **options).orderBy("place").collect()
    assert [(r.id, r.place, round(r.gain, 9), r.near_dup) for r in got] == plain_studio(rows, size, ratios, **options)


def test_copies_come_only_for_want_of_others(spark):
    v = [1.0, 0.0]
    rows = [(i, "a", False, True, 90.0 - i, 0.0, None, v) for i in range(4)] + [(9, "a", False, True, 10.0, 0.0, None, [0.0, 1.0])]
    out = greedy.studio_select(spark.createDataFrame(rows, SCHEMA), 4, {"any": 1}).orderBy("place").collect()
    assert [(r.id, r.near_dup) for r in out] == [(0, False), (9, False), (1, True), (2, True)]


def test_many_picks_take_few_passes(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "a", False, True, float(rng.random() * 100), 0.0, None, rng.normal(size=16).tolist()) for i in range(3000)]
    pool = greedy.Pool(spark.createDataFrame(rows, SCHEMA), greedy.Worth())
    assert pool.fill(greedy._in_bucket("any"), 400, copies=False) == 400
    assert pool.picked().count() == 400 and pool.passes < 20


def test_nothing_to_pick_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert greedy.studio_select(none, 5, {"any": 1}, forced=[1]).count() == 0 and greedy.pick_diverse(none, 5, {"a": 1}).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, None, None, None)], SCHEMA)
    assert [r.id for r in greedy.studio_select(one, 5, {"any": 1}).collect()] == [1]
    assert greedy.studio_select(one, 0, {"any": 1}).count() == 0


def test_preparation_drops_by_bar_and_group(spark):
    media = [
        (1, False, 80.0, 10, 10, [1.0]), (2, True, 70.0, 10, 10, [1.0]), (3, False, None, 10, 10, [1.0]), (4, False, 10.0, 10, 10, None),
        (5, False, 60.0, 20, 20, None), (6, None, 60.0, 10, 10, None), (7, False, 60.0, None, 10, None), (8, False, 95.0, 1, 1, None),
    ]
    df = spark.createDataFrame(media, "id long, favorite boolean, score double, width int, height int, vector array<double>")
    groups = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (5, 5), (5, 6), (5, 7)], "group_id long, id long")
    buckets = spark.createDataFrame([(2, "x"), (5, "y")], "id long, bucket string")
    out, counters = greedy.prepared(df, groups, buckets, 50.0)
    assert sorted((r.id, r.bucket) for r in out.collect()) == [(2, "x"), (5, "y"), (8, "unknown")]
    assert tuple(counters.first()) == (3, 1, 1, 3, 1)
    out, counters = greedy.prepared(df, groups, buckets)
    assert sorted(r.id for r in out.collect()) == [2, 4, 5, 8] and tuple(counters.first()) == (4, 0, 0, 4, 2)
    assert tuple(greedy.prepared(df.limit(0), groups, buckets)[1].first()) == (0, 0, 0, 0, 0)
