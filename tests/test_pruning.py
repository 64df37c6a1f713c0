"""Pruned searches against all pairs, and that they prune."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenset.operators import hashes, vectors


@pytest.mark.parametrize("most, tile", [(0, 4096), (4, 4096), (7, 50), (8, 50), (20, 50), (20, 4096), (64, 50)])
def test_lookalike_pairs_come_once(spark, most, tile):
    rng = np.random.default_rng(most)
    rows = [(i, *[int(x) for x in rng.integers(0, 1 << 32, 4)]) for i in range(90)]
    for i in range(60):  # near copies, some with the highest bit
        k, flips = int(rng.integers(0, 90)), int(rng.integers(0, most + 3))
        p, d = (rows[k][1] << 32 | rows[k][2]), (rows[k][3] << 32 | rows[k][4])
        for b in rng.choice(64, min(64, flips), replace=False):
            p, d = p ^ 1 << int(b), d ^ 1 << 63 - int(b)
        rows.append((100 + i, p >> 32, p & 0xFFFFFFFF, d >> 32, d & 0xFFFFFFFF))
    rows += [(500, *rows[0][1:]), (501, *rows[0][1:])]
    df = spark.createDataFrame([*rows, (900, None, 1, 1, 1)], "id long, p_hi long, p_lo long, d_hi long, d_lo long")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                p, d = ((a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count()), ((a[3] ^ b[3]).bit_count() + (a[4] ^ b[4]).bit_count())
                if p <= most and d <= most:
                    want[a[0], b[0]] = (p, d)
    got = hashes.lookalike_pairs(df, most, tile).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.p_dist, r.d_dist) for r in got} == want
    assert hashes.lookalike_pairs(df.limit(0), most).count() == 0


def clustered(n=600, dim=6, spread=0.08):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, dim)) * 3
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * spread
    x[50] = x[40]
    return x


def made(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, vector array<double>")


@pytest.mark.parametrize("block", [40, 2048])
def test_vector_searches_equal_all_pairs(spark, block):
    x = clustered()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = u @ u.T
    df = made(spark, x)
    got = {(r.a, r.b): r.cosine for r in vectors.cosine_pairs(df, 0.97, block).collect()}
    a, b = np.nonzero(np.triu(m >= 0.97, 1))
    assert set(got) == set(zip(a.tolist(), b.tolist())) and all(c == pytest.approx(m[p]) for p, c in got.items())
    near = {}
    for r in vectors.neighbours(df, 3, block).collect():
        near.setdefault(r.id, {})[r["rank"]] = r.cosine
    np.fill_diagonal(m, -np.inf)
    best = -np.sort(-m, axis=1)[:, :3]
    assert set(near) == set(range(600)) and all([near[i][k] for k in (1, 2, 3)] == pytest.approx(best[i].tolist()) for i in near)
    none = df.limit(0)
    assert vectors.cosine_pairs(none, 0.5).count() == 0 and vectors.neighbours(none).count() == 0


def test_tiles_that_cannot_matter_are_not_compared(spark):
    tiles = vectors.Tiles(made(spark, clustered()), 40)
    reach = tiles.in_reach(float(np.arccos(0.97)))
    assert tiles.number > 10 and sum(map(len, reach.values())) < 0.5 * len(reach) * tiles.number
    assert tiles.rows.select(F.countDistinct("id")).first()[0] == 600
