"""Swaps by search: levels of many equal newcomers, with and without vectors, and no rows gathered for each pair."""

import numpy as np

from lumenset.operators import swaps
from lumenset.operators.vectors import unit


def test_first_found_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(swaps, "DEALT", 7)
    rng = np.random.default_rng(5)
    names = ["blue ring", "red ring", "blue bolt", "old plate"]
    media = spark.createDataFrame([(i, names[i % 4]) for i in range(120)], "id long, name string")
    tags = spark.createDataFrame([(i, "BLUE" if i % 5 == 0 else "small") for i in range(100)], "media_id long, name string")
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in [*range(0, 120, 3), 200, 201]], "id long, vector array<float>")
    requests = spark.createDataFrame([(200, "blue ring"), (201, "ring blue"), (202, "blue"), (203, "plate nothing"), (3, "blue ring")], "id long, q string")
    found = swaps.searched(requests, media, tags)
    u = {r.id: r.u for r in vectors.select("id", unit().alias("u")).collect()}
    want = {}
    for r in found.collect():
        c = float(np.dot(u[r.id], u[r.other])) if r.id in u and r.other in u else 0.0
        want.setdefault(r.id, []).append((-r.points, -round(c, 9), r.other, r.why))
    want = {k: [x[2:] for x in sorted(v)[:5]] for k, v in want.items()}
    got = {}
    for r in swaps.swap_lists(requests, media, tags, vectors).collect():
        got.setdefault(r.id, []).append((-r.points, -round(r.cosine, 9), r.other, r.why))
    assert {k: [x[2:] for x in sorted(v)] for k, v in got.items()} == want and set(want) == {200, 201, 202, 203, 3}


def test_equal_searches_and_kinds_are_scored_once(spark):
    media = spark.createDataFrame([(i, "blue ring") for i in range(300)], "id long, name string")
    tags = spark.createDataFrame([(i, "BLUE") for i in range(300)], "media_id long, name string")
    requests = spark.createDataFrame([(1000 + i, "ring blue" if i % 2 else "Blue, ring") for i in range(50)], "id long, q string")
    assert swaps._scored(requests, media, tags)[2].count() == 1
    assert {(r.points, r.why) for r in swaps.searched(requests, media, tags).collect()} == {(3, "#blue")}
    assert swaps.searched(requests, media, tags).count() == 15_000
