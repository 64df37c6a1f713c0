"""Selection operators and rewrites on hand-made tables: nulls, ties, repeats, empties."""

import pytest
from pyspark.sql import functions as F

from lumenset.operators import studio


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_winner_by_value_then_area_then_id(spark):
    rows = [(1, 5, 50.0, None, 10), (1, 4, 50.0, None, 10), (1, 6, 50.0, None, 9), (2, 8, None, 10.0, None), (2, 7, 1.0, None, 99)]
    df = spark.createDataFrame(rows, "group_id long, id long, score double, sharpness double, area long")
    assert ids(studio.winners(df), "group_id", "id", "members") == [(1, 4, 3), (2, 8, 2)]
    assert studio.winners(df.filter("false")).count() == 0


def test_upsert_and_replace(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, n long, v string")
    new = spark.createDataFrame([(2, 5, "x"), (2, 9, "y"), (3, 1, None)], "k long, n long, v string")
    assert studio.upserted(rows, new, ["k"], "n").orderBy("k").collect() == [(1, 1, "a"), (2, 9, "y"), (3, 1, None)]
    assert studio.replaced(rows, new, ["k"]).count() == 4
    assert studio.replaced(rows, new.filter("false"), ["k"], rows.filter("k = 1")).collect() == [(2, 1, "b")]


def test_calibration_is_half_at_the_bar(spark):
    claims = spark.createDataFrame([(1, 0.9), (2, 0.5), (1, None)], "media_id long, cosine double")
    negatives = spark.createDataFrame([(1, i / 10) for i in range(11)], "media_id long, cosine double")
    out = {tuple(r)[:2]: r.score for r in studio.calibrated(claims, negatives).collect()}
    assert out[(1, 0.9)] == pytest.approx(50.0)
    assert out[(2, 0.5)] is None and out[(1, None)] is None


def test_zones_need_three_candidates_and_no_pick(spark):
    rows = [(i, 1.0, 1.0, "blur" if i else None) for i in range(3)] + [(10, 99.0, 73.0, "")] * 3 + [(20, 50.0, 1.0, "")] * 2 + [(30, None, 1.0, "")] * 5
    points = spark.createDataFrame(rows, "id long, x double, y double, excluded string")
    picks = points.filter("id = 10").select("id")
    (row,) = studio.uncovered_zones(points, picks).collect()
    assert (row.x, row.y, row.n, row.why) == (8.33, 9.25, 3, "2 excluded as blurry")
    assert studio.uncovered_zones(points.filter("false"), picks).count() == 0


def test_seeds_are_their_own_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, None)], "id long, vector array<double>")
    assert ids(studio.seed_proximity(v, v.filter("id = 1")), "id", "proximity") == [(1, 1.0), (2, 0.0), (3, 0.0)]
    assert ids(studio.similar_to_selection(v.union(v.filter("id = 1").withColumn("id", F.lit(9).cast("long"))), v.filter("id = 1")), "id") == [(9,)]


def test_reskins_need_both_vectors(spark):
    depth = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0])], "id long, vector array<double>")
    look = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, vector array<double>")
    assert ids(studio.reskins(look, depth), "a", "b") == [(1, 2)]


def test_extensions_keep_their_order(spark):
    df = spark.createDataFrame([(" .TXT, caption\ntxt,.png,a b",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(studio.clean_extensions(F.col("s"), ["png"])).collect()] == [["txt", "caption"], [], None]


def test_stale_scores_and_patched_tags(spark):
    tags = spark.createDataFrame([(1, "b", None), (1, "a", None), (2, "Text_Here", None)], "media_id long, name string, source string")
    stored = spark.createDataFrame([(1, "m", "a, b"), (2, "m", None), (3, "m", None), (1, None, "a, b")], "media_id long, model_id string, scored_text string")
    assert ids(studio.stale_tag_scores(stored, tags, "m"), "media_id", "stale") == [(1, False), (1, True), (2, True), (3, False)]
    zones = spark.createDataFrame([(2, "patched"), (1, "detected"), (1, "patched")], "media_id long, status string")
    assert ids(studio.without_patched_tags(tags, zones, ["text here", "a"]), "media_id", "name") == [(1, "a"), (1, "b")]


def test_findings_resolve_and_are_decided(spark):
    from lumenset.operators import captions

    cols = "finding_id long, status string, before string, after string, current string, applied string, undo string"
    rows = [
        (1, "pending", "a red ball.", "a blue ball.", "NEW a red ball.", None, None),
        (2, "pending", "a red ball.", "a blue ball.", "a pink ball.", None, None),
        (3, "pending", "a", "b", "b ", None, None),
        (4, "accepted", "a", "b", "b", "b", "old"),
        (5, "pending", None, "b", None, None, None),
        (6, None, "a", "b", "a", None, None),
    ]
    df = spark.createDataFrame(rows, cols)
    assert ids(captions.resolved_findings(df), "finding_id", "shown", "conflict", "stale") == [
        (1, "NEW a blue ball.", False, False), (2, "a blue ball.", True, False), (3, "b", True, True), (4, "b", False, False), (5, "b", False, False), (6, "b", False, False),
    ]
    actions = spark.createDataFrame([(1, "accept", None), (2, "accept", "mine"), (3, "reject", None), (4, "undo", None)], "finding_id long, action string, text string")
    out = {r.finding_id: (r.status, r.current, r.applied, r.undo) for r in captions.decided(df, actions).collect()}
    assert out[1] == ("accepted", "NEW a blue ball.", "NEW a blue ball.", "NEW a red ball.") and out[2] == ("accepted", "mine", "mine", "a pink ball.")
    assert out[3] == ("rejected", "b ", None, None) and out[4] == ("pending", "old", None, None) and out[5] == ("pending", None, None, None)
    assert captions.decided(df.filter("false"), actions).count() == 0
