"""Known answers of the library's operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenset.operators import captions, greedy, hashes, rules, scores, selection, vectors
from lumenset.operators.graph import components
from lumenset.sources import console
from lumenset.streaming import jobs


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similarity_and_distance(spark):
    assert [hashes.similarity_to_distance(s) for s in (88, 100, 0)] == [4, 0, 33]
    row = spark.range(1).select(hashes.distance_to_similarity(F.lit(4)).alias("a"), hashes.distance_to_similarity(F.lit(64)).alias("b")).first()
    assert (row.a, row.b) == (88, 0)


def test_lookalikes_need_both_hashes(spark):
    rows = [(1, 0, 0, 0, 0), (2, 0, 1, 0, 3), (3, 0, 1, 0, 255), (4, 2**32 - 1, 2**32 - 1, 0, 0), (5, 0, 7, 0, 3)]
    h = spark.createDataFrame(rows, "id long, p_hi long, p_lo long, d_hi long, d_lo long")
    assert {(r.a, r.b) for r in hashes.lookalike_pairs(h, 4).collect()} == {(1, 2), (1, 5), (2, 5)}
    groups = {r.id: (r.group_id, r.representative) for r in hashes.lookalike_groups(h, 4).collect()}
    assert groups == {1: (1, 1), 2: (1, 1), 5: (1, 1)}


def test_quotas():
    assert selection.quotas(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert selection.quotas(0, {"a": 1}) == {} and selection.quotas(5, {"a": 0, "b": -1}) == {}


def test_greedy_takes_favourites_then_far_vectors(spark):
    rows = [(1, "x", False, 10.0, [1.0, 0.0]), (2, "x", True, 0.0, [0.9, 0.1]), (3, "x", False, 10.0, [-1.0, 0.0]), (4, "x", False, None, None)]
    df = spark.createDataFrame(rows, "id long, bucket string, favorite boolean, score double, vector array<float>")
    assert [r.id for r in greedy.pick_diverse(df, 3, {"any": 1}).orderBy("place").collect()] == [2, 3, 1]


def test_suppression_keeps_the_best_box(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 5.0), (1, 1, 1.0, 1.0, 10.0, 10.0, 9.0), (1, 2, 50.0, 50.0, 5.0, 5.0, 1.0), (2, 0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "media_id long, box_no long, x double, y double, w double, h double, score double")
    assert {(r.media_id, r.box_no) for r in selection.suppress(df).collect()} == {(1, 1), (1, 2), (2, 0)}


def test_rank_of_one_row_is_one(spark):
    df = spark.createDataFrame([(1, 0.5)], "id long, score double")
    assert scores.rank_normalized(df, "score", "id").first()["rank"] == 1.0


def test_merge_prefers_incoming_words():
    merged = captions.merged
    assert merged("a b c", "a x c", "a b d") == ("a x d", False)
    assert merged("a b c", "a x c", "a y c") == ("a y c", True)
    assert merged("a b", "a b", "q") == ("q", False) and merged("a b", "q", "a b") == ("q", False) and merged("a", "b", "b") == ("b", False)
    assert merged("a red ball.", "NEW a red ball.", "a red ball. On grass.") == ("NEW a red ball. On grass.", False)
    assert merged("a red ball on grass. the sky is blue.", "a pink ball on grass. the sky is very blue.", "a crimson ball on grass. the sky is blue.") == ("a crimson ball on grass. the sky is very blue.", True)
    base, now, fix = "a red ball near the old tree. mark bottom right.", "a pink ball near the tall tree. mark bottom right.", "a crimson sphere near the old tree. no mark visible."
    assert merged(base, now, fix) == (fix, True)
    assert merged("one,\n two", "one,\n  two", "one,\n three") == ("one,\n  three", False)
    assert merged("", "x", "y") == ("y", True) and merged("a", "", "b") == ("b", True)


def test_claims_and_reasoning(spark):
    raw = ['x [{"text": "a dog", "kind": "action"}, "12"] y', "- a cat\n2) red\n--", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(captions.parse_claims("raw").alias("c"))
    assert [[x.text for x in r.c] for r in df.collect()] == [["a dog"], ["a cat", "red"], []]
    one = spark.createDataFrame([("<think>no</think> a ball",), ("<|channel|>analysis no <|channel|>final<|message|>yes<|end|>",)], "t string")
    assert [r.t for r in one.select(captions.strip_reasoning(F.col("t")).alias("t")).collect()] == ["a ball", "yes"]


def test_folder_rules(spark):
    schema = "rel_path string, mode string, sub_id long, tags array<string>, removed array<string>"
    given = [("", "inherit", None, ["root"], None), ("a", "sublib", 7, ["t"], None), ("a/b", "inherit", None, ["u"], ["t"]), ("x", "exclude", None, None, None)]
    out = rules.resolved(spark.createDataFrame([("a/b/c",), ("x/y",), ("z",)], "folder string"), spark.createDataFrame(given, schema), auto_depth=1)
    got = {r.folder: (r.excluded, r.owner, r.tags) for r in out.collect()}
    assert got == {"a/b/c": (False, 7, ["root", "a", "u"]), "x/y": (True, None, []), "z": (False, None, ["root", "z"])}


def test_spread_is_the_mean_over_pairs(spark):
    x = np.random.default_rng(1).normal(size=(30, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = (u @ u.T)[np.triu_indices(30, 1)]
    assert vectors.spread(df).first().mean_distance == pytest.approx(1 - m.mean(), abs=1e-5)
    pairs = vectors.cosine_pairs(df, 0.4, block=7).count()
    assert pairs == int((m >= 0.4).sum())


def test_console_refuses_writes(spark):
    assert console.run_query(spark, "-- note\nSELECT 1 AS x").first().x == 1
    with pytest.raises(console.Refused):
        console.run_query(spark, "DROP TABLE t")


def test_incremental_index_reads_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for k in range(2):
        spark.createDataFrame([(k,)], "id long").write.mode("append").parquet(src)
        jobs.index_new(spark, src, "id long", out, ck, lambda df: df.withColumn("done", F.lit(True)))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1]


def test_zones_stay_inside_and_nothing_known_passes(spark):
    from pyspark.sql import functions as F

    from lumenset.operators import library, zones

    box = spark.createDataFrame([(0.9, -1.0, 0.5, 0.0), (0.0, 0.0, 2.0, 1.0)], "x double, y double, w double, h double")
    got = [tuple(r) for r in box.select(*[c.alias(k) for k, c in zones.clamped().items()]).collect()]
    assert got == [(0.5, 0.0, 0.5, 0.005), (0.0, 0.0, 1.0, 1.0)]
    row = spark.createDataFrame([(None, None, None), (10.0, 2000, 50.0)], "score double, side int, sharp double")
    ok = row.select(library.passes_static(F.col("score"), 50, F.col("side"), 1024, F.col("sharp")).alias("ok")).collect()
    assert [r.ok for r in ok] == [True, False]
    files = spark.createDataFrame([("top.png",), ("a/b/1.png",), ("a/.x/2.png",), ("a/3.png",)], "rel_path string")
    tree = {r.folder: (r.own, r.total, r.samples) for r in library.folder_tree(files).collect()}
    assert tree == {"a": (1, 2, "a/3.png"), "a/b": (1, 1, "a/b/1.png")}
