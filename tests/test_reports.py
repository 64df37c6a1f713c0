"""Reports of sets: pairs counted where they are found, and texts read once."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from lumenset.operators import captions as C
from lumenset.operators import report
from lumenset.operators import vectors as V
from tests.test_against_sql import by_spark, by_sql, tables


def made(seed: int, n: int = 120):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 5))
    vectors = [(i, None if i % 17 == 3 else (centre[rng.integers(6)] + 0.4 * rng.normal(size=5)).tolist()) for i in range(n)]
    sets = {i: sorted({int(x) for x in rng.integers(0, 7, rng.integers(0, 6))}) for i in range(-5, n)}
    return vectors, sets


@pytest.mark.parametrize("block", [7, 40, 2048])
def test_pairs_of_sets_match_all_pairs(spark, block):
    vectors, sets = made(block)
    known = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if v}
    want = Counter(f"s{d}" for a, b in combinations(known, 2) if known[a] @ known[b] >= 0.8 for d in set(sets[a]) & set(sets[b]))
    of = spark.createDataFrame([(i, [f"s{d}" for d in x]) for i, x in sets.items()], "id long, sets array<string>")
    found = V.pairs_in_sets(spark.createDataFrame(vectors, "id long, vector array<float>"), of, 0.8, block).collect()
    assert min(want.values()) > 1 and {r.set: r.n for r in found} == dict(want) and len(found) == len(want)
    assert V.pairs_in_sets(spark.createDataFrame(vectors, "id long, vector array<float>"), of.limit(0), 0.8, block).count() == 0


def test_stretches_hold_every_row_once():
    many = np.cumsum([3, 0, 9, 1, 1, 0, 0, 5])
    assert [list(V._stretches(many, k)) for k in (1, 100)][1] == [(0, 8)]
    for k in (1, 2, 4, 7):
        rows = [x for lo, hi in V._stretches(many, k) for x in range(lo, hi)]
        assert rows == list(range(8))


def test_a_report_counts_pairs_as_a_list_of_them_does(spark):
    vectors, sets = made(5)
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    members = one([(None if d == 6 else d, i) for i, x in sets.items() for d in x] * 2, "dataset_id long, id long")
    media = one([(i, f"h{i // 2}", 1000 + i, 900, None if i % 5 == 0 else float(i)) for i, _ in vectors if i % 11], "id long, sha256 string, width int, height int, score double")
    vectors = one(vectors, "id long, vector array<double>")
    captions = one([(i, ["Fine.", "it goes on", None, "", "a b c a b c a b c d."][i % 5]) for i in range(90)], "id long, caption string")
    groups = media.selectExpr("id", "xxhash64(sha256) AS group_id")
    near = V.cosine_pairs(vectors, 0.8).select("a", "b")
    by_list = report.pillars(members, media, vectors, vectors, members.distinct().join(groups, "id"), captions, near).collect()
    direct = report.pillars(members, media, vectors, vectors, groups, captions, 0.8).collect()
    plain = lambda rows: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=repr)
    sets_of = [r for r in by_list if r.dataset_id is not None]
    assert len(by_list) == 7 and all(r.near_pairs > 0 for r in sets_of)
    assert plain(sets_of) == plain([r for r in direct if r.dataset_id is not None])
    (none,) = [r for r in direct if r.dataset_id is None]
    assert none.images == len({i for i, x in sets.items() if 6 in x and i >= 0 and i % 11}) and none.near_pairs == 0


def test_texts_are_neither_joined_nor_sorted(spark):
    df = spark.createDataFrame([(1, "a b c a b c a b c d."), (2, None)], "id long, t string")
    found = C.integrity(df, "id", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.issues for r in found.collect()} == {1: ["repetition"], 2: ["empty"]}
    assert "Join" not in plan and "Sort" not in plan


def test_targets_need_no_table_of_their_own(spark):
    members = spark.range(9).selectExpr("id % 2 AS dataset_id", "id")
    found = report.framings(members, spark.range(5).selectExpr("id", "'x' AS bucket"), {"x": 1, "y": 3, "any": 9})
    assert {tuple(r) for r in found.collect()} == {(0, "x", 3, 60.0, 25.0), (0, "unknown", 2, 40.0, None), (0, "y", 0, 0.0, 75.0), (1, "x", 2, 50.0, 25.0), (1, "unknown", 2, 50.0, None), (1, "y", 0, 0.0, 75.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert report.framings(members, spark.range(5).selectExpr("id", "'x' AS bucket"), {"any": 9}).filter("target IS NOT NULL").count() == 0


@pytest.mark.parametrize("name", ["integrity_codes", "integrity_empty", "integrity_truncated", "integrity_repetition"])
def test_odd_texts_match_sql(spark, tmp_path, name):
    texts = ["", " ", None, "\t\n\x0b\x0c\r", "ab", " abc", "abc. \u2028", "It ends.\u201d )", "no end \u00bb]}", "x\u00a0y z", "\ufffd\ufffd\ufffdabc.", "caf\u00e9 \u00ad\u00ad.", "\u65e5\u672c\u8a9e\u3002", "\u200b\u200b\u200b", "</think>x.", "a < b.", "<|end|>", "\x07\x07 bell."]
    texts += ["a b c " * 3, "A b\nC a\tB c a b  c.", "a a a a", "a a a a a.", "\u00c9t\u00e9 \u00e9t\u00e9 \u00c9T\u00c9 " * 3, " ".join(f"w{k % 50}" for k in range(99)), " ".join(f"w{k % 50}" for k in range(199)), "k l m \u2028 k l m \u2028 k l m"]
    folder = tables(tmp_path, documents=pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "web", "n_chars": 1}))
    assert by_spark(spark, name, folder) == by_sql(name, folder)
