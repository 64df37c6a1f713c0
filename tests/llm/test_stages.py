"""Each stage of the pipeline on odd tables: nulls, empty and very long texts, ties, repeated rows, clashing names, no rows."""

import corpus_pipeline
import numpy as np
import pytest

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
_RNG = np.random.default_rng(17)
_some = lambda n: " ".join(f"w{x}" + "." * (k % 9 == 8) for k, x in enumerate(_RNG.integers(0, 5000, n)))
GOOD, OTHER, MAIL = _some(130), _some(120), "mail me at jo.x@ex.org " + _some(110)
ROWS = [
    (1, GOOD, "en", "a", 1), (2, GOOD, "en", "a", 2), (2, GOOD, "en", "a", 2), (3, GOOD + " More.", "en", None, 3), (4, None, "en", "b", 4), (5, "", None, "b", 5),
    (None, OTHER, "en", "b", 6), (6, LONG, "en", "c", 7), (7, MAIL, "en", "c", 8), (8, " \n\t ", "en", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("fp", "uid", "key", "mix", "quality", "h1", "hash", "size")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (5, 0, None), (None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_none(spark, odd, folder, name):
    for docs in (odd, spark.createDataFrame(ROWS, SCHEMA)):
        out = stage(name)(spark, docs, folder)
        rows = out.collect()
        assert rows and (name == "pack" or out.columns == docs.columns)
        none = stage(name)(spark, docs.limit(0), folder)
        assert none.columns == out.columns and none.count() == 0


def test_what_the_stages_decide(spark, odd, folder):
    kept = [r.doc_id for r in stage("quality_rules")(spark, odd, folder).collect()]
    assert kept.count(2) == 2 and 1 in kept and not {4, 5, 8} & set(kept)  # no words: under the least number
    left = [r.doc_id for r in stage("near_duplicates")(spark, odd, folder).collect()]
    assert left.count(1) == 1 and not {2, 3} & set(left) and {6, 7} <= set(left)
    clean = {r.doc_id: r for r in stage("personal_data")(spark, odd, folder).collect()}
    assert "jo.x@ex.org" not in clean[7].text and clean[7].n_chars == len(clean[7].text) and clean[1].text == GOOD and clean[6].text == LONG
    mixed = [r.doc_id for r in stage("mix")(spark, odd, folder).collect()]
    assert all(mixed.count(i) <= 3 * [r[0] for r in ROWS].count(i) for i in set(mixed)) and mixed == [r.doc_id for r in stage("mix")(spark, odd, folder).collect()]
    pieces = stage("pack")(spark, odd, folder).collect()
    used = {}
    for p in pieces:
        assert p.length > 0 and p.offset + p.length <= 2048
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sum(p.length for p in pieces if p.doc_id == 6) == next(p.doc_tokens for p in pieces if p.doc_id == 6)
