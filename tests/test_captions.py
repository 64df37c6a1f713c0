"""Caption checks against plain Python, and the console's gate."""

from collections import Counter

import numpy as np
import pytest

from lumenset.operators import captions as C
from lumenset.sources import console


def test_repeated_phrases_match_a_counter(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "a b", "a b c", "x y z " * 3, "A b  c\na B c\ta b C", "a a a a a", "a a a a", "p q r p q r p q r s t u s t u s t u"]
    texts += [" ".join(rng.choice(list("abcd"), n)) for n in (5, 30, 60, 400, 4000)] + [" ".join(rng.choice([f"w{i}" for i in range(900)], 20_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4])]
    want = []
    for i, t in rows:
        w = (t or "").lower().split()
        top = Counter(zip(w, w[1:], w[2:])).most_common(1)
        want += [(i, " ".join(top[0][0]), top[0][1])] if top and top[0][1] >= 3 else []
    df = spark.createDataFrame(rows, "id long, t string")
    assert sorted(map(tuple, C.repeated_phrases(df, "id", "t").collect())) == sorted(want)
    assert C.repeated_phrases(df.limit(0), "id", "t").count() == 0


def test_garbage_matches_plain_python(spark):
    texts = [None, "", "  ", "fine text", "�" * 2 + "x" * 10, "�" * 2 + "x" * 12, "\x00\x01 ab", "a​b", " x y\x1c", "zz", "\U0001f600 smile", "\x85�\x85"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")

    def plain(t):
        t = (t or "").strip()
        return bool(t) and sum(c == "�" or not (c.isspace() or c.isprintable()) for c in t) >= 0.15 * len(t)

    got = {r.id: bool(r.g) for r in df.select("id", C.is_garbage(df.t).alias("g")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert {r.id: r.issues for r in C.integrity(df, "id", "t").collect()}[4] == ["truncated", "garbage"]


def test_the_console_refuses_what_writes_anywhere(spark, tmp_path):
    spark.sql(f"CREATE TABLE kept (a INT) USING parquet LOCATION '{tmp_path}/kept'")
    try:
        for sql in ("WITH x AS (SELECT 7 AS a) INSERT INTO kept SELECT a FROM x", "EXPLAIN INSERT INTO kept SELECT 1", "DROP TABLE kept", "-- c\nINSERT INTO kept SELECT 1", "SET x = 1"):
            with pytest.raises(console.Refused):
                console.run_query(spark, sql)
        assert console.run_query(spark, "SELECT * FROM kept").count() == 0
        for sql in ("/* c */ (SELECT 1)", "WITH x AS (SELECT 1 AS a) SELECT * FROM x", "SHOW TABLES", "DESCRIBE kept", "EXPLAIN SELECT 1"):
            console.run_query(spark, sql).collect()
    finally:
        spark.sql("DROP TABLE kept")
