"""Results against the SQL that stands beside each query, on rows made for the edges."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenset.functions.rounding import rounded, steady_avg
from lumenset.sources.views import TABLES

DAY = pd.Timestamp("2001-01-01").as_unit("us")


def tables(folder, **made: pd.DataFrame):
    """A folder of tables: those given, the others from the smallest ones."""
    for name in TABLES:
        path = f"/root/testdata/sf0.001/{name}.parquet"
        sql = f"SELECT * FROM '{path}'"
        with duckdb.connect() as c:
            if not os.path.exists(path) and name not in made:
                continue
            if name in made:
                c.register("made_rows", made[name])
                sql = "SELECT * FROM made_rows"
            c.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def by_sql(name: str, folder: str) -> list[tuple]:
    with duckdb.connect() as c:
        for t in TABLES:
            if os.path.exists(f"{folder}/{t}.parquet"):
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return sorted(c.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=repr)


def by_spark(spark, name: str, folder: str) -> list[tuple]:
    return sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect()), key=repr)


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Parts whose averages lie halfway between two sixth digits: lines of two metrics each."""
    parts = pd.DataFrame({"p_partkey": range(20_000, 20_400), "p_name": "blue ring", "p_brand": "Brand#1", "p_type": "SMALL", "p_size": 1, "p_retailprice": 1.0}).astype({"p_size": "int32"})
    lines = []
    for n, key in enumerate(parts["p_partkey"]):
        quantities = [1.0, 50.0, *[float(1 + (n * k) % 47) for k in range(1, 8 + n % 23)]]
        lines += [(5 * (key * 40 + i), key, 1, 1, q, 1.0, ((n + i) % 11) / 100, ((n * i) % 9) / 100, "N", "O", DAY) for i, q in enumerate(quantities)]
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    lines = pd.DataFrame(lines, columns=names).astype({"l_linenumber": "int32", "l_shipdate": "datetime64[us]"})
    orders = pd.DataFrame({"o_orderkey": lines["l_orderkey"], "o_custkey": lines["l_partkey"] % 2 * 5, "o_orderstatus": "O", "o_totalprice": 1.0, "o_orderdate": DAY, "o_orderpriority": "LOW"}).astype({"o_orderdate": "datetime64[us]"})
    return tables(tmp_path_factory.mktemp("halves"), part=parts, lineitem=lines, orders=orders)


@pytest.mark.parametrize("name", ["quality_average", "candidates_by_score", "members_worst_first", "upgrade_pairs"])
def test_scores_halfway_are_rounded_as_in_sql(spark, halves, name):
    assert by_spark(spark, name, halves) == by_sql(name, halves)


def test_rounded_is_what_duckdb_rounds(spark):
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -2.5e-6, 51.8593725, 47.8077115, 1e17, -1e300, 0.1 + 0.2, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.r for r in df.select(rounded(df.x, 6).alias("r")).collect()]
    with duckdb.connect() as c:
        want = [c.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]
    assert [repr(x) for x in got] == [repr(x) for x in want]


def test_a_mean_does_not_depend_on_the_order(spark):
    values = [0.01 * (k * k % 9) for k in range(4096)]
    found = {spark.createDataFrame([(v,) for v in vs], "x double").repartition(n).select(steady_avg(F.col("x"))).first()[0] for vs in (values, values[::-1], sorted(values)) for n in (1, 3)}
    assert found == {math.fsum(values) / len(values)}
    odd = spark.createDataFrame([(1e300,), (None,), (-1e300,), (3.0,)], "x double")
    assert odd.select(steady_avg(F.col("x"))).first()[0] in (0.0, 1.0)
    assert odd.filter("x is null").select(steady_avg(F.col("x"))).first()[0] is None


def test_review_targets_have_short_texts_and_no_blanks(spark, tmp_path):
    texts = ["", " ", " 　", "\t\n", ".", "ab", "  a ", "whole text.", None]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "web", "n_chars": 1})
    folder = tables(tmp_path, documents=docs)
    assert by_spark(spark, "review_targets", folder) == by_sql("review_targets", folder)
