"""Every query of the catalog against its SQL, over the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lumenset.plans import catalog, curation, records, studio  # noqa: F401 (the others add their queries to the catalog)
from lumenset.sources.views import TABLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    def text(x):
        if x is None or type(x).__name__ in ("NAType", "NaTType") or isinstance(x, float) and math.isnan(x):
            return "-"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(text(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    mine, theirs = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).fetch_df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.astype({c: float for c in mine if str(mine[c].dtype) == "Int64"})) == rows(theirs.astype({c: float for c in theirs if str(theirs[c].dtype) == "Int64"}))
