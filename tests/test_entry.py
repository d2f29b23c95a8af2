import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from polispark.plans import derive, extra, lookup, more, problems, records, reference, sqlapi

CORE = [n for part in (problems, reference, more, extra, derive, lookup, records, sqlapi) for n in part.QUERIES]


def canon(df):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, str):
            return v
        return str(round(float(v), 5)) if not hasattr(v, "year") else str(pd.Timestamp(v).tz_localize(None))

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    text = entry.oracle_sql().get(name)
    if text:
        want = duck.execute(text).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_but_the_entry_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in glob.glob(f"{root}/polispark/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "polispark.llm" not in open(f).read(), f
