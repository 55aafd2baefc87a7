"""Every registered query of the library against its SQL on the small tables."""

import os

import duckdb
import pandas as pd
import pytest
from granary.plans.operator_queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    value = lambda v: "" if v is None or v is pd.NaT or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted(str([value(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, db, name):
    got, expected = QUERIES[name](spark, FOLDER).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
