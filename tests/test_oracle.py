"""Every query against its SQL twin on DuckDB."""

import duckdb
import pytest

from crosscheck.queries import QUERIES
from crosscheck.sql import ORACLES
from tests.conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    ours = df.toPandas()
    result = duck.execute(ORACLES[name])
    types = {column[0]: str(column[1]) for column in result.description}
    theirs = result.fetchdf()
    columns = sorted(ours.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert len(ours) == len(theirs) > 0
    ours = ours[columns].sort_values(columns).reset_index(drop=True)
    theirs = theirs[columns].sort_values(columns).reset_index(drop=True)
    for column in columns:
        same = (ours[column] == theirs[column]) | (ours[column].isna() & theirs[column].isna())
        assert same.all(), (column, ours[~same].head(), theirs[~same].head())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_seeded_queries_run(name, spark):
    assert QUERIES[name](spark, SF).count() > 0
