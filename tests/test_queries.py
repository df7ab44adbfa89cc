"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tabletrust.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return "null"
    if str(v) in ("True", "False"):
        return str(v)
    try:
        return repr(round(float(v), 3)) if not isinstance(v, bool) and math.isfinite(float(v)) else str(v)
    except (TypeError, ValueError):
        return str(v).replace(" 00:00:00", "")


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL)))
def test_query_equals_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(ORACLE_SQL[name]).df())


def test_rows_only_queries_run(spark):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, SF).count() >= 0
