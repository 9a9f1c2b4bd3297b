"""Every core query against its SQL on the smallest tables, and all of them for being non-empty."""

import glob
import os

import duckdb
import pytest

import twinfold.plans.report_queries  # noqa: F401  (adds its queries)
from twinfold.plans.queries import ORACLE_SQL, QUERIES

#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY = {"st_rate_windows", "jn_similar_vectors", "dq_missing_members"}


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool | str):
        return v
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return round(float(v), 6)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows or name in MAY_BE_EMPTY
    if name in ORACLE_SQL:
        answer = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in answer.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in answer.fetchall()), key=repr)
