"""Every registered query runs, and agrees with its SQL in another engine."""

import math
import os

import duckdb
import pytest

from quillon.plans import catalog

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = plain(df.select(*names).collect())
    assert got
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall()
        assert len(duck.execute(f"SELECT * FROM ({sql}) LIMIT 0").description) == len(names)
        assert got == plain(want)
