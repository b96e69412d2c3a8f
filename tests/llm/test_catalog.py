"""Every query of the subpackage runs over whole tables, and agrees with its SQL where it has one."""

import duckdb
import pytest

from quillon.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    assert rows
    sql = catalog.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        want = con.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
