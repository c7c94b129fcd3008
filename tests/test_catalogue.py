"""Every query of the catalogue against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from treescan.plans import catalogue


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(name, spark, data, duck):
    found = catalogue.QUERIES[name](spark, data)
    wanted = duck.execute(catalogue.SQL[name])
    columns = [x[0] for x in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert key([[r[c] for c in columns] for r in found.collect()]) == key(wanted.fetchall())


def test_footers(spark, data):
    assert [r["ok"] for r in catalogue.footer_crc(spark, data).collect()] == [True, True, True, False]


def test_registry_has_sql_for_all_but_the_real_world(spark):
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"fs_real_listing", "footer_crc"}
