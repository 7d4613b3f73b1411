"""Every query with SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from folioscope import catalog

SF = "/root/testdata/sf0.001"
ONLY = os.environ.get("ORACLE_SF", SF)


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


# the readers' rows are compared without Spark in test_formats; one of each kind of file goes through it here
READERS = ("read_csv", "read_docx", "read_jsonpatch", "read_lcov", "read_plist", "read_sbml", "read_stl")


@pytest.mark.parametrize("name", sorted(n for n in catalog.oracle_sql() if not n.startswith("read_") or n in READERS))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(ONLY).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = catalog.queries()[name](spark, ONLY)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
