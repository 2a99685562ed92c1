"""Every archive query against its SQL, at the smallest scale."""

import glob
import math
import os

import pytest

from quarry.plans import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def sql():
    found = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        found.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return found


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return "~" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sql, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rel = sql.sql(queries.SQL[name])
    assert sorted(rel.columns) == columns
    want = [[row[rel.columns.index(c)] for c in columns] for row in rel.fetchall()]
    got = [[row[c] for c in columns] for row in found.collect()]
    assert sorted("|".join(map(shown, r)) for r in got) == sorted("|".join(map(shown, r)) for r in want)


def test_entry_has_rows_and_names_agree(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
