"""Registered queries against their SQL twins, on the small tables."""

import os

import pytest
from lexiloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple("~" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["op9_decontam", "op11_periodic_runs", "op12_fingerprints", "op13_collocations"])
def test_query(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    rows = [tuple(r) for r in got.collect()]
    assert rows and canonical(got.columns, rows) == canonical(want.columns, want.fetchall())
