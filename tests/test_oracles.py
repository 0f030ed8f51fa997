"""Each registered query against its SQL twin, on the small tables."""

import os

import pytest
from lexiloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in plans.ORACLES:
        assert canonical(got) == canonical(duck.sql(plans.ORACLES[name]).df())
