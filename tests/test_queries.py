"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import duckdb
import pytest

from spectrafold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    rel = db.execute(registry.ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_query_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() or name == "gammachirp_bank"  # a signal there is shorter than a kernel
