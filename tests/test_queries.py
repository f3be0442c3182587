"""Every registered scene query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from scenetables.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in rows) == sorted(repr(tuple(r)) for r in cur.fetchall())


def test_no_python_in_joins_and_windows(spark):
    for name in ("points_in_boxes", "hold_track", "object_match", "pinhole_zbuffer", "depth_splat_gaussian", "line_raster"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian")), name
