"""Every query against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest

from quiremill.plans import catalog
from quiremill.plans.inputs import TABLES


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".") if math.isfinite(v) else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, oracle, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in catalog.ORACLE_SQL:
        r = oracle.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


#: A profile's few dozen labels are matched by containment: that dimension is broadcast, and nothing else is looped over.
LOOPS = {"profile_match", "geometric_fields", "degradation_ledger", "template_by_designation"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - LOOPS))
def test_no_nested_loops(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    physical = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan
    inputs = physical.count("CROSS JOIN")
    assert inputs == 0
    # literal VALUES tables of the derived inputs meet a table by a loop over two to twelve rows
    loops = physical.count("BroadcastNestedLoopJoin BuildRight, Cross") + physical.count("BroadcastNestedLoopJoin BuildLeft, Cross")
    assert physical.count("BroadcastNestedLoopJoin") == loops
    assert "CartesianProduct" not in physical
