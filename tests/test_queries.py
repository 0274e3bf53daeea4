"""Every query with SQL against DuckDB on the smallest tables; every other one runs and has a stable schema."""

import decimal
import glob
import os

import duckdb
import pytest

from mapweave import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="the graded tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    d = catalogue.queries()[name](spark, SF)
    r = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(d.columns) == sorted(names)
    assert rows(d.columns, [tuple(x) for x in d.collect()]) == rows(names, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_bucketed_joins_have_no_nested_loops(spark):
    from mapweave.operators import spatial
    from mapweave.plans.registry import vectors

    v = vectors(spark, SF)
    plan = spatial.radius_join(v, v, 0.05)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scans_read_only_what_is_needed(spark):
    plan = catalogue.queries()["gap_sessions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]


def test_pose_graph_covers_every_point(spark):
    from mapweave.plans.registry import vectors

    got = catalogue.queries()["pose_graph"](spark, SF).select("label", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vectors(spark, SF).select("label", "id").collect()))


def test_hole_fill_keeps_the_known_cells_of_all_points(spark, duck):
    from mapweave.plans.registry import PTS
    from mapweave.plans.space_queries import _HEIGHT

    assert PTS in _HEIGHT and "%" not in _HEIGHT.replace(PTS, "")
    want = {(x, y): round(h, 6) for x, y, h in duck.execute(f"SELECT * FROM {_HEIGHT}").fetchall()}
    got = catalogue.queries()["hole_fill"](spark, SF).collect()
    assert {(r["cx"], r["cy"]): round(r["height"], 6) for r in got if r["measured"]} == want
    assert any(not r["measured"] for r in got) and len({(r["cx"], r["cy"]) for r in got}) == len(got)
