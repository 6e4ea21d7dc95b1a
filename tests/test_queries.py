"""Every query of the engine against its SQL twin."""

import glob
import math
import os

import duckdb
import pytest

from trailmark.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if hasattr(v, "as_tuple") else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(v[i]) for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, result.fetchall())


def test_sketches_are_near_the_exact_counts(spark, sf_dir):
    exact = {r["date"]: r["users"] for r in QUERIES["rolling_active"](spark, sf_dir).collect()}
    near = {r["date"]: r["users"] for r in QUERIES["hll_rolling_active"](spark, sf_dir).collect()}
    assert exact.keys() == near.keys()
    assert all(abs(near[d] - n) <= max(1, 0.03 * n) for d, n in exact.items())
