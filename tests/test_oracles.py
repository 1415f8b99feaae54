"""Every core query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from ledgerlens.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v:
        return None
    if isinstance(v, float) and not isinstance(v, bool):
        return 0.0 if round(v, 6) == 0 else float(f"{v:.6f}") if not math.isinf(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    return v


def cells(frame, columns):
    return sorted(([plain(v) for v in row] for row in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got, sorted(got.columns)) == cells(want, sorted(got.columns))


@pytest.mark.parametrize("name", ["m2_isolation_forest", "c3_review_artifact"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
