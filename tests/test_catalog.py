"""Every registered query against its SQL on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from kinetrail.functions.windows import bounds, scale
from kinetrail.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def number(v):
    return isinstance(v, float) or type(v).__name__ == "Decimal"


def rows(names, found):
    """Rows with their columns by name, in the order of what is exact in them, then of their numbers."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if number(v) else v
    out = [[tidy(r[i]) for i in order] for r in found]
    return sorted(out, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]))


def alike(a, b):
    """Equal, floats within 1e-9; one unit of the last digit where both were rounded to four."""
    if isinstance(a, float) and isinstance(b, float):
        near = abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
        return near or a == round(a, 4) and b == round(b, 4) and abs(a - b) < 1.01e-4
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    found, asked = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(found) == len(asked)
    for a, b in zip(found, asked):
        assert len(a) == len(b) and all(map(alike, a, b)), (a, b)


def test_scale():
    assert [scale(15, 25), scale(15, 15), scale(75, 15), scale(1, 1)] == [12, 8, 38, 1]
    assert bounds(4, "centred") == (-2, 1)


def test_every_pair_is_correlated(spark):
    """All directed pairs of sequences."""
    got = QUERIES["pair_speed_correlation"](spark, SF).collect()
    assert len({(r["agent"], r["target"]) for r in got}) == 56 and all(r["agent"] != r["target"] for r in got)
