"""Quantiles by refinement against numpy."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from panelkit.operators import selection
from panelkit.operators.selection import ordered_keys, quantiles

ROWS_TYPE = "g long, h string, x double, y double, z double"


def rows(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        g = int(rng.integers(0, 4))
        out.append((None if g == 3 else g, [None, "a", "b"][rng.integers(3)], float(rng.normal() * 10.0 ** rng.integers(-300, 300)),
                    None if rng.random() < 0.3 else float(rng.integers(-2, 3)), None))
    return out


def expected(data, by, probs):
    groups = {}
    for r in data:
        rec = dict(zip("ghxyz", r, strict=True))
        for c in "xyz":
            if rec[c] is not None:
                groups.setdefault((*[rec[b] for b in by], c), []).append(rec[c])
    return {k: (len(v), np.quantile(v, probs).tolist()) for k, v in groups.items()}


@pytest.mark.parametrize("few", [1_000_000, 3])
@pytest.mark.parametrize("by", [[], ["g", "h"]])
def test_against_numpy(spark, monkeypatch, few, by):
    """Two passes, and three when prefixes hold more than a few values."""
    monkeypatch.setattr(selection, "FEW", few)
    data, probs = rows(), [0.25, 0.5, 0.95]
    df = spark.createDataFrame(data, ROWS_TYPE).repartition(4)
    got = {(*[r[b] for b in by], r["column"]): (r.n, r.q) for r in quantiles(df, ["x", "y", "z"], probs, by=by).collect()}
    want = expected(data, by, probs)
    assert set(got) == set(want)
    for k, (n, q) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], q, rtol=1e-12, atol=0)


def test_ends_ties_and_special_values(spark):
    data = [(1, "a", v, 5.0, None) for v in (-math.inf, -0.0, 0.0, 5e-324, math.inf)]
    df = spark.createDataFrame(data, ROWS_TYPE)
    got = {r["column"]: r.q for r in quantiles(df, ["x", "y"], [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    assert got["x"] == [-math.inf, 0.0, 0.0, 5e-324, math.inf]
    assert got["y"] == [5.0] * 5
    nan = spark.createDataFrame([(1, "a", v, 1.0, None) for v in (1.0, 2.0, math.nan)], ROWS_TYPE)
    q = quantiles(nan, ["x"], [0.0, 0.5, 1.0]).first().q
    assert q[:2] == [1.0, 2.0] and math.isnan(q[2])


def test_no_rows_and_no_values(spark):
    assert quantiles(spark.createDataFrame([], ROWS_TYPE), ["x"], [0.5]).count() == 0
    assert quantiles(spark.createDataFrame([(1, "a", None, None, None)], ROWS_TYPE), ["x"], [0.5], by=["g"]).count() == 0


def test_one_group_holds_almost_all(spark):
    df = spark.range(20_000).selectExpr("IF(id % 50 = 0, id % 7, 99) AS g", "CAST(id % 1000 AS DOUBLE) AS x")
    got = {r.g: (r.n, r.q) for r in quantiles(df, ["x"], [0.5], by=["g"]).collect()}
    assert got[99][0] == 19_600
    for g, (n, q) in got.items():
        v = [i % 1000 for i in range(20_000) if (i % 7 if i % 50 == 0 else 99) == g]
        assert n == len(v) and q == [float(np.quantile(v, 0.5))]


def test_values_stay_where_they_are(spark, capsys):
    """What a pass shuffles is counts: the exchange comes after a partial sum, and nothing explodes the columns."""
    df = spark.range(1000).selectExpr(*[f"CAST(id * {i + 1} AS DOUBLE) AS c{i}" for i in range(40)])
    quantiles(df, df.columns, [0.5]).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "partial_sum" in plan and "Generate" not in plan


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=20))
def test_keys_keep_the_order(xs):
    x = np.array(xs)
    k = ordered_keys(x)
    assert all((x[i] < x[j]) == (k[i] < k[j]) and (x[i] == x[j]) == (k[i] == k[j]) for i in range(len(x)) for j in range(len(x)))


def test_struct_groups(spark):
    df = spark.sql("SELECT window(make_timestamp(2024, 1, 1 + CAST(id % 3 AS INT), 5, 0, 0), '1 day') AS w, CAST(id AS DOUBLE) AS x FROM range(30)")
    got = {r.w.start.day: (r.n, r.q) for r in quantiles(df, ["x"], [0.5], by=["w"]).collect()}
    assert got == {d + 1: (10, [13.5 + d]) for d in range(3)}
