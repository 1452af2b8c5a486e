"""The co-moment matrix against numpy: pairwise nulls, large offsets, many columns, constants and values that are not finite."""

import numpy as np
import pytest

from wardflow.operators import flows as fl
from wardflow.operators.comoments import comoments


def frame(spark, x, parts=4):
    names = [f"c{j}" for j in range(x.shape[1])]
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts), names


def test_many_columns_with_nulls_and_offsets(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 122)) + rng.normal(size=(700, 1)) * rng.normal(size=122)
    x += 10.0 ** rng.integers(0, 9, size=122)
    x[rng.random(x.shape) < 0.1] = np.nan
    df, names = frame(spark, x)
    got = {(r["a"], r["b"]): r for r in comoments(df, names).collect()}
    assert len(got) == 122 * 122
    for i in range(0, 122, 7):
        for j in range(122):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[names[i], names[j]]
            p, q = x[both, i] - x[both, i].mean(), x[both, j] - x[both, j].mean()
            assert r["n"] == both.sum() and r["covariance"] == pytest.approx((p * q).mean(), rel=1e-6, abs=1e-7)
            assert r["correlation"] == pytest.approx((p * q).mean() / np.sqrt((p * p).mean() * (q * q).mean()), abs=1e-9)


def test_constants_gaps_and_odd_values(spark):
    x = np.array([[1e9 + 1, 5, np.nan, 1, 2], [1e9 + 2, 5, np.nan, np.inf, 4], [1e9 + 4, 5, np.nan, 3, np.nan], [np.nan, 5, np.nan, 2, 7], [np.nan, 5, np.nan, 2, 7]])
    df, names = frame(spark, x, 2)
    got = {(r["a"], r["b"]): (r["n"], r["correlation"]) for r in comoments(df, names).collect()}
    assert got["c0", "c0"] == (3, pytest.approx(1, abs=1e-12)) and got["c1", "c0"] == (3, None) and got["c2", "c2"] == (0, None)
    assert got["c0", "c4"] == (2, pytest.approx(1, abs=1e-9)) and got["c0", "c3"][0] == 3 and np.isnan(got["c0", "c3"][1])
    assert comoments(df.limit(0), names).filter("n = 0 AND correlation IS NULL").count() == 25
    label = {r["column"]: r["correlation"] for r in fl.label_correlations(df, ["c0", "c1"], "c4").collect()}
    assert label["c0"] == pytest.approx(1, abs=1e-9) and label["c1"] is None
