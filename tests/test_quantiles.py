import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from grainmill.plans.quantiles import approximate_quantiles, exact_quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _check(spark, columns, direct_values=1_000_000):
    pdf = pd.DataFrame(columns)
    df = spark.createDataFrame(pdf)
    found = exact_quantiles(df, {c: SHARES for c in pdf.columns}, direct_values)
    for c in pdf.columns:
        expected = list(pdf[c].dropna().quantile(SHARES))
        assert found[c] == pytest.approx(expected, rel=1e-12, abs=1e-12), c


def _columns():
    rng = np.random.default_rng(3)
    n = 3000
    return {
        "normal": rng.normal(size=n),
        "wide": rng.lognormal(0, 20, n) * rng.choice([-1, 1], n),
        "close": 1.0 + rng.integers(0, 1000, n) * 1e-13,
        "few": rng.integers(0, 5, n).astype(float),
        "constant": np.full(n, 7.5),
        "tiny": rng.integers(1, 50, n) * 5e-324,
    }


def test_matches_pandas(spark):
    _check(spark, _columns())


def test_refining_gives_the_same(spark):
    _check(spark, _columns(), direct_values=5)


def test_one_value_holds_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    hot = np.concatenate([np.full(1000, 3.0), rng.uniform(2.9, 3.1, 2000)])
    _check(spark, {"hot": hot}, direct_values=10)


def test_missing_and_empty(spark):
    df = spark.createDataFrame(
        [(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "a double, b double"
    )
    found = exact_quantiles(df, {"a": [0.5], "b": [0.5]})
    assert found == {"a": [2.0], "b": [None]}
    assert exact_quantiles(df.where("false"), {"a": [0.25, 0.5]}) == {"a": [None, None]}
    assert exact_quantiles(df, {}) == {}


def test_infinite_values(spark):
    df = spark.createDataFrame(
        [(-math.inf,), (1.0,), (2.0,), (3.0,), (math.inf,)], "a double"
    )
    assert exact_quantiles(df, {"a": [0.25, 0.5, 0.75]})["a"] == [1.0, 2.0, 3.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_subnormal=False), min_size=1, max_size=60))
def test_any_list(spark, values):
    _check(spark, {"x": values}, direct_values=3)


def test_approximate(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as x")
    assert approximate_quantiles(df, {"x": [0.5]})["x"][0] == pytest.approx(500, abs=2)
