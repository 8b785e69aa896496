import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from synthcal.functions import levels
from synthcal.operators.allocation import grid_points


def test_normal_quantile():
    assert levels.z(0.05) == pytest.approx(1.959963984540054)
    for bad in (0, 1, -0.1):
        with pytest.raises(ValueError):
            levels.z(bad)


@pytest.mark.parametrize("t, a3, low, high", [(19, 0.1, 1, 19), (18, 0.1, 0, 19), (99, 0.7 * 0.2, 6, 93), (99, 0.15 - 0.01, 6, 93), (1, 0.1, 0, 2)])
def test_ranks_in_double_precision(spark, t, a3, low, high):
    from pyspark.sql import functions as F

    got = spark.range(1).select(levels.rank_low(F.lit(t), a3), levels.rank_high(F.lit(t), a3)).first()
    assert got[0] == math.floor((t + 1) * a3 / 2.0) == low
    assert got[1] == math.ceil((t + 1) * (1.0 - a3 / 2.0))
    assert (got[1] > t) == (high > t)


def test_allocations():
    assert levels.split_absolute(10, 0.1) == (0.005, 0.005, 0.1 - 0.01)
    assert sum(levels.split_proportional(10, 0.2)) == pytest.approx(0.2)
    a1, a2, a3 = levels.split_floored(10, 0.2)
    assert a3 > 2 / 11 and a2 == pytest.approx(2 * a1)
    with pytest.raises(ValueError):
        levels.split_floored(3, 0.1)
    assert sum(levels.split_bonferroni(0, 0.2)) == pytest.approx(0.1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.floats(0.05, 0.95), st.sampled_from([0.01, 0.05, 0.1, 0.2]))
def test_binomial_ranks(n, q, alpha):
    mass = [math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(n + 1)]
    low, high = levels.binomial_ranks(n, q, alpha)
    below = lambda k: sum(mass[:k])  # noqa: E731  P(B <= k - 1)
    above = lambda k: sum(mass[k:])
    assert low == 0 or below(low) <= alpha / 2 + 1e-9
    assert low >= n or below(low + 1) > alpha / 2 - 1e-9
    assert high == n + 1 or above(high) <= alpha / 2 + 1e-9
    assert high == 0 or above(high - 1) > alpha / 2 - 1e-9


def test_grid_points_are_feasible():
    assert grid_points(0.05, 10) == []
    for i3, i1, a1, a2, a3, _, _, low, high in grid_points(0.2, 40, 6):
        assert a1 + a2 + a3 == pytest.approx(0.2) and low >= 1 and high <= 40 and min(a1, a2, a3) > 0
    assert len(grid_points(0.2, 40, 6)) >= 24


def test_binomial_ranks_of_large_samples():
    for n in (10**6, 10**8):
        low, high = levels.binomial_ranks(n, 0.5, 0.05)
        half = levels.z(0.05) * math.sqrt(n / 4)
        assert abs(n / 2 - half - low) < 3 and abs(n / 2 + half - high) < 3
