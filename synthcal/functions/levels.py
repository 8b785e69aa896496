"""Numbers that come from parameters, never from data rows: normal quantiles, budget splits, order-statistic ranks."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the customary Elo scale.
ELO_SCALE = 400.0 / math.log(10.0)


def z(alpha: float) -> float:
    """Upper alpha/2 point of the standard normal."""
    if not 0 < alpha < 1:
        raise ValueError(f"level must lie in (0, 1): {alpha}")
    return NormalDist().inv_cdf(1 - alpha / 2)


# The shares of the budget splits (absolute 0.005 and 0.005; 0.1, 0.2, 0.7; 0.05, 0.10, 0.85; floor 1e-6).


def split_absolute(t: int, alpha: float) -> tuple[float, float, float]:
    return 0.005, 0.005, alpha - 0.01


def split_proportional(t: int, alpha: float) -> tuple[float, float, float]:
    return 0.1 * alpha, 0.2 * alpha, 0.7 * alpha


def split_floored(t: int, alpha: float) -> tuple[float, float, float]:
    """Proportional, but the third share stays just above 2 / (t + 1) so that both ranks exist."""
    least = 2.0 / (t + 1)
    third = 0.7 * alpha if 0.7 * alpha > least else least + 1e-6
    rest = alpha - third
    if rest <= 0:
        raise ValueError(f"no budget is left for {t} historical tasks at level {alpha}")
    return rest / 3.0, 2.0 * rest / 3.0, third


def split_bonferroni(t: int, alpha: float, dimensions: int = 2, shares: tuple[float, float, float] = (0.05, 0.10, 0.85)) -> tuple[float, float, float]:
    """The budget of one of several coordinates."""
    each = alpha / dimensions
    return each * shares[0], each * shares[1], each * shares[2]


ALLOCATIONS = {"abs_005_005": split_absolute, "prop_127": split_proportional, "floored_127": split_floored, "bonf_split": split_bonferroni}
#: Splits that don't depend on the size of the history.
FIXED_SPLITS = ("abs_005_005", "prop_127", "bonf_split")


def checked(levels: tuple[float, float, float]) -> tuple[float, float, float]:
    for name, a in zip(("alpha1", "alpha2", "alpha3"), levels, strict=True):
        if not 0 < a < 1:
            raise ValueError(f"{name} must lie in (0, 1): {a}")
    return levels


def rank_low(t: Column, alpha3: Column | float) -> Column:
    """floor((t + 1) alpha3 / 2), in double precision and in this order of operations."""
    return F.floor((t + 1) * _col(alpha3) / 2.0)


def rank_high(t: Column, alpha3: Column | float) -> Column:
    return F.ceil((t + 1) * (1.0 - _col(alpha3) / 2.0))


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def binomial_ranks(n: int, q: float, alpha: float) -> tuple[int, int]:
    """Ranks (low, high) of the exact quantile interval: low is the largest with P(B < low) <= alpha/2, high the smallest
    with P(B >= high) <= alpha/2, for B binomial(n, q). Low may be 0 and high n + 1 (then that end is infinite)."""
    if not 0 < q < 1:
        raise ValueError(f"q must lie in (0, 1): {q}")
    # beyond 40 standard deviations nothing is left that a double could hold
    far = 40 * math.sqrt(n * q * (1 - q)) + 40
    first, last = max(0, math.floor(n * q - far)), min(n, math.ceil(n * q + far))
    mass = lambda k: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(q) + (n - k) * math.log1p(-q))
    low, below = first, 0.0
    while low < n and below + mass(low) <= alpha / 2:
        below += mass(low)
        low += 1
    high, above = last + 1, 0.0
    while high > 0 and above + mass(high - 1) <= alpha / 2:
        above += mass(high - 1)
        high -= 1
    return low, high
