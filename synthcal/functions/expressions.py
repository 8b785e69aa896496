"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """False for null, NaN and either infinity."""
    return F.coalesce((F.abs(x) < INF) & ~F.isnan(x), F.lit(False))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded if finite, without negative zero; infinities stay."""
    return F.when(finite(x), F.round(x, digits) + F.lit(0.0)).otherwise(x)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def width(lo: Column, hi: Column) -> Column:
    return F.when(finite(lo) & finite(hi), hi - lo).otherwise(F.lit(INF))


def clipped_width(lo: Column, hi: Column, clip: tuple[float, float] | None) -> Column:
    """Null if infinite; negative where the interval lies outside the range."""
    inside = hi - lo if clip is None else F.least(F.lit(clip[1]), hi) - F.greatest(F.lit(clip[0]), lo)
    return F.when(finite(lo) & finite(hi), inside)


def clip_value(x: Column, clip: tuple[float, float]) -> Column:
    return F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), x))


def covers(lo: Column, hi: Column, theta: Column, infinite: bool = False) -> Column:
    """Whether the interval holds theta. ``infinite``: what an interval with an infinite end counts as."""
    inside = (lo <= theta) & (theta <= hi)
    return F.coalesce(inside if infinite else inside & finite(lo) & finite(hi), F.lit(False))


def close_to(x: Column, value: float) -> Column:
    """Equality within 1e-8 + 1e-5 |value|."""
    return F.abs(x - F.lit(float(value))) <= 1e-8 + 1e-5 * abs(value)


def level_tag(alpha: Column) -> Column:
    """Two-decimal level as three digits: 0.1 is 010."""
    return F.lpad(F.round(alpha * 100).cast("int").cast("string"), 3, "0")


def has_prefix(label: Column, prefixes: list[str], fold_case: bool = True) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (F.lower(label) if fold_case else label).startswith(p)
    return out


def group_of(label: Column) -> Column:
    return F.split(label, " / ")[0]


def date_in_name(name: Column) -> Column:
    """A date written in a name: 20YYMMDD first, else -AABB before a non-digit or the end."""
    # fixed values: the two patterns and the years and days they stand for
    long = F.regexp_extract(name, r"(20\d{2})(\d{2})(\d{2})", 0)
    pair = F.regexp_extract(name, r"-(\d{2})(\d{2})(?:\D|$)", 1)
    last = F.regexp_extract(name, r"-(\d{2})(\d{2})(?:\D|$)", 2)
    a, b = pair.try_cast("int"), last.try_cast("int")
    return (
        F.when(long != "", F.concat_ws("-", F.substring(long, 1, 4), F.substring(long, 5, 2), F.substring(long, 7, 2)))
        .when((a >= 1) & (a <= 12) & (b >= 1) & (b <= 31), F.concat(F.lit("2026-"), pair, F.lit("-"), last))
        .when(a >= 24, F.concat(F.lit("20"), pair, F.lit("-"), last, F.lit("-15")))
    )
