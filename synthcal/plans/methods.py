"""Intervals for a current task's target from synthetic data, corrected by what historical tasks teach.

``alg1``: synthetic interval plus a band of gap-interval endpoints. ``alg2``: the same with the gap level divided by the
size of the history. ``alg3``: synthetic point plus order statistics of the observed gaps at the full level.
``synth_only``: the synthetic interval alone.

The intervals that the methods start from are plugged in: ``mean_interval`` and ``gap_interval`` name builders of
:mod:`synthcal.operators.moments`, or are builders themselves.

Inputs are per-task statistics (theta, synth, synth_se, gap, gap_se, n_real, n_synth, task_id, optional label), with a
column ``role`` (calib / predict) for a split history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthcal.functions.expressions import clipped_width, covers, finite, width
from synthcal.functions.levels import ALLOCATIONS, FIXED_SPLITS, checked
from synthcal.operators.conformal import history_bands, loo_bands
from synthcal.operators.moments import GAP_INTERVALS, MEAN_INTERVALS
from synthcal.sources.scratch import written

RECORD = ["task_id", "label", "theta", "algo", "alpha", "alpha1", "alpha2", "alpha3", "alloc", "n_real", "n_synth", "ci_lo", "ci_hi", "covered", "width", "width_clip", "synth_lo", "synth_hi", "delta_lo", "delta_hi", "w1", "w2", "w3"]
Builder = Callable[[float, tuple[float, float] | None], tuple[Column, Column]]
#: Splits a level for a history of t tasks: (t, alpha) -> three levels.
Allocation = Callable[[int, float], tuple[float, float, float]]
METHODS = ("alg1", "alg2", "alg3", "synth_only")


def history_sizes(tasks: DataFrame, mode: str, by: list[str]) -> dict[tuple, int]:
    """Set -> size of its history. One row per set comes to the driver: sets are configurations, not data."""
    rows = tasks.where("role = 'calib'") if mode == "split" else tasks
    found = {tuple(r[b] for b in by): r["n"] for r in rows.groupBy(*by).agg(F.count("*").alias("n")).collect()}
    return {k: n - (mode == "loo") for k, n in found.items()}


def chosen(keys: list[str], values: dict[tuple, float]) -> Column:
    """A column with the number that belongs to the row's keys (methods, sets and levels: a few configurations)."""
    if len(set(values.values())) == 1:
        return F.lit(float(next(iter(values.values()))))
    out = F.lit(None).cast("double")
    for key, v in values.items():
        same = F.lit(True)
        for b, k in zip(keys, key, strict=True):
            same = same & F.col(b).eqNullSafe(F.lit(k))
        out = F.when(same, F.lit(float(v))).otherwise(out)
    return out


def ends(builder: Builder, level: Column, levels: set[float], bounds: tuple[float, float] | None) -> tuple[Column, Column]:
    """The builder's interval at the row's level, one of ``levels``."""
    low = high = F.lit(None).cast("double")
    for a in sorted(levels):
        lo, hi = builder(a, bounds)
        low, high = (lo, hi) if len(levels) == 1 else (F.when(level == a, lo).otherwise(low), F.when(level == a, hi).otherwise(high))
    return low, high


def run(
    tasks: DataFrame,
    algo: str | list[str],
    alpha: float | list[float],
    alloc: str | Allocation = "prop_127",
    mode: str = "split",
    by: list[str] = (),
    clip: tuple[float, float] | None = None,
    infinite_covers: bool = False,
    mean_interval: str | Builder = "normal",
    gap_interval: str | Builder = "normal",
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Interval records of all predict tasks (split) or of all tasks (loo), one band or one shift per set in ``by``.

    Several methods and levels run in one plan: each task occurs once for each, and they are keys like any other, so the
    rows behind the statistics are read a single time. ``bounds`` is the values' range for builders that need one. ``alloc``
    names a split of the level or is a function that splits it; records show its name.
    """
    by, alphas = list(by), list(alpha) if isinstance(alpha, (list, tuple)) else [alpha]
    algos = list(algo) if isinstance(algo, (list, tuple)) else [algo]
    for name in algos:
        if name not in METHODS:
            raise ValueError(f"unknown method {name!r}")
    for a in alphas:
        if not 0 < a < 1:
            raise ValueError(f"level must lie in (0, 1): {a}")
    mean_of = MEAN_INTERVALS[mean_interval] if isinstance(mean_interval, str) else mean_interval
    gap_of = GAP_INTERVALS[gap_interval] if isinstance(gap_interval, str) else gap_interval
    if "label" not in tasks.columns:
        tasks = tasks.withColumn("label", F.col("task_id"))
    split, alloc = (ALLOCATIONS[alloc], alloc) if isinstance(alloc, str) else (alloc, getattr(alloc, "__name__", "custom"))
    by_size = "alg2" in algos or alloc not in FIXED_SPLITS
    if by_size:
        tasks = written(tasks, "tasks")  # counted first, then used
    sizes = history_sizes(tasks, mode, by) if by_size else {(): 0}
    if by_size and min(sizes.values(), default=1) < 1:
        raise ValueError("a set has no historical task")
    # only with sizes do the numbers depend on the set
    keys, own = ["algo", *by, "alpha"], ["algo", *(by if by_size else []), "alpha"]
    points = {}
    for m in algos:
        for a in alphas:
            for k, n in sizes.items():
                a1, a2, a3 = checked(split(n, a))
                # levels of the mean, of the gap and of the band, then those that the record names
                points[m, *k, a] = {"alg1": (a1, a2, a3, a1, a2, a3), "alg2": (a1, a2 / max(n, 1), a3, a1, a2, a3), "alg3": (a, a, a, 0.0, 0.0, a), "synth_only": (a, a, a, a, 0.0, 0.0)}[m]
    level = [chosen(own, {k: v[i] for k, v in points.items()}) for i in range(6)] if points else [F.lit(0.5)] * 6
    of = lambda i: {v[i] for v in points.values()}
    pairs = F.array(*[F.struct(F.lit(m).alias("algo"), F.lit(float(a)).alias("alpha")) for m in algos for a in alphas])
    rows = tasks.withColumn("_m", F.explode(pairs)).withColumns({"algo": F.col("_m.algo"), "alpha": F.col("_m.alpha")}).drop("_m")
    point, naive = F.col("algo") == "alg3", F.col("algo") == "synth_only"
    (mean_lo, mean_hi), (gap_lo, gap_hi) = ends(mean_of, level[0], of(0), bounds), ends(gap_of, level[1], of(1), bounds)
    swap = lambda c, interval: F.when(point, F.col(c)).otherwise(interval)
    lo, hi = swap("gap", gap_lo), swap("gap", gap_hi)
    if mode == "split":
        rows = history_bands(rows, F.col("role") == "calib", lo, hi, F.col("gap"), level[2], keys).where("role = 'predict'")
    else:
        rows = loo_bands(rows, lo, hi, F.col("gap"), level[2], keys)
    rows = rows.withColumns({c: F.when(naive, F.lit(0.0)).otherwise(F.col(c)) for c in ("delta_lo", "delta_hi", "mid_lo", "mid_hi")})
    rows = rows.withColumns({"synth_lo": swap("synth", mean_lo), "synth_hi": swap("synth", mean_hi), **{f"alpha{i - 2}": level[i] for i in (3, 4, 5)}})
    return scored(rows, alloc, by, clip, infinite_covers)


def scored(rows: DataFrame, alloc: str, by: list[str], clip: tuple[float, float] | None, infinite_covers: bool = False) -> DataFrame:
    """Interval, coverage, widths and the three parts of the width."""
    rows = rows.withColumns({"ci_lo": F.col("synth_lo") + F.col("delta_lo"), "ci_hi": F.col("synth_hi") + F.col("delta_hi")})
    lo, hi = F.col("ci_lo"), F.col("ci_hi")
    bounded = finite(F.col("delta_lo")) & finite(F.col("delta_hi"))
    spread = F.col("mid_hi") - F.col("mid_lo")
    rows = rows.withColumns(
        {
            "covered": covers(lo, hi, F.col("theta"), infinite_covers),
            "width": width(lo, hi),
            "width_clip": clipped_width(lo, hi, clip),
            "w1": F.col("synth_hi") - F.col("synth_lo"),
            "w3": F.when(bounded, spread),
            "w2": F.when(bounded, F.when(F.col("algo").isin("alg3", "synth_only"), F.lit(0.0)).otherwise(F.col("delta_hi") - F.col("delta_lo") - spread)),
            "alloc": F.lit(alloc),
        }
    )
    return rows.select(*by, *RECORD)


def run_all(tasks: DataFrame, alphas: list[float], algos: tuple[str, ...] = METHODS, **kw) -> DataFrame:
    """All methods at all levels in one table and one plan."""
    return run(tasks, list(algos), alphas, **kw)
