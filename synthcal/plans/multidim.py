"""Two-dimensional targets: a rectangle of weighted intervals for the own and the opposite party's cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthcal.functions.expressions import clip_value, covers, finite
from synthcal.functions.levels import split_bonferroni, z
from synthcal.operators.conformal import history_bands, loo_bands

STATS = ("theta", "gap", "gap_se", "synth", "synth_se", "n")
DIMENSIONS = 2


def pair_cells(cells: DataFrame, task_keys: list[str], role: Column, min_n: int = 100) -> DataFrame:
    """One row per task and coordinate for tasks whose two cells exist and have ``min_n`` rows.

    ``role`` gives co, opp or null. Two cells of one task and role are an input error.
    """
    rows = cells.withColumn("coord", role).where("coord is not null")
    task = Window.partitionBy(*task_keys)
    seats = {f"_{c}": F.count(F.when(F.col("coord") == c, 1)).over(task) for c in ("co", "opp")}
    rows = rows.withColumns({**seats, "_least": F.min("n").over(task)})
    twice = (F.col("_co") > 1) | (F.col("_opp") > 1)
    fits = (F.col("_co") == 1) & (F.col("_opp") == 1) & (F.col("_least") >= min_n)
    rows = rows.where(F.when(twice, F.raise_error(F.lit("a cell occurs twice")).cast("boolean")).otherwise(fits))
    return rows.select(F.concat_ws("|", *task_keys).alias("task_id"), *task_keys, "coord", *STATS)


def rectangles(tasks: DataFrame, alpha: float, mode: str = "loo", role: Column | None = None, by: list[str] = (), clip: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Long records (two per task): each coordinate's interval at alpha / 2, clipped before it is scored, and joint coverage.

    The naive interval also uses alpha / 2; it is clipped in leave-one-out and not in split mode.
    """
    by = list(by)
    keys = [*by, "coord"]
    a1, a2, a3 = split_bonferroni(0, alpha, DIMENSIONS)
    lo, hi = F.col("gap") - z(a2) * F.col("gap_se"), F.col("gap") + z(a2) * F.col("gap_se")
    if mode == "loo":
        rows = loo_bands(tasks, lo, hi, F.col("gap"), a3, keys)
    else:
        rows = tasks.withColumn("role", role)
        rows = history_bands(rows, F.col("role") == "calib", lo, hi, F.col("gap"), a3, keys).where("role = 'predict'")
    raw_lo = F.col("synth") - z(a1) * F.col("synth_se") + F.col("delta_lo")
    raw_hi = F.col("synth") + z(a1) * F.col("synth_se") + F.col("delta_hi")
    naive_lo, naive_hi = (F.col("synth") + s * z(alpha / DIMENSIONS) * F.col("synth_se") for s in (-1, 1))
    inside = (lambda x: clip_value(x, clip)) if mode == "loo" else (lambda x: x)
    rows = rows.withColumns(
        {
            "feasible": finite(raw_lo) & finite(raw_hi),
            # clipped at one side each: an interval beyond the range keeps its negative width
            "ci_lo": F.greatest(F.lit(clip[0]), raw_lo),
            "ci_hi": F.least(F.lit(clip[1]), raw_hi),
            "naive_lo": F.greatest(F.lit(clip[0]), naive_lo) if mode == "loo" else inside(naive_lo),
            "naive_hi": F.least(F.lit(clip[1]), naive_hi) if mode == "loo" else inside(naive_hi),
            "alpha": F.lit(alpha),
        }
    )
    rows = rows.withColumns({"covered": covers(F.col("ci_lo"), F.col("ci_hi"), F.col("theta"), True), "naive_covered": covers(F.col("naive_lo"), F.col("naive_hi"), F.col("theta"), True), "width": F.col("ci_hi") - F.col("ci_lo"), "naive_width": F.col("naive_hi") - F.col("naive_lo")})
    both = Window.partitionBy(*by, "task_id")
    rows = rows.withColumns({"joint_covered": F.bool_and("covered").over(both), "naive_joint": F.bool_and("naive_covered").over(both), "task_feasible": F.bool_and("feasible").over(both)})
    return rows.select(*by, "task_id", "coord", "alpha", "n", "theta", "ci_lo", "ci_hi", "width", "feasible", "covered", "joint_covered", "naive_lo", "naive_hi", "naive_width", "naive_covered", "naive_joint", "task_feasible", "t_hist")


def rectangle_summary(records: DataFrame, by: list[str] = ("alpha",)) -> DataFrame:
    """Per level: tasks, feasible share, joint and per-coordinate coverage, mean width over feasible tasks, naive coverage."""
    one = lambda c: F.avg(F.col(c).cast("double"))
    of = lambda k: F.avg(F.when(F.col("coord") == k, F.col("covered").cast("double")))
    return records.groupBy(*by).agg(F.countDistinct("task_id").alias("t"), one("task_feasible").alias("feasible"), one("joint_covered").alias("joint_coverage"), of("co").alias("coverage_co"), of("opp").alias("coverage_opp"), F.avg(F.when(F.col("task_feasible"), F.col("width"))).alias("mean_width"), one("naive_joint").alias("naive_joint_coverage"))
