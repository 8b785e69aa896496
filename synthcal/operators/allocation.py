"""Grid search for the split of the error budget with the least interval width, per held-out task.

The grid depends on the level and the size of the history only. At a grid point a task's gap interval ends at
gap -/+ z se: as z varies, each end is a line, and what the search needs is the k-th level of the arrangement of these lines at
a few hundred values of z. No row is made per task and point: every partition counts, for all points at once, how many of its
lines lie in each of some bins of the point's bracket; the sums tell the bin of the k-th level, which is the next bracket;
when a bracket holds few lines, these are fetched and the level is exact. Leave-one-out is the usual choice between two
order statistics, and a task's own standard error enters through 2 z(alpha1) s, so each task finds its best point by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthcal.functions.expressions import covers
from synthcal.functions.levels import z
from synthcal.sources.scratch import written

POINT = "i3 int, i1 int, alpha1 double, alpha2 double, alpha3 double, z1 double, z2 double, k_low int, k_high int"


def grid_points(alpha: float, t: int, n_grid: int = 30, eps: float = 1e-4) -> list[tuple]:
    """The feasible splits of the level, as rows of :data:`POINT`.

    alpha3 runs evenly over its range [2 / (t + 1) + eps, alpha - 2 eps], and for each alpha1 over [eps, rest - eps] of the
    rest; alpha2 is what is left. A point is feasible if both ranks exist and no share is below eps.
    """
    if alpha - 2 * eps <= 2 / (t + 1):
        return []
    a3 = np.linspace(2 / (t + 1) + eps, alpha - 2 * eps, n_grid)
    rest = (alpha - a3)[:, None]
    a1 = np.linspace(eps, rest[:, 0] - eps, n_grid, axis=1)
    low, high = np.floor((t + 1) * a3 / 2).astype(int), np.ceil((t + 1) * (1 - a3 / 2)).astype(int)
    feasible = ((low >= 1) & (high <= t))[:, None] & (rest > 2 * eps) & (rest - a1 >= eps)  # also where rounding crosses an end
    return [(int(i), int(j), float(a1[i, j]), float(rest[i, 0] - a1[i, j]), float(a3[i]), z(float(a1[i, j])), z(float(rest[i, 0] - a1[i, j])), int(low[i]), int(high[i])) for i, j in np.argwhere(feasible)]


#: Bins of a bracket in one pass, lines that a bracket may hold when they are fetched, numbers in a worker's matrix.
BINS, FEW, NUMBERS = 64, 64, 2_000_000


def chunks_of(batches: Iterator[pd.DataFrame], points: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """gap and se of so many tasks that a matrix of tasks and points stays bounded."""
    step = max(1, NUMBERS // max(1, points))
    for pdf in batches:
        for i in range(0, len(pdf), step):
            yield pdf["gap"].to_numpy(float)[i : i + step], pdf["gap_se"].to_numpy(float)[i : i + step]


def levels_of(tasks: DataFrame, slope: np.ndarray, k: np.ndarray, passes: int = 200) -> np.ndarray:
    """points x 2: the k-th and the next smallest of gap + slope * se over all tasks, exactly, for each point's slope and k.

    ``tasks`` is a written table with gap and gap_se. Points, brackets and counts are of the grid's size.
    """
    p = len(slope)
    ends = tasks.agg(F.min("gap").alias("a"), F.max("gap").alias("z"), F.max(F.abs("gap_se")).alias("s"), F.count("*").alias("n")).first()
    reach = np.abs(slope) * ends["s"]
    low, high = ends["a"] - reach, np.nextafter(ends["z"] + reach, np.inf)  # a bracket holds low <= value < high
    below, inside, last = np.zeros(p, int), np.full(p, ends["n"]), np.minimum(k + 1, ends["n"])

    def counted(open_points: np.ndarray) -> np.ndarray:
        at, a, b = slope[open_points], low[open_points], high[open_points]

        def run(batches):
            total = np.zeros((len(at), BINS + 1), dtype=np.int64)
            for gap, se in chunks_of(batches, len(at)):
                values = gap[:, None] + at * se[:, None]
                bins = np.where(values < a, BINS, np.where(values < b, bin_of(values, a, b), -1))
                row, column = np.nonzero(bins >= 0)
                total += np.bincount(column * (BINS + 1) + bins[row, column], minlength=total.size).reshape(total.shape)
            i, j = np.nonzero(total)
            yield pd.DataFrame({"i": i, "j": j, "c": total[i, j]})

        found = tasks.select("gap", "gap_se").mapInPandas(run, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()
        out = np.zeros((len(at), BINS + 1), dtype=np.int64)
        out[found["i"], found["j"]] = found["c"]
        return out

    for _ in range(passes):
        wide = np.flatnonzero((inside > FEW) & (np.nextafter(low, np.inf) < high))
        if not len(wide):
            break
        counts = counted(wide)
        upto = counts[:, BINS, None] + np.cumsum(counts[:, :BINS], axis=1)
        first = (upto < k[wide, None]).sum(axis=1)  # the bin of the k-th value, and that of the next one
        final = (upto < last[wide, None]).sum(axis=1)
        a, b = low[wide].copy(), high[wide].copy()
        low[wide], high[wide] = edge(a, b, first), edge(a, b, final + 1)
        i = np.arange(len(wide))
        below[wide] = upto[i, first] - counts[i, first]
        inside[wide] = upto[i, final] - below[wide]

    def fetched(batches):
        for gap, se in chunks_of(batches, p):
            values = gap[:, None] + slope * se[:, None]
            row, column = np.nonzero((values >= low) & (values < high))
            part = pd.DataFrame({"i": column.astype(np.int32), "v": values[row, column]})
            yield part.groupby(["i", "v"], as_index=False).size().rename(columns={"size": "c"})

    found = tasks.select("gap", "gap_se").mapInPandas(fetched, "i int, v double, c long").groupBy("i", "v").agg(F.sum("c").alias("c")).orderBy("i", "v").toPandas()
    out = np.full((p, 2), np.nan)
    for i, part in found.groupby("i"):
        upto = below[i] + np.cumsum(part["c"].to_numpy())
        out[i] = [part["v"].to_numpy()[min(len(upto) - 1, np.searchsorted(upto, r))] for r in (k[i], last[i])]
    return out


def edge(low: np.ndarray, high: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The left end of a bracket's i-th bin."""
    return np.where(i >= BINS, high, np.where(i <= 0, low, low + (high - low) * (i / BINS)))


def bin_of(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bin of each value of a bracket, by its bins' ends themselves: rounding of the division is set right."""
    out = np.clip(((values - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
    out -= values < edge(low, high, out)
    return out + (values >= edge(low, high, out + 1))


def best_points(tasks: DataFrame, grid: np.ndarray, lows: np.ndarray, highs: np.ndarray, kind: str) -> DataFrame:
    """task_id, alpha1, alpha2, alpha3, z1, delta_lo, delta_hi at each task's point of least width, the first of equal ones.

    Without a line at or below the k-th level the next one takes its place.
    """
    z1, z2 = grid[:, 5], grid[:, 6]
    step = max(1, NUMBERS // len(grid))

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), step):
                pdf = whole.iloc[i : i + step]
                gap, se, own = (pdf[c].to_numpy(float)[:, None] for c in ("gap", "gap_se", "synth_se"))
                low = np.where(gap - z2 * se <= lows[:, 0], lows[:, 1], lows[:, 0])
                high = np.where(gap + z2 * se <= highs[:, 0], highs[:, 1], highs[:, 0])
                best = np.argmin(2 * z1 * own + (high - low), axis=1)
                at = np.arange(len(pdf))
                columns = {f"alpha{j}": grid[best, 1 + j] for j in (1, 2, 3)}
                yield pd.DataFrame({"task_id": pdf["task_id"].to_numpy(), **columns, "z1": z1[best], "delta_lo": low[at, best], "delta_hi": high[at, best]})

    return tasks.select("task_id", "gap", "gap_se", "synth_se").mapInPandas(run, f"task_id {kind}, alpha1 double, alpha2 double, alpha3 double, z1 double, delta_lo double, delta_hi double")


def grid_intervals(tasks: DataFrame, alpha: float, n_grid: int = 30, eps: float = 1e-4, runs: int = 1, clip: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Leave-one-out intervals at each task's best split; no rows if no split is feasible.

    ``tasks``: task_id, n, theta, synth, synth_se, gap, gap_se. The grid (at most n_grid^2 points) is made from parameters
    and the number of tasks.
    """
    tasks = written(tasks, "grid-tasks")
    t = tasks.count() - 1
    kind = tasks.schema["task_id"].dataType.simpleString()
    points = grid_points(alpha, t, n_grid, eps)
    if points:
        grid = np.array(points, dtype=float)
        lows, highs = levels_of(tasks, -grid[:, 6], grid[:, 7].astype(int)), levels_of(tasks, grid[:, 6], grid[:, 8].astype(int))
        best = best_points(tasks, grid, lows, highs, kind)
    else:
        best = tasks.sparkSession.createDataFrame([], f"task_id {kind}, alpha1 double, alpha2 double, alpha3 double, z1 double, delta_lo double, delta_hi double")
    rows = tasks.join(best, "task_id").withColumn("t_hist", F.lit(t).cast("long"))
    raw_lo, raw_hi = F.col("synth") - F.col("z1") * F.col("synth_se") + F.col("delta_lo"), F.col("synth") + F.col("z1") * F.col("synth_se") + F.col("delta_hi")
    naive_lo, naive_hi = F.col("synth") - z(alpha) * F.col("synth_se"), F.col("synth") + z(alpha) * F.col("synth_se")
    rows = rows.withColumns({"ci_lo": F.greatest(F.lit(clip[0]), raw_lo), "ci_hi": F.least(F.lit(clip[1]), raw_hi), "naive_lo": F.greatest(F.lit(clip[0]), naive_lo), "naive_hi": F.least(F.lit(clip[1]), naive_hi)})
    return rows.select(
        "task_id", F.lit(alpha).alias("alpha"), "n", (F.col("n") * runs).alias("n_calls"), "t_hist", "theta", "synth", "alpha1", "alpha2", "alpha3", "ci_lo", "ci_hi", (F.col("ci_hi") - F.col("ci_lo")).alias("width"), covers(F.col("ci_lo"), F.col("ci_hi"), F.col("theta")).alias("covered"),
        (2 * F.col("z1") * F.col("synth_se")).alias("w_synth"), (F.col("delta_hi") - F.col("delta_lo")).alias("w_band"), "naive_lo", "naive_hi", covers(F.col("naive_lo"), F.col("naive_hi"), F.col("theta")).alias("naive_covered"),
    )


def agreement(records: DataFrame) -> DataFrame:
    """Coverage, k/n text, mean and median length, correlation and mean absolute gap; size range."""
    hits = F.sum(F.col("covered").cast("int"))
    return records.groupBy("alpha").agg(F.avg(F.col("covered").cast("double")).alias("coverage"), F.concat_ws("/", hits, F.count("*")).alias("covered_of"), F.avg("width").alias("mean_length"), F.percentile("width", 0.5).alias("median_length"), F.count("*").alias("n_tasks"), F.corr("theta", "synth").alias("corr_real_synth"), F.avg(F.abs(F.col("theta") - F.col("synth"))).alias("mean_abs_gap"), F.min("n").alias("n_least"), F.percentile("n", 0.5).alias("n_median"), F.max("n").alias("n_largest"))
