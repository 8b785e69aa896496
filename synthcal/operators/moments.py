"""Per-task moments and closed-form intervals. Every one is a grouped aggregation with partial sums before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthcal.functions.levels import binomial_ranks, z
from synthcal.operators.conformal import select_ranks
from synthcal.sources.scratch import written


def sd(x: Column) -> Column:
    """Sample standard deviation, 0 for a single row."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def paired_stats(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rows with either value or a key missing are left out, so pairs stay aligned."""
    rows = pairs.na.drop(subset=[*by, x, y])
    d = F.col(x) - F.col(y)
    n = F.count("*")
    return rows.groupBy(*by).agg(
        n.alias("n_real"), n.alias("n_synth"), F.avg(x).alias("theta"), F.avg(y).alias("synth"), (sd(F.col(y)) / F.sqrt(n)).alias("synth_se"), F.avg(d).alias("gap"), (sd(d) / F.sqrt(n)).alias("gap_se"), (sd(F.col(x)) / F.sqrt(n)).alias("theta_se")
    )


def counted_stats(counts: DataFrame, by: list[str], x: str, y: str, n: str) -> DataFrame:
    """The same from distinct pairs with counts, a written table of theirs: squares are taken around the means."""
    rows = counts.na.drop(subset=[*by, x, y])
    d, times = F.col(x) - F.col(y), lambda v: F.sum(F.col(n) * v)
    means = rows.groupBy(*by).agg(F.sum(n).alias("n_real"), (times(F.col(x)) / F.sum(n)).alias("theta"), (times(F.col(y)) / F.sum(n)).alias("synth"), (times(d) / F.sum(n)).alias("gap"))
    around = rows.join(means, by).groupBy(*by).agg(times((F.col(x) - F.col("theta")) ** 2).alias("vx"), times((F.col(y) - F.col("synth")) ** 2).alias("vy"), times((d - F.col("gap")) ** 2).alias("vd"))
    se = lambda v: F.when(F.col("n_real") > 1, F.sqrt(F.col(v) / (F.col("n_real") - 1) / F.col("n_real"))).otherwise(F.lit(0.0))
    return means.join(around, by).select(*by, "n_real", F.col("n_real").alias("n_synth"), "theta", "synth", se("vy").alias("synth_se"), "gap", se("vd").alias("gap_se"), se("vx").alias("theta_se"))


def unpaired_stats(rows: DataFrame, by: list[str], value: str, is_real: Column) -> DataFrame:
    """Real and synthetic rows in one long table: conditional aggregates, one shuffle. Tasks with one side only are left out."""
    rows = rows.na.drop(subset=[*by, value])
    real, synth = F.when(is_real, F.col(value)), F.when(~is_real, F.col(value))
    out = rows.groupBy(*by).agg(F.count(real).alias("n_real"), F.count(synth).alias("n_synth"), F.avg(real).alias("theta"), F.avg(synth).alias("synth"), sd(real).alias("sx"), sd(synth).alias("sy"))
    out = out.where("n_real > 0 and n_synth > 0")
    return out.select(*by, "n_real", "n_synth", "theta", "synth", (F.col("sy") / F.sqrt("n_synth")).alias("synth_se"), (F.col("theta") - F.col("synth")).alias("gap"), F.sqrt(F.col("sx") ** 2 / F.col("n_real") + F.col("sy") ** 2 / F.col("n_synth")).alias("gap_se"))


def weighted_cells(rows: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """n, weighted means and design-based standard errors, in one reading of the rows.

    Each partition reduces its rows to one state per cell: weights, and for each of y and x - y the weighted sum, and the sums of
    squared weights times deviations and squared deviations, from a pilot value of its own, the mean of the cell's first rows
    there. Pilots lie as near to the mean as the values do, so shifting the states to the cell's mean cancels nothing, however
    far from zero the values are. States are one row per cell and partition; only these are grouped and joined.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    rows = rows.na.drop(subset=[*by, x, y, w]).select(*by, *(F.col(c).cast("double").alias(f"_{k}") for k, c in (("x", x), ("y", y), ("w", w))))
    names = ["n", "sw", "sw2", *(f"{k}_{v}" for v in ("d", "y") for k in ("pilot", "s1", "w2s1", "w2s2"))]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, np.ndarray] = {}
        kept = None
        for batch in batches:
            table = pa.table({k: batch.column(i) for i, k in enumerate(by)})
            kept = table.schema
            code, cells = coded_rows(table)
            xs, ys, ws = (batch.column(len(by) + i).to_numpy(zero_copy_only=False) for i in range(3))
            k = len(cells)
            n, sw, sw2 = np.bincount(code, minlength=k), np.bincount(code, ws, k), np.bincount(code, ws**2, k)
            part = [n, sw, sw2]
            for v in (xs - ys, ys):
                pilot = np.array([states[c][len(part)] if c in states else np.nan for c in cells])
                pilot = np.where(np.isnan(pilot), np.bincount(code, v, k) / np.maximum(n, 1), pilot)
                off = v - pilot[code]
                part += [pilot, np.bincount(code, ws * off, k), np.bincount(code, ws**2 * off, k), np.bincount(code, ws**2 * off**2, k)]
            for c, state in zip(cells, np.stack(part, axis=1).astype(float), strict=True):
                if c in states:
                    pilots = states[c][[3, 7]]
                    states[c] += state
                    states[c][[3, 7]] = pilots
                else:
                    states[c] = state
        if states:
            keys = [pa.array(c, kept.field(i).type) for i, c in enumerate(zip(*states, strict=True))]
            values = np.stack(list(states.values()))
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(values[:, i]) for i in range(values.shape[1]))], names=[*by, *names])

    states = written(rows.mapInArrow(reduced, f"{kinds}, " + ", ".join(f"{c} double" for c in names)), "cell-states")
    mean = lambda v: F.sum(F.col("sw") * F.col(f"pilot_{v}") + F.col(f"s1_{v}")) / F.sum("sw")
    means = states.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), mean("d").alias("gap"), mean("y").alias("synth"), F.sum("sw").alias("_sw"), (F.sum("sw") * F.sum("sw") / F.sum("sw2")).alias("n_eff"))
    means = written(means, "cell-means")
    shift = {v: F.col(m) - F.col(f"pilot_{v}") for v, m in (("d", "gap"), ("y", "synth"))}
    square = {v: F.sum(F.col(f"w2s2_{v}") - 2 * shift[v] * F.col(f"w2s1_{v}") + shift[v] * shift[v] * F.col("sw2")) for v in ("d", "y")}
    spread = states.drop("n").join(means.select(*by, "gap", "synth"), by).groupBy(*by).agg(square["d"].alias("vd"), square["y"].alias("vy"))
    se = lambda v: F.sqrt(F.greatest(F.col(v), F.lit(0.0))) / F.col("_sw")
    return means.join(spread, by).select(*by, "n", (F.col("gap") + F.col("synth")).alias("theta"), "gap", se("vd").alias("gap_se"), "synth", se("vy").alias("synth_se"), "n_eff")


def coded_rows(keys: pa.Table) -> tuple[np.ndarray, list[tuple]]:
    """A number per row for its combination of keys, and the combinations."""
    code = np.zeros(keys.num_rows, dtype=np.int64)
    for column in keys.columns:
        encoded = column.combine_chunks().dictionary_encode()
        code = code * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, list(zip(*(c.to_pylist() for c in keys.take(pa.array(first)).columns), strict=True))


def normal_interval(middle: Column, se: Column, alpha: float) -> tuple[Column, Column]:
    return middle - z(alpha) * se, middle + z(alpha) * se


def hoeffding_mean(mean: Column, n: Column, alpha: float, bounds: tuple[float, float]) -> tuple[Column, Column]:
    half = (bounds[1] - bounds[0]) * F.sqrt(F.lit(math.log(2 / alpha)) / (2 * n))
    return mean - half, mean + half


def hoeffding_gap(gap: Column, n: Column, m: Column, alpha: float, bounds: tuple[float, float]) -> tuple[Column, Column]:
    half = F.sqrt(2 * (bounds[1] - bounds[0]) ** 2 * (1 / n + 1 / m) / 4 * math.log(2 / alpha))
    return gap - half, gap + half


#: Interval builders over the columns of the statistics above: (level, bounds) -> (lower, upper). More can be registered;
#: ``columns`` takes intervals that a grouped function (the bootstrap, quantiles) has put into the table.
MEAN_INTERVALS = {
    "normal": lambda alpha, bounds: normal_interval(F.col("synth"), F.col("synth_se"), alpha),
    "hoeffding": lambda alpha, bounds: hoeffding_mean(F.col("synth"), F.col("n_synth"), alpha, bounds),
    "columns": lambda alpha, bounds: (F.col("mean_ci_lo"), F.col("mean_ci_hi")),
}
GAP_INTERVALS = {
    "normal": lambda alpha, bounds: normal_interval(F.col("gap"), F.col("gap_se"), alpha),
    "hoeffding": lambda alpha, bounds: hoeffding_gap(F.col("gap"), F.col("n_real"), F.col("n_synth"), alpha, bounds),
    "columns": lambda alpha, bounds: (F.col("gap_ci_lo"), F.col("gap_ci_hi")),
}


def quantile_interval(rows: DataFrame, by: list[str], value: str, q: float, alpha: float) -> DataFrame:
    """Exact distribution-free interval for a quantile from two order statistics of each task.

    The ranks depend on the row count only and are computed once per distinct count, where those counts are; no task's rows
    are put in order, and the rows are read twice (see :func:`select_ranks`).
    """
    rows = rows.na.drop(subset=[*by, value]).where(~F.isnan(F.col(value).cast("double")))
    asked: list[DataFrame] = []

    def ranks(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(n, *binomial_ranks(int(n), q, alpha)) for n in pdf["m"]], columns=["m", "low", "high"])

    def wanted(sizes: DataFrame) -> DataFrame:
        table = sizes.select(F.col("n").alias("m")).distinct().mapInPandas(ranks, "m long, low long, high long")
        asked.append(written(sizes.join(table, F.col("n") == F.col("m")).drop("m"), "quantile-ranks"))
        return asked[0].select(*by, F.explode(F.array("low", "high")).alias("k"))

    found = select_ranks(rows, value, wanted, by)
    found = asked[0].join(found, by, "left")
    pick = lambda k: F.max(F.when(F.col("k") == F.col(k), F.col("value")))
    return found.groupBy(*by, "n", "low", "high").agg(F.coalesce(pick("low"), F.lit(float("-inf"))).alias("ci_lo"), F.coalesce(pick("high"), F.lit(float("inf"))).alias("ci_hi"))
