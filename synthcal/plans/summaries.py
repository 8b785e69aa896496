"""Coverage and width tables over interval records, and the selections and comparisons made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthcal.functions.expressions import finite, group_of
from synthcal.operators.conformal import select_ranks, with_ranks
from synthcal.sources.scratch import written


def finite_mean(c: str) -> Column:
    return F.avg(F.when(finite(F.col(c)), F.col(c)))


def summary(records: DataFrame, by: tuple[str, ...] = ("algo", "alpha")) -> DataFrame:
    """n, coverage in percent and means over finite values, per method and level."""
    hit = F.when(F.coalesce(F.col("covered"), F.lit(False)), 1.0).otherwise(0.0)
    return records.groupBy(*by).agg(F.count("*").alias("n_tasks"), (F.avg(hit) * 100).alias("coverage_pct"), finite_mean("width").alias("mean_width"), finite_mean("width_clip").alias("mean_width_clip"), *(finite_mean(w).alias(w) for w in ("w1", "w2", "w3")))


def panel_summary(records: DataFrame, baseline: DataFrame, by: tuple[str, ...] = ("alpha",)) -> DataFrame:
    """Coverage, median widths over finite ones, and the baseline's coverage."""
    median = lambda c: F.percentile(F.when(finite(F.col(c)), F.col(c)), 0.5)
    own = records.groupBy(*by).agg(F.count("*").alias("n"), (F.avg(F.col("covered").cast("double")) * 100).alias("coverage_pct"), median("width").alias("median_width"), median("width_clip").alias("median_width_clip"))
    base = baseline.groupBy(*by).agg((F.avg(F.col("covered").cast("double")) * 100).alias("baseline_coverage_pct"))
    return own.join(base, list(by), "left")


def pooled(records: DataFrame, by: tuple[str, ...] = ("algo", "alpha")) -> DataFrame:
    """Means over many replications and each part's share of the width in percent."""
    out = records.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("covered").cast("double")).alias("coverage"), finite_mean("width_clip").alias("mean_width_clip"), *(finite_mean(w).alias(f"_{w}") for w in ("w1", "w2", "w3")))
    total = F.col("_w1") + F.col("_w2") + F.col("_w3")
    return out.select(*by, "n", "coverage", "mean_width_clip", *(F.when(total > 0, 100 * F.col(f"_{w}") / total).alias(f"share_{w}") for w in ("w1", "w2", "w3")))


def size_stats(tasks: DataFrame) -> DataFrame:
    """Least, median (cut to an integer), upper median and largest task size."""
    sizes = tasks.select(F.explode(F.array(*(F.struct(F.lit(c).alias("size"), F.col(c).alias("n")) for c in ("n_real", "n_synth")))).alias("s")).select("s.*")
    sizes = written(sizes, "sizes")
    upper = select_ranks(sizes, "n", lambda found: found.select("size", (F.floor(F.col("n") / 2) + 1).alias("k")), ["size"])
    out = sizes.groupBy("size").agg(F.min("n").alias("least"), F.floor(F.percentile("n", 0.5)).alias("median"), F.max("n").alias("largest"))
    return out.join(upper, "size").select("size", "least", "median", F.col("value").cast("long").alias("upper_median"), "largest")


def profile(tasks: DataFrame) -> DataFrame:
    """Numbers of predict and historical tasks, rows, and the historical tasks' names in order."""
    calib = F.col("role") == "calib"
    return tasks.agg(F.count(F.when(~calib, 1)).alias("t_tasks"), F.count(F.when(calib, 1)).alias("t_hist"), F.sum("n_real").alias("n_rows"), F.array_join(F.array_sort(F.collect_list(F.when(calib, F.col("task_id")))), ",").alias("background"))


def borderline(records: DataFrame, k: int, without: list[str] = ()) -> DataFrame:
    """The k tasks whose target lies nearest an end of the interval, in the order of the target."""
    rows = records.where(~group_of(F.col("label")).isin(list(without))) if without else records
    margin = F.least(F.col("theta") - F.col("ci_lo"), F.col("ci_hi") - F.col("theta"))
    return rows.withColumn("margin", margin).orderBy("margin", "task_id").limit(k).orderBy("theta", "task_id")


def select_spread(records: DataFrame, n: int, total: int) -> DataFrame:
    """n rows at even places of the order by theta. ``total`` is the number of rows."""
    if n >= total:
        return records
    places = sorted({round(i * (total - 1) / (n - 1)) if n > 1 else 0 for i in range(n)})  # half to even
    placed = with_ranks(records, ["theta", "task_id"], name="_place")
    return placed.where((F.col("_place") - 1).isin(places)).drop("_place")


def select_random(records: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn by hash of the task, the same for every partitioning."""
    return records.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "task_id")), "task_id").limit(n)


def ordered(records: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The rows of a result table with their place in the order of the keys, from 1."""
    return with_ranks(records, keys, name="place")


def with_baseline(records: DataFrame, baseline: DataFrame) -> DataFrame:
    """Primary intervals and, where there is one, the baseline's of the same task."""
    base = baseline.select("task_id", F.col("ci_lo").alias("base_lo"), F.col("ci_hi").alias("base_hi"), F.col("covered").alias("base_covered"))
    return records.select("task_id", "theta", "ci_lo", "ci_hi", "covered").join(base, "task_id", "left")


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tasks that both methods have."""
    return first.select("task_id", F.col("width").alias("width_a"), F.col("covered").alias("covered_a")).join(second.select("task_id", F.col("width").alias("width_b"), F.col("covered").alias("covered_b")), "task_id")


def manifest(records: DataFrame, by: tuple[str, ...] = ("algo", "alpha", "alloc")) -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("covered").cast("double")) * 100, 1).alias("coverage_pct"), F.round(finite_mean("width_clip"), 4).alias("mean_width_clip"))


def differences(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("algo", "alpha", "alloc")) -> DataFrame:
    """Keys of two manifests that differ in any figure or that one of them lacks."""
    figures = ("n", "coverage_pct", "mean_width_clip")
    left = a.select(*by, F.struct(*figures).alias("old"))
    right = b.select(*by, F.struct(*figures).alias("new"))
    return left.join(right, list(by), "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def report(table: DataFrame) -> DataFrame:
    """The summary as readable text: whole percents, three decimals, a dash for what is missing."""
    shown = lambda c, d: F.when(finite(F.col(c)), F.format_string(f"%.{d}f", F.round(c, d))).otherwise(F.lit("—"))
    return table.select("algo", F.format_string("%.2f", F.col("alpha")).alias("alpha"), F.col("n_tasks").cast("string").alias("n"), F.concat(F.format_string("%.0f", F.round("coverage_pct")), F.lit("%")).alias("coverage"), *(shown(c, 3).alias(c) for c in ("mean_width", "mean_width_clip", "w1", "w2", "w3")))
