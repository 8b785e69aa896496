"""Order statistics across tasks.

A band needs the k-th smallest lower and upper gap endpoint, ranked separately. With a history of its own (split) there is
one band per set. In leave-one-out every task is left out of its own history, yet one pass serves all: without a value v,
the k-th smallest is x(k+1) if v is at most x(k) and x(k) otherwise, ties included. So a few order statistics per set are
enough and nothing is joined task by task.

No set is put in order in one task, whatever its size: rows are partitioned by ranges of set and value, sorted within each
partition and written with their partition and place; the partitions' counts give the offset of each set's rows in a
partition, and so any rank's partition and place. Only these counts, at most one per set and partition, are ever in one window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthcal.functions.expressions import INF
from synthcal.functions.levels import rank_high, rank_low
from synthcal.sources.scratch import written

#: Rows of a partition are numbered by the low bits of Spark's increasing row id, partitions by the high ones.
_ROW_BITS = 33


def put_in_order(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The rows with ``_part`` and ``_row``: ordered by these two, the sets in ``by`` are contiguous and each is in order.

    Written to the shared folder, since the places of a range partitioning hold for one run of it only.
    """
    keys = [F.asc(b) for b in by] + [F.asc(c) if isinstance(c, str) else c for c in order]
    keys = keys or [F.lit(0)]
    row = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", row.alias("_row"))
    return written(placed.select(*rows.columns, F.shiftright("_row", _ROW_BITS).alias("_part"), F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row")), "in-order")


def set_offsets(ordered: DataFrame, by: list[str], *extra: Column) -> DataFrame:
    """by, _part, _first (its first row there), _n, _before (the set's rows in earlier partitions), _total and ``extra`` aggregates."""
    counts = ordered.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), *extra)
    whole = Window.partitionBy(*([F.col(b) for b in by] or [F.lit(0)]))
    return counts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"), "_total": F.sum("_n").over(whole)})


def same_keys(left: dict[str, str], null_safe: bool = True) -> Column:
    """Equality of columns by name, nulls being equal."""
    each = [F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in left.items()]
    return reduce(lambda x, y: x & y, each, F.lit(True))


def with_ranks(rows: DataFrame, order: list[Column | str], by: list[str] = (), name: str = "rank") -> DataFrame:
    """The rows with their place from 1 within their set, like a row number, without putting a set in one task."""
    by = list(by)
    ordered = put_in_order(rows, by, order)
    offsets = written(set_offsets(ordered, by).select(*(F.col(b).alias(f"_o_{b}") for b in by), F.col("_part").alias("_o_part"), (F.col("_before") - F.col("_first") + 1).alias("_shift")), "offsets")
    joined = ordered.join(offsets, (F.col("_part") == F.col("_o_part")) & same_keys({b: f"_o_{b}" for b in by}))
    return joined.select(*rows.columns, (F.col("_row") + F.col("_shift")).alias(name))


ENDS = (("lo", "low", "delta_lo"), ("hi", "high", "delta_hi"), ("mid", "low", "mid_lo"), ("mid", "high", "mid_hi"))


def set_statistics(values: DataFrame, by: list[str], left_out: bool) -> DataFrame:
    """by, t_hist and, per end of the band, the order statistics of its rank and of the next one (null beyond the set).

    ``values``: by, _lo, _hi, _mid, _a3 (the same within a set), a written table. One row per set, written.
    """
    long = values.select(*by, "_a3", F.explode(F.array(*(F.struct(F.lit(v).alias("what"), F.col(f"_{v}").alias("v")) for v in ("lo", "hi", "mid")))).alias("_x")).select(*by, "_a3", "_x.what", "_x.v")
    ordered = put_in_order(long, [*by, "what"], ["v"])
    at = set_offsets(ordered, [*by, "what"], F.max("_a3").alias("_a3")).withColumn("_t", F.col("_total") - int(left_out))
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(v).alias("of"), ((rank_low if k == "low" else rank_high)(F.col("_t"), F.col("_a3")) + more).alias("k"), F.lit(more).alias("more")) for v, k, name in ENDS for more in (0, 1)))
    wanted = at.withColumn("_w", F.explode(ranks)).where((F.col("_w.of") == F.col("what")) & (F.col("_w.k") > F.col("_before")) & (F.col("_w.k") <= F.col("_before") + F.col("_n")))
    wanted = wanted.select(F.col("_part").alias("_at_part"), (F.col("_first") + F.col("_w.k") - F.col("_before") - 1).alias("_at_row"), "_w.name", "_w.more")
    met = ordered.join(wanted, (F.col("_part") == F.col("_at_part")) & (F.col("_row") == F.col("_at_row")))
    picked = met.groupBy(*by).agg(*(F.max(F.when((F.col("name") == n) & (F.col("more") == m), F.col("v"))).alias(f"{n}_{m}") for _, _, n in ENDS for m in (0, 1)))
    sizes = at.where("what = 'mid'").groupBy(*by).agg(F.max("_t").alias("t_hist"), F.max("_a3").alias("_s_a3"))
    named = picked.select(*(F.col(b).alias(f"_p_{b}") for b in by), *(c for c in picked.columns if c not in by))
    return written(sizes.join(named, same_keys({b: f"_p_{b}" for b in by}), "left").drop(*(f"_p_{b}" for b in by)), "set-statistics")


def _written_values(tasks: DataFrame, lo: Column, hi: Column, mid: Column, alpha3: float | Column) -> DataFrame:
    """The tasks with _lo, _hi, _mid and _a3, written: a value that is computed twice may differ in its last bit from itself."""
    level = alpha3 if isinstance(alpha3, Column) else F.lit(float(alpha3))
    return written(tasks.withColumns({"_lo": lo, "_hi": hi, "_mid": mid, "_a3": level}), "band-values")


def _banded(rows: DataFrame, stats: DataFrame, by: list[str], left_out: bool) -> DataFrame:
    named = stats.select(*(F.col(b).alias(f"_s_{b}") for b in by), *(c for c in stats.columns if c not in by))
    joined = rows.join(named, same_keys({b: f"_s_{b}" for b in by}), "left").withColumn("t_hist", F.coalesce("t_hist", F.lit(0)).cast("long"))
    low, high = rank_low(F.col("t_hist"), F.col("_s_a3")) >= 1, rank_high(F.col("t_hist"), F.col("_s_a3")) <= F.col("t_hist")
    out = {}
    for v, k, name in ENDS:
        here = F.col(f"{name}_0")
        value = F.when(F.col(f"_{v}").isNull() | (F.col(f"_{v}") <= here), F.col(f"{name}_1")).otherwise(here) if left_out else here
        out[name] = F.when(low if k == "low" else high, value).otherwise(F.lit(-INF if k == "low" else INF))
    keep = [c for c in rows.columns if c not in ("_lo", "_hi", "_mid", "_a3")]
    return joined.select(*keep, "t_hist", *(v.alias(k) for k, v in out.items()))


def split_bands(history: DataFrame, lo: Column, hi: Column, mid: Column, alpha3: float | Column, by: list[str] = ()) -> DataFrame:
    """by, t_hist, delta_lo, delta_hi, mid_lo, mid_hi: one row per set."""
    by = list(by)
    values = _written_values(history, lo, hi, mid, alpha3).select(*by, "_lo", "_hi", "_mid", "_a3")
    stats = set_statistics(values, by, False)
    ends = {"lo": -INF, "hi": INF}
    return stats.select(*by, "t_hist", *(F.coalesce(f"{n}_0", F.lit(ends[n[-2:]])).alias(n) for _, _, n in ENDS))


def history_bands(tasks: DataFrame, is_history: Column, lo: Column, hi: Column, mid: Column, alpha3: float | Column, by: list[str] = ()) -> DataFrame:
    """All tasks with t_hist, delta_lo, delta_hi, mid_lo, mid_hi of the historical tasks of their set."""
    by = list(by)
    rows = _written_values(tasks.withColumn("_h", is_history), lo, hi, mid, alpha3)
    return _banded(rows.drop("_h"), set_statistics(rows.where("_h"), by, False), by, False)


def loo_bands(tasks: DataFrame, lo: Column, hi: Column, mid: Column, alpha3: float | Column, by: list[str] = ()) -> DataFrame:
    """The tasks with t_hist, delta_lo, delta_hi, mid_lo, mid_hi of the history without themselves."""
    by = list(by)
    rows = _written_values(tasks, lo, hi, mid, alpha3)
    return _banded(rows, set_statistics(rows, by, True), by, True)


def select_ranks(rows: DataFrame, value: str, wanted: DataFrame | list[int] | Callable[[DataFrame], DataFrame], by: list[str], splitters: int = 2_000) -> DataFrame:
    """by, k, value: the exact k-th smallest values for the ranks that ``wanted`` (by, k: few ranks a set, or one list for all
    sets, or a function that finds them from the sets' sizes, by and n) asks for.

    A sketch of every set (approximate quantiles, one pass) brackets each rank between two values. A second pass counts the
    rows below each bracket and the rows of each value inside it, with partial sums before the shuffle, so only a few
    splitters' share of a set's different values is ever put in order, however skewed the values or the sets are.
    Nulls and NaN are left out; infinities are values like others.
    """
    v = F.col(value).cast("double")
    rows = rows.select(*by, v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    keys = by or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", [i / splitters for i in range(splitters + 1)], 5 * splitters).alias("s"), F.min("v").alias("a"), F.max("v").alias("z"))
    if callable(wanted):  # the sizes come from the sketch: the rows are read no further time
        sketch = written(sketch, "sketches")
        wanted = wanted(sketch.select(*by, "n"))
    at = (F.col("k") - 1) / F.col("n") * splitters
    low, high = F.floor(at).cast("int") - 2, F.ceil(at + splitters / F.col("n")).cast("int") + 2
    if isinstance(wanted, list):
        asked = sketch.withColumn("k", F.explode(F.array(*[F.lit(int(k)).cast("long") for k in wanted])))
    else:
        wanted = wanted.select(*by, F.col("k").cast("long").alias("k"), *([] if by else [F.lit(0).alias("_all")]))
        asked = sketch.join(wanted, keys)
    marks = asked.where((F.col("k") >= 1) & (F.col("k") <= F.col("n")))
    marks = marks.select(*keys, F.struct("k", F.when(low < 0, F.col("a")).otherwise(F.col("s")[low]).alias("a"), F.when(high > splitters, F.col("z")).otherwise(F.col("s")[high]).alias("z")).alias("m"))
    marks = written(marks.groupBy(*keys).agg(F.collect_list("m").alias("m")), "rank-brackets")
    met = rows.join(marks, keys).select(*keys, "v", F.explode(F.filter("m", lambda m: F.col("v") <= m["z"])).alias("m"))
    counts = met.groupBy(*keys, F.col("m.k").alias("k"), F.when(F.col("v") >= F.col("m.a"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("k")) & (F.col("_upto") - F.col("c") < F.col("k")))
    return found.select(*by, "k", F.col("v").alias("value"))


def global_order_stats(rows: DataFrame, value: str, ranks: list[int], by: list[str] = (), splitters: int = 2_000) -> DataFrame:
    """by, k, value: the same ranks of every set, sets too large to be ordered in one task included."""
    return select_ranks(rows, value, list(ranks), list(by), splitters)
