"""Registered queries of the interval library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synthcal.functions import expressions as ex
from synthcal.functions.levels import ALLOCATIONS, ELO_SCALE, split_bonferroni, z
from synthcal.operators import allocation, bootstrap, conformal, deident, moments
from synthcal.operators import bradley_terry as bt
from synthcal.plans import inputs, methods, multidim, summaries
from synthcal.plans import sql as q
from synthcal.sources import io
from synthcal.sources.scratch import fresh, written

ALPHA, ALPHAS = 0.1, [0.1, 0.15, 0.2]
UNIT = (0.0, 0.1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine's sums."""
    return df.select(*(ex.rounded(F.col(c), digits).alias(c) if t == "double" and c not in ("alpha", "alpha1", "alpha2", "alpha3") else F.col(c) for c, t in df.dtypes))


def rounds(names: str, digits: int = 6) -> str:
    return ", ".join(f"{q.r(n, digits)} AS {n}" for n in names.split())


# --- moments and closed-form intervals


@query(f"WITH {q.TASKS} SELECT task_id, n_real, n_synth, {rounds('theta synth synth_se gap gap_se theta_se')} FROM tasks")
def paired_task_stats(spark, sf):
    return shown(inputs.paired_tasks(spark, sf))


Z10 = q.d(z(ALPHA))


@query(f"WITH {q.TASKS} SELECT task_id, {q.r(f'synth - {Z10} * synth_se')} AS mean_lo, {q.r(f'synth + {Z10} * synth_se')} AS mean_hi, {q.r(f'gap - {Z10} * gap_se')} AS gap_lo, {q.r(f'gap + {Z10} * gap_se')} AS gap_hi FROM tasks")
def wald_intervals(spark, sf):
    (a, b), (c, e) = moments.normal_interval(F.col("synth"), F.col("synth_se"), ALPHA), moments.normal_interval(F.col("gap"), F.col("gap_se"), ALPHA)
    return shown(inputs.paired_tasks(spark, sf).select("task_id", a.alias("mean_lo"), b.alias("mean_hi"), c.alias("gap_lo"), e.alias("gap_hi")))


@query(f"""WITH {q.PAIRS}, s AS (SELECT task_id, count(*) FILTER (WHERE l_linestatus = 'F') AS n_real, count(*) FILTER (WHERE l_linestatus <> 'F') AS n_synth, avg(price) FILTER (WHERE l_linestatus = 'F') AS theta,
  avg(price) FILTER (WHERE l_linestatus <> 'F') AS synth, coalesce(stddev_samp(price) FILTER (WHERE l_linestatus = 'F'), 0) AS sx, coalesce(stddev_samp(price) FILTER (WHERE l_linestatus <> 'F'), 0) AS sy FROM pairs GROUP BY task_id),
  t AS (SELECT *, theta - synth AS gap, sqrt(sx * sx / n_real + sy * sy / n_synth) AS se FROM s WHERE n_real > 0 AND n_synth > 0)
  SELECT task_id, n_real, n_synth, {q.r('gap - ' + Z10 + ' * se', 4)} AS gap_lo, {q.r('gap + ' + Z10 + ' * se', 4)} AS gap_hi FROM t""")
def unpaired_gap_intervals(spark, sf):
    t = moments.unpaired_stats(inputs.pairs(spark, sf), ["task_id"], "price", F.col("l_linestatus") == "F")
    lo, hi = moments.GAP_INTERVALS["normal"](ALPHA, None)
    return shown(t.select("task_id", "n_real", "n_synth", lo.alias("gap_lo"), hi.alias("gap_hi")), 4)


HALF = "0.1::DOUBLE * sqrt(ln(20.0::DOUBLE) / (2 * n_synth))"
HALF2 = "sqrt(2 * (0.1::DOUBLE * 0.1::DOUBLE) * (1.0::DOUBLE / n_real + 1.0::DOUBLE / n_synth) / 4 * ln(20.0::DOUBLE))"


@query(f"WITH {q.TASKS} SELECT task_id, {q.r(f'synth - {HALF}')} AS mean_lo, {q.r(f'synth + {HALF}')} AS mean_hi, {q.r(f'gap - {HALF2}')} AS gap_lo, {q.r(f'gap + {HALF2}')} AS gap_hi FROM tasks")
def hoeffding_intervals(spark, sf):
    (a, b), (c, e) = moments.hoeffding_mean(F.col("synth"), F.col("n_synth"), ALPHA, UNIT), moments.GAP_INTERVALS["hoeffding"](ALPHA, UNIT)
    return shown(inputs.paired_tasks(spark, sf).select("task_id", a.alias("mean_lo"), b.alias("mean_hi"), c.alias("gap_lo"), e.alias("gap_hi")))


@query(f"""WITH {q.PAIRS}, n AS (SELECT task_id, count(*) AS n FROM pairs GROUP BY task_id), m AS (SELECT DISTINCT n FROM n),
  b AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + n * ln(0.5::DOUBLE)) AS p FROM (SELECT n, unnest(range(0, n + 1)) AS k FROM m)),
  c AS (SELECT n, k, sum(p) OVER (PARTITION BY n ORDER BY k) AS below, sum(p) OVER (PARTITION BY n ORDER BY k DESC) AS above FROM b),
  l AS (SELECT n, coalesce(max(k + 1) FILTER (WHERE below <= 0.05::DOUBLE), 0) AS low, coalesce(min(k) FILTER (WHERE above <= 0.05::DOUBLE), n + 1) AS high FROM c GROUP BY n),
  r AS (SELECT task_id, price, row_number() OVER (PARTITION BY task_id ORDER BY price) AS i FROM pairs)
  SELECT task_id, n, low::BIGINT AS low, high::BIGINT AS high, coalesce(max(price) FILTER (WHERE i = low), '-infinity'::DOUBLE) AS ci_lo, coalesce(max(price) FILTER (WHERE i = high), 'infinity'::DOUBLE) AS ci_hi
  FROM r JOIN n USING (task_id) JOIN l USING (n) GROUP BY task_id, n, low, high""")
def quantile_intervals(spark, sf):
    return moments.quantile_interval(inputs.pairs(spark, sf), ["task_id"], "price", 0.5, ALPHA)


@query(f"WITH {q.CELLS} SELECT wave, party, region, n, {rounds('theta gap gap_se synth synth_se n_eff')}, {q.r(f'gap - {Z10} * gap_se')} AS gap_lo, {q.r(f'gap + {Z10} * gap_se')} AS gap_hi FROM cells")
def weighted_cell_stats(spark, sf):
    lo, hi = moments.normal_interval(F.col("gap"), F.col("gap_se"), ALPHA)
    return shown(inputs.cells(spark, sf).select("*", lo.alias("gap_lo"), hi.alias("gap_hi")))


@query(f"WITH {q.CELLS} SELECT {q.r('max(n) * 1e-4::DOUBLE')} AS largest, max(n) * 1e-4::DOUBLE <= 1e-9::DOUBLE AS within FROM cells")
def cell_parity(spark, sf):
    """Cells against cells whose synthetic mean is off by a ten-thousandth of their size, taken from a written table."""
    stats = ["theta", "gap", "gap_se", "synth", "synth_se", "n"]
    cells = written(inputs.cells(spark, sf), "cells")
    return shown(io.parity(cells, cells.withColumn("synth", F.col("synth") + F.col("n") * 1e-4), inputs.CELL, stats))


@query(f"WITH {q.CELLS} SELECT wave, party, region, n, {rounds('theta gap gap_se synth synth_se n_eff')} FROM cells")
def reduced_cells(spark, sf):
    """Early waves from respondents' rows, later ones as already reduced cells."""
    rows = inputs.cell_rows(spark, sf)
    late = moments.weighted_cells(rows.where("wave >= 1997"), inputs.CELL, "x", "y", "w")
    return shown(io.reduced_cells(rows.where("wave < 1997"), written(late, "late-cells"), inputs.CELL))


# --- methods: split history


def _register_methods() -> None:
    for algo in methods.METHODS:
        zs = f"{q.z_table(ALLOCATIONS['prop_127'](0, ALPHA)[1])}, " if algo == "alg2" else ""

        def split(spark, sf, algo=algo):
            return shown(methods.run(inputs.temporal_tasks(spark, sf), algo, ALPHA, clip=UNIT))

        def loo(spark, sf, algo=algo):
            return shown(methods.run(inputs.paired_tasks(spark, sf), algo, ALPHA, mode="loo", clip=UNIT))

        for f, name, prefix, mode in ((split, f"temporal_{algo}", q.TEMPORAL, "split"), (loo, f"loo_{algo}", q.TASKS, "loo")):
            QUERIES[name] = f
            SQL[name] = q.method(zs + prefix, algo, mode=mode, clip=UNIT)


_register_methods()


def summary_sql(inner: str, by: str = "algo, alpha") -> str:
    mean = lambda c: f"avg({c}) FILTER (WHERE isfinite({c}))"
    return f"SELECT {by}, count(*) AS n_tasks, {q.r('avg(covered::INT::DOUBLE) * 100')} AS coverage_pct, " + ", ".join(f"{q.r(mean(c), 4)} AS {n}" for c, n in (("width", "mean_width"), ("width_clip", "mean_width_clip"), ("w1", "w1"), ("w2", "w2"), ("w3", "w3"))) + f" FROM ({inner}) GROUP BY {by}"


def _rounded_summary(df: DataFrame) -> DataFrame:
    return df.select(*(ex.rounded(F.col(c), 6 if c == "coverage_pct" else 4).alias(c) if t == "double" and c != "alpha" else F.col(c) for c, t in df.dtypes))


@query(summary_sql(q.method(q.TEMPORAL, "alg1", clip=UNIT)))
def temporal_alg1_summary(spark, sf):
    return _rounded_summary(summaries.summary(shown(methods.run(inputs.temporal_tasks(spark, sf), "alg1", ALPHA, clip=UNIT))))


METHOD_UNION = " UNION ALL ".join(f"SELECT * FROM ({q.method((q.z_table(ALLOCATIONS['prop_127'](0, a)[1]) + ', ' if m == 'alg2' else '') + q.TEMPORAL, m, a, clip=UNIT)})" for m in methods.METHODS for a in ALPHAS)
LOO_UNION = " UNION ALL ".join(f"SELECT * FROM ({q.method(q.TASKS, m, a, mode='loo', clip=UNIT)})" for m in ("alg1", "alg3", "synth_only") for a in ALPHAS)


@query(summary_sql(METHOD_UNION))
def temporal_method_table(spark, sf):
    """All methods at several levels stacked and summarised."""
    return _rounded_summary(summaries.summary(shown(methods.run_all(inputs.temporal_tasks(spark, sf), ALPHAS, clip=UNIT))))


@query(summary_sql(LOO_UNION))
def loo_method_table(spark, sf):
    return _rounded_summary(summaries.summary(shown(methods.run_all(inputs.paired_tasks(spark, sf), ALPHAS, ("alg1", "alg3", "synth_only"), mode="loo", clip=UNIT))))


def _fixed_split_sql(alloc: str) -> str:
    return q.method(q.TEMPORAL, "alg1", 0.1, alloc, clip=UNIT)


@query(_fixed_split_sql("abs_005_005"))
def temporal_absolute_split(spark, sf):
    return shown(methods.run(inputs.temporal_tasks(spark, sf), "alg1", 0.1, "abs_005_005", clip=UNIT))


@query(_fixed_split_sql("floored_127"))
def temporal_floored_split(spark, sf):
    """The third share depends on the size of the history."""
    return shown(methods.run(inputs.temporal_tasks(spark, sf), "alg1", 0.1, "floored_127", clip=UNIT))


@query(q.method(q.TASKS, "alg1", 0.2, mode="loo", clip=UNIT, hoeffding=True))
def loo_alg1_hoeffding(spark, sf):
    """Both intervals by Hoeffding's bound instead of the normal one."""
    return shown(methods.run(inputs.paired_tasks(spark, sf), "alg1", 0.2, mode="loo", clip=UNIT, mean_interval="hoeffding", gap_interval="hoeffding", bounds=UNIT))


@query()
def loo_alg1_bootstrap(spark, sf):
    """Both intervals by the bootstrap, each at its own level (random draws; see the tests)."""
    a1, a2, _ = ALLOCATIONS["prop_127"](0, 0.2)
    pairs = inputs.pairs(spark, sf).groupBy("task_id", "x", "y").agg(F.count("*").alias("n"))
    pairs = written(pairs, "pair-values")  # one reading of the raw rows: statistics and replicates follow from the values' counts
    found = bootstrap.bootstrap_intervals(pairs, ["task_id"], "x", "y", {"synth": a1, "paired_gap": a2}, 400, count="n").where("kind = 'percentile'")
    pick = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c)))
    ends = found.groupBy("task_id").agg(pick("synth", "ci_lo").alias("mean_ci_lo"), pick("synth", "ci_hi").alias("mean_ci_hi"), pick("paired_gap", "ci_lo").alias("gap_ci_lo"), pick("paired_gap", "ci_hi").alias("gap_ci_hi"))
    tasks = moments.counted_stats(pairs, ["task_id"], "x", "y", "n").join(ends, "task_id")
    return methods.run(tasks, "alg1", 0.2, mode="loo", clip=UNIT, mean_interval="columns", gap_interval="columns")


def _loo(spark, sf, algo="alg1", **kw):
    return methods.run(inputs.paired_tasks(spark, sf), algo, ALPHA, mode="loo", clip=UNIT, **kw)


def _loo_each(spark, sf, *algos):
    """The records of each method, computed together and written once."""
    rows = written(shown(_loo(spark, sf, list(algos))), "loo-records")
    return [rows.where(F.col("algo") == a) for a in algos]


L1, L3, LS = (q.method(q.TASKS, a, mode="loo", clip=UNIT) for a in ("alg1", "alg3", "synth_only"))


@query(f"""SELECT p.alpha, count(*) AS n, {q.r('avg(p.covered::INT::DOUBLE) * 100')} AS coverage_pct, {q.r("quantile_cont(p.width, 0.5) FILTER (WHERE isfinite(p.width))", 5)} AS median_width,
  {q.r("quantile_cont(p.width_clip, 0.5) FILTER (WHERE isfinite(p.width_clip))", 5)} AS median_width_clip, {q.r('avg(b.covered::INT::DOUBLE) * 100')} AS baseline_coverage_pct
  FROM ({L1}) p JOIN ({LS}) b USING (task_id) GROUP BY p.alpha""")
def loo_panel_summary(spark, sf):
    out = summaries.panel_summary(*_loo_each(spark, sf, "alg1", "synth_only"))
    return out.select(*(ex.rounded(F.col(c), 5 if "width" in c else 6).alias(c) if t == "double" and c != "alpha" else F.col(c) for c, t in out.dtypes))


@query(f"""WITH {q.TASKS}, s AS (SELECT 'n_real' AS size, n_real AS n FROM tasks UNION ALL SELECT 'n_synth', n_synth FROM tasks)
  SELECT size, min(n) AS least, floor(quantile_cont(n, 0.5))::BIGINT AS median, list_sort(list(n))[(count(*) // 2 + 1)::INT] AS upper_median, max(n) AS largest FROM s GROUP BY size""")
def task_size_stats(spark, sf):
    return summaries.size_stats(inputs.paired_tasks(spark, sf))


@query(f"WITH {q.TEMPORAL} SELECT count(*) FILTER (WHERE role <> 'calib') AS t_tasks, count(*) FILTER (WHERE role = 'calib') AS t_hist, sum(n_real)::BIGINT AS n_rows, array_to_string(list_sort(list(task_id) FILTER (WHERE role = 'calib')), ',') AS background FROM tasks")
def task_profile(spark, sf):
    return summaries.profile(inputs.temporal_tasks(spark, sf))


@query(f"SELECT * FROM (SELECT task_id, label, theta, ci_lo, ci_hi, {q.r('least(theta - ci_lo, ci_hi - theta)')} AS margin FROM ({L1}) WHERE string_split(label, ' / ')[1] <> 'Brand#1|PROMO' ORDER BY round(least(theta - ci_lo, ci_hi - theta), 6), task_id LIMIT 20)")
def borderline_tasks(spark, sf):
    rows = summaries.borderline(shown(_loo(spark, sf)).withColumn("margin", F.lit(0)), 20, ["Brand#1|PROMO"])
    return rows.select("task_id", "label", "theta", "ci_lo", "ci_hi", ex.rounded(F.col("margin")).alias("margin"))


@query(f"""WITH o AS (SELECT task_id, theta, row_number() OVER (ORDER BY theta, task_id) - 1 AS i, count(*) OVER () AS t FROM ({L1})),
  p AS (SELECT DISTINCT round_even(k * (t - 1)::DOUBLE / 9, 0) AS i FROM (SELECT any_value(t) AS t FROM o), (SELECT unnest(range(10)) AS k))
  SELECT task_id, theta FROM o JOIN p USING (i)""")
def spread_tasks(spark, sf):
    rows = written(shown(_loo(spark, sf)), "loo-records")
    return summaries.select_spread(rows, 10, rows.count()).select("task_id", "theta")


@query(f"SELECT task_id, theta FROM ({L1}) ORDER BY md5('0:' || task_id), task_id LIMIT 10")
def random_tasks(spark, sf):
    """Ten tasks by hash: the same for every partitioning."""
    return summaries.select_random(shown(_loo(spark, sf)), 10).select("task_id", "theta")


@query(f"SELECT p.task_id, p.theta, p.ci_lo, p.ci_hi, p.covered, b.ci_lo AS base_lo, b.ci_hi AS base_hi, b.covered AS base_covered FROM ({L1}) p LEFT JOIN (SELECT * FROM ({LS}) WHERE task_id LIKE '%ECONOMY') b USING (task_id)")
def intervals_with_baseline(spark, sf):
    rows, base = _loo_each(spark, sf, "alg1", "synth_only")
    return summaries.with_baseline(rows, base.where(F.col("task_id").endswith("ECONOMY")))


@query(f"SELECT a.task_id, a.width AS width_a, a.covered AS covered_a, b.width AS width_b, b.covered AS covered_b FROM ({L1}) a JOIN ({L3}) b USING (task_id)")
def compared_methods(spark, sf):
    return summaries.compared(*_loo_each(spark, sf, "alg1", "alg3"))


@query(f"""SELECT 'n_real' AS what, count(*) AS n FROM ({L1}) WHERE lower(label) LIKE 'brand#1%' OR lower(label) LIKE 'brand#2%' UNION ALL
  SELECT 'cased', count(*) FROM ({L1}) WHERE label LIKE 'brand#1%' UNION ALL
  SELECT 'level', count(*) FROM ({LOO_UNION}) WHERE abs(alpha - 0.15::DOUBLE) <= 1e-8::DOUBLE + 1e-5::DOUBLE * 0.15::DOUBLE""")
def filtered_records(spark, sf):
    """Family prefixes, in any case and cased, and levels matched within rounding."""
    every = written(methods.run_all(inputs.paired_tasks(spark, sf), ALPHAS, ("alg1", "alg3", "synth_only"), mode="loo", clip=UNIT), "loo-records")
    rows = every.where((F.col("algo") == "alg1") & (F.col("alpha") == ALPHA))
    counts = [("n_real", rows.where(ex.has_prefix(F.col("label"), ["brand#1", "brand#2"]))), ("cased", rows.where(ex.has_prefix(F.col("label"), ["brand#1"], False))), ("level", every.where(ex.close_to(F.col("alpha"), 0.15)))]
    out = None
    for name, df in counts:
        part = df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# --- replications and large sets

REPS = f"""{q.PAIRS}, tasks AS (SELECT year(o_orderdate) AS rep, p_brand AS task_id, p_brand AS label, {q.STAT} FROM pairs JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
hist AS (SELECT p.rep || ':' || p.task_id AS held, h.* FROM tasks p JOIN tasks h ON p.rep = h.rep AND p.task_id <> h.task_id)"""
A = ALLOCATIONS["prop_127"](0, ALPHA)
REP_SQL = f"""WITH {REPS}, {q.band(f'gap - {q.d(z(A[1]))} * gap_se', f'gap + {q.d(z(A[1]))} * gap_se', 'gap', q.d(A[2]), 'hist', 'held')},
held AS (SELECT t.*, synth - {q.d(z(A[0]))} * synth_se AS synth_lo, synth + {q.d(z(A[0]))} * synth_se AS synth_hi, delta_lo, delta_hi, mid_lo, mid_hi FROM tasks t JOIN bands ON held = rep || ':' || task_id)
SELECT algo, alpha, count(*) AS n, {q.r('avg(covered::INT::DOUBLE)')} AS coverage, {q.r('avg(width_clip) FILTER (WHERE isfinite(width_clip))', 4)} AS mean_width_clip, {q.r('100 * avg(w1) / (avg(w1) + avg(w2) + avg(w3))', 2)} AS share_w1,
 {q.r('100 * avg(w2) / (avg(w1) + avg(w2) + avg(w3))', 2)} AS share_w2, {q.r('100 * avg(w3) / (avg(w1) + avg(w2) + avg(w3))', 2)} AS share_w3 FROM ({q.record('alg1', ALPHA, A, 'prop_127', 'held', UNIT, True)}) GROUP BY algo, alpha"""


@query(REP_SQL)
def replicated_coverage(spark, sf):
    """Every order year is a replication: all of them in one job, with the replication among the partition keys."""
    orders = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("rep"))
    stats = moments.paired_stats(inputs.pairs(spark, sf).join(orders, "l_orderkey"), ["rep", "p_brand"], "x", "y").withColumnRenamed("p_brand", "task_id")
    out = summaries.pooled(shown(methods.run(stats, "alg1", ALPHA, mode="loo", by=["rep"], clip=UNIT, infinite_covers=True)))
    digits = {"coverage": 6, "mean_width_clip": 4}
    return out.select(*(ex.rounded(F.col(c), digits.get(c, 2)).alias(c) if t == "double" and c != "alpha" else F.col(c) for c, t in out.dtypes))


RANKS = [1, 10, 100, 1000, 5000]


@query(f"SELECT l_linestatus, k::BIGINT AS k, price AS value FROM (SELECT l_linestatus, l_extendedprice AS price, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) AS k FROM lineitem) WHERE k IN ({', '.join(map(str, RANKS))})")
def large_set_order_stats(spark, sf):
    """Order statistics of sets too large for one task's sort."""
    return conformal.global_order_stats(inputs.table(spark, sf, "lineitem"), "l_extendedprice", RANKS, ["l_linestatus"])


# --- two dimensions

ROLE = "CASE party WHEN 'A' THEN 'co' WHEN 'R' THEN 'opp' END"


def _role():
    return F.when(F.col("party") == "A", "co").when(F.col("party") == "R", "opp")


def _pairs2d(spark, sf, min_n=10):
    return multidim.pair_cells(inputs.cells(spark, sf), ["wave", "region"], _role(), min_n)


TWO = f"""{q.CELLS}, roles AS (SELECT *, {ROLE} AS coord, wave || '|' || region AS task_id FROM cells WHERE party IN ('A', 'R')),
tasks AS (SELECT r.* FROM roles r JOIN (SELECT task_id FROM roles GROUP BY task_id HAVING count(*) = 2 AND min(n) >= 10) USING (task_id))"""


@query(f"WITH {TWO} SELECT task_id, wave, region, coord, n, {rounds('theta gap gap_se synth synth_se')} FROM tasks")
def paired_cells(spark, sf):
    return shown(_pairs2d(spark, sf))


def two_sql(alpha: float, mode: str) -> str:
    a1, a2, a3 = split_bonferroni(0, alpha)
    lo, hi = f"gap - {q.d(z(a2))} * gap_se", f"gap + {q.d(z(a2))} * gap_se"
    join = "p.task_id <> h.task_id" if mode == "loo" else "p.wave = 2000 AND h.wave <> 2000"
    clip = (lambda s, e: f"{s}(0.0::DOUBLE, {e})" if s == "greatest" else f"{s}(1.0::DOUBLE, {e})") if mode == "loo" else (lambda s, e: e)
    h = q.d(z(alpha / 2))
    return f"""WITH {TWO}, hist AS (SELECT p.task_id || p.coord AS held, h.* FROM tasks p JOIN tasks h ON p.coord = h.coord AND {join}), {q.band(lo, hi, 'gap', q.d(a3), 'hist', 'held')},
c AS (SELECT t.*, t_hist, greatest(0.0::DOUBLE, synth - {q.d(z(a1))} * synth_se + delta_lo) AS ci_lo, least(1.0::DOUBLE, synth + {q.d(z(a1))} * synth_se + delta_hi) AS ci_hi, isfinite(delta_lo) AND isfinite(delta_hi) AS feasible,
  {clip('greatest', f'synth - {h} * synth_se')} AS naive_lo, {clip('least', f'synth + {h} * synth_se')} AS naive_hi FROM tasks t JOIN bands ON held = task_id || coord),
e AS (SELECT *, ci_lo <= theta AND theta <= ci_hi AS covered, naive_lo <= theta AND theta <= naive_hi AS naive_covered FROM c)
SELECT task_id, coord, {q.d(alpha)} AS alpha, n, {rounds('theta ci_lo ci_hi')}, {q.r('ci_hi - ci_lo')} AS width, feasible, covered, bool_and(covered) OVER w AS joint_covered, {rounds('naive_lo naive_hi')}, {q.r('naive_hi - naive_lo')} AS naive_width, naive_covered,
  bool_and(naive_covered) OVER w AS naive_joint, bool_and(feasible) OVER w AS task_feasible, t_hist FROM e WINDOW w AS (PARTITION BY task_id)"""


@query(two_sql(0.2, "loo"))
def rectangle_loo(spark, sf):
    return shown(multidim.rectangles(_pairs2d(spark, sf), 0.2))


@query(two_sql(0.2, "split"))
def rectangle_temporal(spark, sf):
    return shown(multidim.rectangles(_pairs2d(spark, sf), 0.2, "split", F.when(F.col("wave") == 2000, "predict").otherwise("calib")))


@query(" UNION ALL ".join(f"SELECT alpha, count(DISTINCT task_id) AS t, {q.r('avg(task_feasible::INT::DOUBLE)')} AS feasible, {q.r('avg(joint_covered::INT::DOUBLE)')} AS joint_coverage, {q.r('''avg(covered::INT::DOUBLE) FILTER (WHERE coord = 'co')''')} AS coverage_co, {q.r('''avg(covered::INT::DOUBLE) FILTER (WHERE coord = 'opp')''')} AS coverage_opp, {q.r('avg(width) FILTER (WHERE task_feasible)', 4)} AS mean_width, {q.r('avg(naive_joint::INT::DOUBLE)')} AS naive_joint_coverage FROM ({two_sql(a, 'loo')}) GROUP BY alpha" for a in (0.15, 0.2)))
def rectangle_table(spark, sf):
    tasks = _pairs2d(spark, sf)
    out = multidim.rectangle_summary(shown(multidim.rectangles(tasks, 0.15).unionByName(multidim.rectangles(tasks, 0.2))))
    return out.select(*(ex.rounded(F.col(c), 4 if c == "mean_width" else 6).alias(c) if t == "double" and c != "alpha" else F.col(c) for c, t in out.dtypes))


# --- grid allocation

# The grid follows from the number of cells; normal quantiles come from Newton steps on the distribution's power series.
PHI = "(0.5::DOUBLE + exp(-x * x / 2) / sqrt(2 * pi()) * list_reduce(list_prepend({'t': x, 's': x}, list_transform(range(1, 120), lambda k: {'t': k::DOUBLE, 's': 0.0::DOUBLE})), lambda u, e: {'t': u.t * x * x / (2 * e.t + 1), 's': u.s + u.t * x * x / (2 * e.t + 1)}).s)"
GRID = f"""{q.CELLS}, tasks AS (SELECT wave || '|' || party || '|' || region AS task_id, n, theta, synth, synth_se, gap, gap_se FROM cells),
size AS (SELECT count(*) - 1 AS t FROM tasks), ends AS (SELECT t, 2.0::DOUBLE / (t + 1) + 1e-4::DOUBLE AS first, {q.d(ALPHA)} - 2 * 1e-4::DOUBLE AS last FROM size WHERE {q.d(ALPHA)} - 2 * 1e-4::DOUBLE > 2.0::DOUBLE / (t + 1)),
thirds AS (SELECT t, i3, CASE i3 WHEN 29 THEN last ELSE i3 * ((last - first) / 29) + first END AS alpha3 FROM ends, (SELECT unnest(range(30)) AS i3)),
splits AS (SELECT t, i3, i1, alpha3, {q.d(ALPHA)} - alpha3 AS rest, CASE i1 WHEN 29 THEN {q.d(ALPHA)} - alpha3 - 1e-4::DOUBLE ELSE i1 * (({q.d(ALPHA)} - alpha3 - 1e-4::DOUBLE - 1e-4::DOUBLE) / 29) + 1e-4::DOUBLE END AS alpha1 FROM thirds, (SELECT unnest(range(30)) AS i1)),
feasible AS (SELECT i3, i1, alpha1, rest - alpha1 AS alpha2, alpha3, floor((t + 1) * alpha3 / 2) AS k_low, ceil((t + 1) * (1 - alpha3 / 2)) AS k_high FROM splits WHERE floor((t + 1) * alpha3 / 2) >= 1 AND ceil((t + 1) * (1 - alpha3 / 2)) <= t AND rest > 2 * 1e-4::DOUBLE AND rest - alpha1 >= 1e-4::DOUBLE),
levels(a, x, i) AS (SELECT DISTINCT a, 0.0::DOUBLE, 0 FROM (SELECT alpha1 AS a FROM feasible UNION ALL SELECT alpha2 FROM feasible) UNION ALL SELECT a, x + (1 - a / 2 - {PHI}) * sqrt(2 * pi()) * exp(x * x / 2), i + 1 FROM levels WHERE i < 16),
points AS (SELECT f.*, u.x AS z1, v.x AS z2 FROM feasible f JOIN levels u ON u.a = alpha1 AND u.i = 16 JOIN levels v ON v.a = alpha2 AND v.i = 16),
ranked AS (SELECT i3, i1, k_low, k_high, task_id, gap - z2 * gap_se AS lo, gap + z2 * gap_se AS hi, row_number() OVER (PARTITION BY i3, i1 ORDER BY gap - z2 * gap_se, task_id) AS r_lo,
  row_number() OVER (PARTITION BY i3, i1 ORDER BY gap + z2 * gap_se, task_id) AS r_hi FROM tasks, points),
bands AS (SELECT i3, i1, max(lo) FILTER (WHERE r_lo = k_low) AS lo_0, max(lo) FILTER (WHERE r_lo = k_low + 1) AS lo_1, max(hi) FILTER (WHERE r_hi = k_high) AS hi_0, max(hi) FILTER (WHERE r_hi = k_high + 1) AS hi_1 FROM ranked GROUP BY i3, i1),
tried AS (SELECT r.task_id, i3, i1, CASE WHEN r_lo <= r.k_low THEN lo_1 ELSE lo_0 END AS delta_lo, CASE WHEN r_hi <= r.k_high THEN hi_1 ELSE hi_0 END AS delta_hi FROM ranked r JOIN bands USING (i3, i1)),
best AS (SELECT task_id, alpha1, alpha2, alpha3, z1, delta_lo, delta_hi FROM tried JOIN points USING (i3, i1) JOIN tasks USING (task_id)
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY 2 * z1 * synth_se + (delta_hi - delta_lo), i3, i1) = 1),
grid AS (SELECT t.task_id, {q.d(ALPHA)} AS alpha, n, n * RUNS AS n_calls, (SELECT t FROM size) AS t_hist, theta, synth, alpha1, alpha2, alpha3, greatest(0.0::DOUBLE, synth - z1 * synth_se + delta_lo) AS ci_lo, least(1.0::DOUBLE, synth + z1 * synth_se + delta_hi) AS ci_hi,
  2 * z1 * synth_se AS w_synth, delta_hi - delta_lo AS w_band, greatest(0.0::DOUBLE, synth - {Z10} * synth_se) AS naive_lo, least(1.0::DOUBLE, synth + {Z10} * synth_se) AS naive_hi FROM tasks t JOIN best USING (task_id))"""


def _grid_tasks(spark, sf):
    return inputs.cells(spark, sf).select(F.concat_ws("|", "wave", "party", "region").alias("task_id"), "n", "theta", "synth", "synth_se", "gap", "gap_se")


@query(f"""WITH RECURSIVE {GRID.replace('RUNS', '4')} SELECT task_id, alpha, n, n_calls, t_hist, {rounds('theta synth', 5)}, {rounds('alpha1 alpha2 alpha3', 9)}, {rounds('ci_lo ci_hi', 5)}, {q.r('ci_hi - ci_lo', 5)} AS width, ci_lo <= theta AND theta <= ci_hi AS covered, {rounds('w_synth w_band naive_lo naive_hi', 5)},
  naive_lo <= theta AND theta <= naive_hi AS naive_covered FROM grid""")
def grid_allocation(spark, sf):
    """Best budget split per task on a 30 x 30 grid."""
    rows = allocation.grid_intervals(_grid_tasks(spark, sf), 0.1, runs=4)
    return shown(rows, 5).withColumns({c: ex.rounded(F.col(c), 9) for c in ("alpha1", "alpha2", "alpha3")})


@query(f"""WITH RECURSIVE {GRID.replace('RUNS', '1')}, c AS (SELECT *, ci_lo <= theta AND theta <= ci_hi AS covered, ci_hi - ci_lo AS width FROM grid)
  SELECT alpha, {q.r('avg(covered::INT::DOUBLE)', 4)} AS coverage, count(*) FILTER (WHERE covered) || '/' || count(*) AS covered_of, {q.r('avg(width)', 4)} AS mean_length, {q.r('quantile_cont(width, 0.5)', 4)} AS median_length, count(*) AS n_tasks,
  {q.r('corr(theta, synth)', 4)} AS corr_real_synth, {q.r('avg(abs(theta - synth))', 4)} AS mean_abs_gap, min(n) AS n_least, {q.r('quantile_cont(n, 0.5)', 4)} AS n_median, max(n) AS n_largest FROM c GROUP BY alpha""")
def grid_agreement(spark, sf):
    return shown(allocation.agreement(allocation.grid_intervals(_grid_tasks(spark, sf), 0.1)), 4)


# --- battles


@query(f"WITH {q.BATTLES} SELECT a, b, y, y_auto, n FROM pairs")
def battle_pair_stats(spark, sf):
    return inputs.battle_pairs(spark, sf)


@query(f"WITH {q.BATTLES} SELECT DISTINCT player FROM sides")
def battle_participants(spark, sf):
    return bt.participants(inputs.battles(spark, sf))


WINS = f"""{q.BATTLES}, m AS (SELECT player, sum(n)::BIGINT AS n_real, sum(n * y) / sum(n) AS theta, sum(n * y_auto) / sum(n) AS synth, sum(n * (y - y_auto)) / sum(n) AS gap FROM sides GROUP BY player),
v AS (SELECT player, sum(n * (y_auto - synth) * (y_auto - synth)) AS vs, sum(n * (y - y_auto - gap) * (y - y_auto - gap)) AS vd FROM sides JOIN m USING (player) GROUP BY player),
tasks AS (SELECT player::VARCHAR AS task_id, player::VARCHAR AS label, n_real, n_real AS n_synth, theta, synth, sqrt(vs / (n_real - 1) / n_real) AS synth_se, gap, sqrt(vd / (n_real - 1) / n_real) AS gap_se FROM m JOIN v USING (player))"""


@query(f"WITH {WINS} SELECT task_id, n_real, n_synth, {rounds('theta synth synth_se gap gap_se')} FROM tasks")
def win_rate_stats(spark, sf):
    return shown(bt.win_rates(bt.oriented(inputs.battle_pairs(spark, sf))))


@query(q.method(WINS, "alg1", 0.2, mode="loo", clip=(0.0, 1.0)))
def win_rate_alg1(spark, sf):
    return shown(methods.run(bt.win_rates(bt.oriented(inputs.battle_pairs(spark, sf))), "alg1", 0.2, mode="loo", clip=(0.0, 1.0)))


@query(q.method(WINS, "alg3", 0.2, mode="loo", clip=(0.0, 1.0)))
def win_rate_one_piece(spark, sf):
    return shown(methods.run(bt.win_rates(bt.oriented(inputs.battle_pairs(spark, sf))), "alg3", 0.2, mode="loo", clip=(0.0, 1.0)))


REF = "(SELECT min(player) FROM sides)"


def mm_sql(keys: str, pairs: str, rounds_: int = 60, tag: str = "") -> str:
    """Unrolled minorisation-maximisation for the joint scores of each value of ``keys``: g0, g1, ... (behind the tag) hold exp(score)."""
    w, g, u = f"{tag}w", f"{tag}g", f"{tag}u"
    out = [f"{w} AS MATERIALIZED (SELECT {keys}, player, sum(w) AS w FROM {pairs} GROUP BY {keys}, player)", f"{g}0 AS MATERIALIZED (SELECT {keys}, player, 1.0::DOUBLE AS g FROM {w})"]
    for i in range(rounds_):
        out.append(
            f"{u}{i} AS (SELECT p.{keys}, p.player, any_value({w}.w) / sum(p.n / (s.g + o.g)) AS g FROM {pairs} p JOIN {g}{i} s ON p.player = s.player AND p.{keys} = s.{keys} JOIN {g}{i} o ON p.opponent = o.player AND p.{keys} = o.{keys} JOIN {w} ON {w}.player = p.player AND {w}.{keys} = p.{keys} GROUP BY p.{keys}, p.player), "
            f"{g}{i + 1} AS MATERIALIZED (SELECT {keys}, {u}{i}.player, {u}{i}.g / r.g AS g FROM {u}{i} JOIN (SELECT {keys}, g FROM {u}{i} WHERE player = {REF}) r USING ({keys}))"
        )
    return ", ".join(out)


@query(f"WITH {q.BATTLES}, t AS MATERIALIZED (SELECT 0 AS f, player, opponent, sum(n * y) AS w, sum(n)::DOUBLE AS n FROM sides GROUP BY player, opponent), {mm_sql('f', 't', 80)}, s AS (SELECT player, ln(g) AS score FROM g80) SELECT player, {q.r('score', 5)} AS score, {q.r(f'{q.d(ELO_SCALE)} * score', 2)} AS elo, rank() OVER (ORDER BY round(score, 8) DESC)::INT AS rank FROM s")
def bt_leaderboard(spark, sf):
    """Joint Bradley-Terry scores, Elo and rank."""
    pairs = written(inputs.battle_pairs(spark, sf), "battle-pairs")
    s = bt.leaderboard(bt.joint_scores(pairs, bt.reference_of(pairs)))
    return s.select("player", ex.rounded(F.col("score"), 5).alias("score"), ex.rounded(ELO_SCALE * F.col("score"), 2).alias("elo"), "rank")


#: Background: the reference and the next players by key up to 5; the others are task players.
M_BACKGROUND = 5


def _bt_tasks(pairs, reference):
    players = bt.participants(pairs)
    ordered = bt.order_players(players, players.select("player", F.col("player").alias("pos")))
    return bt.split_players(ordered, reference, M_BACKGROUND).where("role = 'task'").select("player")


def _bt_parts(spark, sf, draws=0):
    pairs = written(inputs.battle_pairs(spark, sf), "battle-pairs")
    reference = bt.reference_of(pairs)
    tasks = _bt_tasks(pairs, reference)
    frame = written(bt.frames(pairs, tasks, reference), "frames")
    return written(bt.placements(bt.oriented(pairs), frame, tasks, draws), "placements"), frame


TASKS_BT = f"tp AS MATERIALIZED (SELECT player FROM (SELECT player, row_number() OVER (ORDER BY player) AS k FROM (SELECT DISTINCT player FROM sides)) WHERE k > {M_BACKGROUND})"
FRAMES = f"{q.BATTLES}, {TASKS_BT}, tf AS MATERIALIZED (SELECT 0 AS f, player, opponent, sum(n * y) AS w, sum(n)::DOUBLE AS n FROM sides GROUP BY player, opponent), t AS MATERIALIZED (SELECT tp.player AS held_out, s.player, opponent, sum(n * y) AS w, sum(n)::DOUBLE AS n FROM sides s JOIN tp ON s.player <> tp.player AND s.opponent <> tp.player GROUP BY ALL), {mm_sql('held_out', 't', 40)}, {mm_sql('f', 'tf', 60, 'f')}, frame AS MATERIALIZED (SELECT tp.player AS held_out, fg60.player, coalesce(ln(g40.g), ln(fg60.g)) AS score FROM tp JOIN fg60 ON fg60.player <> tp.player LEFT JOIN g40 ON g40.held_out = tp.player AND g40.player = fg60.player)"


def place_sql(out: str, y: str, rounds_: int = 12) -> str:
    parts = [f"{out}0 AS (SELECT DISTINCT held_out, player, 0.0::DOUBLE AS b FROM rows)"]
    p = "(1 / (1 + exp(-(b - c))))"
    for i in range(rounds_):
        parts.append(f"{out}{i + 1} AS MATERIALIZED (SELECT held_out, player, any_value(b) + least(4.0::DOUBLE, greatest(-4.0::DOUBLE, (sum(n * ({y} - {p})) - 1e-6::DOUBLE * any_value(b)) / (sum(n * {p} * (1 - {p})) + 1e-6::DOUBLE))) AS b FROM rows JOIN {out}{i} USING (held_out, player) GROUP BY held_out, player)")
    parts.append(f"{out} AS MATERIALIZED (SELECT held_out, player, any_value(b) AS b, 1 / sqrt(sum(n * {p} * (1 - {p})) + 1e-6::DOUBLE) AS se, sum(n)::BIGINT AS n FROM rows JOIN {out}{rounds_} USING (held_out, player) GROUP BY held_out, player)")
    return ", ".join(parts)


PLACED = f"""{FRAMES}, rows AS MATERIALIZED (SELECT h.player AS held_out, s.player, s.y, s.y_auto, s.n, f.score AS c FROM tp h, tp j, sides s, frame f
  WHERE s.player = j.player AND (j.player = h.player OR s.opponent <> h.player) AND f.held_out = h.player AND f.player = s.opponent), {place_sql('pt', 'y')}, {place_sql('pa', 'y_auto')},
placed AS MATERIALIZED (SELECT held_out, player, pt.n, pt.b AS truth, pt.se AS truth_se, pa.b AS synth, pa.se AS synth_se FROM pt JOIN pa USING (held_out, player))"""


@query(f"WITH {PLACED} SELECT held_out, player, n, {rounds('truth truth_se synth synth_se', 4)} FROM placed")
def bt_placements(spark, sf):
    """Each held-out player and each other task player placed against the frame without the held-out one."""
    placed, _ = _bt_parts(spark, sf)
    return shown(placed.drop("gap_se", "gap_delta_se"), 4)


def bt_sql(algo: str, alpha: float) -> str:
    h = q.d(z(alpha))
    if algo == "alg4":
        a = (0.0, 0.0, alpha)
        rows = f"hist AS (SELECT held_out, truth - synth AS gap FROM placed WHERE player <> held_out), {q.band('gap', 'gap', 'gap', q.d(alpha), 'hist', 'held_out')}, own AS (SELECT p.*, synth AS synth_lo, synth AS synth_hi, delta_lo, delta_hi FROM placed p JOIN bands USING (held_out) WHERE player = held_out)"
    else:
        a = (alpha, 0.0, 0.0)
        rows = f"own AS (SELECT *, synth - {h} * synth_se AS synth_lo, synth + {h} * synth_se AS synth_hi, 0.0::DOUBLE AS delta_lo, 0.0::DOUBLE AS delta_hi FROM placed WHERE player = held_out)"
    ranks = ", ".join(f"(SELECT count(*) + 1 FROM frame f WHERE f.held_out = i.held_out AND f.score > i.{v})::INT AS {n}" for n, v in (("rank", "truth"), ("rank_lo", "ci_hi"), ("rank_hi", "ci_lo")))
    return f"""WITH {PLACED}, {rows}, i AS (SELECT *, synth_lo + delta_lo AS ci_lo, synth_hi + delta_hi AS ci_hi FROM own),
k AS (SELECT *, truth - {h} * truth_se AS theta_lo, truth + {h} * truth_se AS theta_hi, {ranks}, (SELECT count(*) + 1 FROM frame f WHERE f.held_out = i.held_out)::INT AS n_models FROM i)
SELECT player, '{algo}' AS algo, {q.d(alpha)} AS alpha, {q.d(a[0])} AS alpha1, {q.d(a[1])} AS alpha2, {q.d(a[2])} AS alpha3, n, {q.r('truth', 4)} AS theta, {rounds('ci_lo ci_hi', 4)},
  isfinite(ci_lo) AND isfinite(ci_hi) AND ci_lo <= truth AND truth <= ci_hi AS covered, rank, rank_lo, rank_hi, rank_lo <= rank AND rank <= rank_hi AS rank_covered, n_models, {rounds('theta_lo theta_hi', 4)}, {', '.join(f"{q.r(f'{q.d(ELO_SCALE)} * {c}', 1)} AS elo_{n}" for n, c in (('truth', 'truth'), ('lo', 'ci_lo'), ('hi', 'ci_hi'), ('theta_lo', 'theta_lo'), ('theta_hi', 'theta_hi')))} FROM k"""


BT_SHOWN = ["player", "algo", "alpha", "alpha1", "alpha2", "alpha3", "n", "theta", "ci_lo", "ci_hi", "covered", "rank", "rank_lo", "rank_hi", "rank_covered", "n_models", "theta_lo", "theta_hi", "elo_truth", "elo_lo", "elo_hi", "elo_theta_lo", "elo_theta_hi"]


def _bt_shown(df: DataFrame) -> DataFrame:
    elo = {c: ex.rounded(F.col(c), 1) for c in df.columns if c.startswith("elo_")}
    return shown(df.select(*BT_SHOWN).withColumns(elo), 4)


@query(bt_sql("alg4", 0.4))
def bt_one_piece(spark, sf):
    return _bt_shown(bt.intervals(*_bt_parts(spark, sf), "alg4", 0.4))


@query(bt_sql("synth_only", 0.1))
def bt_naive(spark, sf):
    return _bt_shown(bt.intervals(*_bt_parts(spark, sf), "synth_only", 0.1))


@query()
def bt_alg1(spark, sf):
    """With bootstrap errors of the gaps (random draws have no SQL; see the tests)."""
    placed, frame = _bt_parts(spark, sf, 60)
    return bt.intervals(placed, frame, "alg1", 0.4)


@query(f"""WITH {PLACED}, u AS (SELECT held_out, player, n, y, y_auto, c, (y - 1 / (1 + exp(c - truth))) * truth_se * truth_se - (y_auto - 1 / (1 + exp(c - synth))) * synth_se * synth_se AS u FROM rows JOIN (SELECT * EXCLUDE (n) FROM placed) USING (held_out, player))
  SELECT held_out, player, {q.r('sqrt(sum(n * u * u) - sum(n * u) * sum(n * u) / sum(n))', 4)} AS gap_delta_se, true AS bootstrap_near FROM u WHERE held_out <> player GROUP BY held_out, player""")
def bt_gap_errors(spark, sf):
    """The gaps' errors by the delta method, and whether those of 60 bootstrap draws are within half of them (five deviations)."""
    placed, _ = _bt_parts(spark, sf, 60)
    rows = placed.where("held_out <> player")
    return shown(rows.select("held_out", "player", "gap_delta_se", (F.abs(F.col("gap_se") / F.col("gap_delta_se") - 1) < 0.5).alias("bootstrap_near")), 4)


# --- bootstrap

BRANDS = f"""{q.PAIRS}, s AS (SELECT p_brand, avg(x) AS mx, avg(y) AS my FROM pairs GROUP BY p_brand)"""


@query(f"WITH {BRANDS} SELECT p_brand, target, kind, {q.r('CASE target WHEN {0} THEN mx WHEN {1} THEN my ELSE mx - my END'.format(repr('real'), repr('synth')))} AS point, true AS se_near, true AS ends_near FROM s, (SELECT unnest(['real', 'synth', 'gap', 'paired_gap']) AS target), (SELECT unnest(['percentile', 'basic']) AS kind)")
def bootstrap_normal_agreement(spark, sf):
    """Points of the bootstrap, and whether errors and ends are those of the normal interval up to the draws' own noise:
    within 15 percent, and within 0.35 errors (five deviations of 1000 draws)."""
    pairs = written(inputs.pairs(spark, sf).groupBy("p_brand", "x", "y").agg(F.count("*").alias("n")), "pair-values")
    found = bootstrap.bootstrap_intervals(pairs, ["p_brand"], "x", "y", ALPHA, 1000, count="n")
    stats = moments.counted_stats(pairs, ["p_brand"], "x", "y", "n").select("p_brand", F.create_map(F.lit("real"), "theta_se", F.lit("synth"), "synth_se", F.lit("gap"), F.sqrt(F.col("theta_se") ** 2 + F.col("synth_se") ** 2), F.lit("paired_gap"), "gap_se").alias("errors"))
    rows = found.join(stats, "p_brand").withColumn("e", F.element_at("errors", F.col("target")))
    near = lambda end, side: F.abs(F.col(end) - (F.col("point") + side * z(ALPHA) * F.col("e"))) < 0.35 * F.col("e")
    return shown(rows.select("p_brand", "target", "kind", "point", (F.abs(F.col("se") / F.col("e") - 1) < 0.15).alias("se_near"), (near("ci_lo", -1) & near("ci_hi", 1)).alias("ends_near")))


@query()
def bootstrap_intervals(spark, sf):
    """Percentile and basic intervals per brand (random draws; see the tests)."""
    return bootstrap.bootstrap_intervals(inputs.pairs(spark, sf), ["p_brand"], "x", "y", ALPHA, 1000)


@query()
def bootstrap_quantile_gaps(spark, sf):
    """Upper quartiles of the prices of large and small orders of each brand: ranks are drawn, no task is put in order."""
    return bootstrap.bootstrap_intervals(inputs.pairs(spark, sf), ["p_brand"], "price", "w", ALPHA, 500, 0.75)


@query()
def bootstrap_median_gaps(spark, sf):
    return bootstrap.bootstrap_intervals(inputs.pairs(spark, sf), ["p_brand"], "x", "y", ALPHA, 500, "median")


@query()
def poisson_bootstrap(spark, sf):
    """Replicate means of event values per type by Poisson weights; no group is gathered."""
    means = bootstrap.poisson_means(inputs.table(spark, sf, "events"), ["event_type"], "event_id", "value", 50)
    return means.groupBy("event_type").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("se"), F.percentile("mean", F.array(F.lit(0.05), F.lit(0.95))).alias("ends"))


# --- records


@query(f"SELECT task_id, label, theta, ci_lo, ci_hi, covered, width, alpha, '010' AS alpha_tag, 'demo' AS app FROM ({L1})")
def records_round_trip(spark, sf):
    """Records written as CSV in folders by key and read back with types."""
    path = fresh(spark, "records")
    rows = shown(_loo(spark, sf)).withColumn("coord", F.lit(None).cast("string"))
    for _ in range(2):  # the second time in place of the first
        io.write_records(rows, path, "demo", "tasks")
    back = io.read_records(spark, path)
    return back.select("task_id", "label", "theta", "ci_lo", "ci_hi", "covered", "width", "alpha", "alpha_tag", "app")


@query(f"SELECT algo, alpha, n_tasks, mean_width_clip, row_number() OVER (ORDER BY mean_width_clip, algo, alpha) AS place FROM ({summary_sql(LOO_UNION)})")
def ordered_results(spark, sf):
    """The summary of all methods in the order of the clipped width."""
    rows = loo_method_table(spark, sf).select("algo", "alpha", "n_tasks", "mean_width_clip")
    return summaries.ordered(rows, ["mean_width_clip", "algo", "alpha"]).withColumn("place", F.col("place").cast("long"))


def manifest_sql(inner: str) -> str:
    return f"SELECT algo, alpha, alloc, count(*) AS n, round(avg(covered::INT::DOUBLE) * 100, 1) AS coverage_pct, round(avg(width_clip) FILTER (WHERE isfinite(width_clip)), 4) AS mean_width_clip FROM ({inner}) GROUP BY algo, alpha, alloc"


@query(manifest_sql(LOO_UNION))
def result_manifest(spark, sf):
    return summaries.manifest(shown(methods.run_all(inputs.paired_tasks(spark, sf), ALPHAS, ("alg1", "alg3", "synth_only"), mode="loo", clip=UNIT)))


@query(f"""WITH a AS ({manifest_sql(f'SELECT * FROM ({L1}) UNION ALL SELECT * FROM ({L3})')}), b AS ({manifest_sql(f'SELECT * FROM ({L1}) UNION ALL SELECT * FROM ({LS})')})
  SELECT algo, alpha, alloc, a.n AS old_n, b.n AS new_n FROM a FULL JOIN b USING (algo, alpha, alloc) WHERE (a.n, a.coverage_pct, a.mean_width_clip) IS DISTINCT FROM (b.n, b.coverage_pct, b.mean_width_clip)""")
def result_differences(spark, sf):
    one, three, naive = _loo_each(spark, sf, "alg1", "alg3", "synth_only")
    found = summaries.differences(summaries.manifest(one.unionByName(three)), summaries.manifest(one.unionByName(naive)))
    return found.select("algo", "alpha", "alloc", F.col("old.n").alias("old_n"), F.col("new.n").alias("new_n"))


@query("SELECT algo, printf('%.2f', alpha) AS alpha, n_tasks::VARCHAR AS n, printf('%.0f', round(coverage_pct)) || '%' AS coverage, " + ", ".join(f"CASE WHEN isfinite({c}) THEN printf('%.3f', round({c}, 3)) ELSE '—' END AS {c}" for c in ("mean_width", "mean_width_clip", "w1", "w2", "w3")) + f" FROM ({summary_sql(LOO_UNION)})")
def readable_report(spark, sf):
    return summaries.report(loo_method_table(spark, sf))


FOREIGN = "m AS (SELECT s_name AS model, 0.1::DOUBLE + s_nationkey * 1e-9::DOUBLE AS alpha, s_acctbal / 10000 AS W_L, s_acctbal / 10000 + 0.3::DOUBLE AS W_U, s_nationkey % 2 = 0 AS cov, s_acctbal / 9000 AS W_truth, CASE WHEN s_nationkey % 3 = 0 THEN 'conformal_only' ELSE 'other' END AS variant FROM supplier)"
FOREIGN_BASE = "model AS task_id, model AS label, {t} AS theta, '{a}' AS algo, alpha, 'prop_127' AS alloc, {l} AS ci_lo, {u} AS ci_hi, cov AS covered, {w} AS width, {c} AS width_clip"


def _foreign(algo: str, extra: str, where: str = "true") -> str:
    base = FOREIGN_BASE.format(a=algo, t=q.r("W_truth"), l=q.r("W_L"), u=q.r("W_U"), w=q.r("W_U - W_L"), c=q.r("least(1.0::DOUBLE, W_U) - greatest(0.0::DOUBLE, W_L)"))
    return f"SELECT {base}, {extra} FROM m WHERE abs(alpha - 0.1::DOUBLE) <= 1e-8::DOUBLE + 1e-5::DOUBLE * 0.1::DOUBLE AND {where}"


@query(f"WITH {FOREIGN} " + " UNION ALL ".join([_foreign("alg1", "0.01::DOUBLE AS alpha1, 0.02::DOUBLE AS alpha2, 0.07::DOUBLE AS alpha3"), _foreign("synth_only", "NULL, NULL, NULL"), _foreign("alg3", "NULL, NULL, NULL", "variant = 'conformal_only'")]))
def ingested_results(spark, sf):
    """Foreign result tables (shaped from suppliers) in the record schema."""
    m = inputs.table(spark, sf, "supplier").select(F.col("s_name").alias("model"), (F.lit(0.1) + F.col("s_nationkey") * 1e-9).alias("alpha"), (F.col("s_acctbal") / 10000).alias("W_L"), (F.col("s_acctbal") / 10000 + 0.3).alias("W_U"), (F.col("s_nationkey") % 2 == 0).alias("covered"), (F.col("s_acctbal") / 9000).alias("W_truth"), F.when(F.col("s_nationkey") % 3 == 0, "conformal_only").otherwise("other").alias("variant"))
    paired = m.select("model", "alpha", F.lit(0.01).alias("a1"), F.lit(0.02).alias("a2"), F.lit(0.07).alias("a3"), "W_L", "W_U", F.col("covered").alias("covered_W"), "W_truth")
    return shown(io.ingest(paired, m, m, 0.1))


@query(f"WITH {q.PAIRS}, n AS (SELECT task_id, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM pairs GROUP BY task_id) SELECT task_id, substr(task_id, 1, 12) AS label, n, {rounds('mx my')} FROM n")
def packed_task_round_trip(spark, sf):
    """Tasks as arrays, written, read and unpacked again."""
    packed = written(io.packed_tasks(inputs.pairs(spark, sf), "task_id", "x", "y", F.struct("l_orderkey", "l_linenumber"), 500), "packed")
    rows = io.unpacked_tasks(packed, "task_id", "s_real", "s_synth", 12)
    return shown(rows.groupBy("task_id", "label").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")))


@query("SELECT n_name AS player, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS pos, CASE WHEN n_nationkey % 2 = 0 THEN '2026-01-0' || (n_nationkey % 9 + 1) END AS date FROM nation")
def release_ordering(spark, sf):
    """A release file (made from the nations) read as an ordering with dates."""
    n = inputs.table(spark, sf, "nation")
    dates = F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("2026-01-0"), (F.col("n_nationkey") % 9 + 1).cast("string"))).alias("date"), F.lit("s").alias("source"), F.lit("c").alias("confidence")))))
    path = fresh(spark, "ordering")
    n.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("ordering"), dates.alias("dates"), F.lit("").alias("_note")).write.json(path)
    return io.read_ordering(spark, path)


@query("SELECT year(o_orderdate)::INT AS year, year(o_orderdate) || ':' || l_linestatus || ' / ' || l_returnflag AS task_id, count(*) AS n, round(avg(l_discount), 6) AS x, round(avg(l_tax), 6) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) IN (1996, 2000) GROUP BY ALL")
def respondent_tasks(spark, sf):
    """Lines as respondents whose id starts with the year, written as CSV and read as tasks of two years."""
    orders = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y"))
    rows = inputs.table(spark, sf, "lineitem").join(orders, "l_orderkey")
    rows = rows.select(F.format_string("%d%08d", "y", "l_orderkey").alias("id"), F.col("l_returnflag").alias("pid"), F.col("l_linestatus").alias("grp"), F.col("l_discount").cast("double").alias("x"), F.col("l_tax").cast("double").alias("y"))
    path = fresh(spark, "respondents")
    rows.write.option("header", True).csv(path)
    tasks = io.respondent_tasks(io.read_paired(spark, path, "csv", "id string, pid string, grp string, x double, y double"), "id", ["pid", "grp"], "x", "y").where("year in (1996, 2000)")
    return tasks.groupBy("year", "task_id").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query(f"WITH {q.BATTLES} SELECT a::VARCHAR AS a, b::VARCHAR AS b, y, y_auto, n FROM pairs")
def battle_file(spark, sf):
    """Battles written as CSV, read with the check of the reference, and counted."""
    battles = inputs.battles(spark, sf)
    path = fresh(spark, "battles")
    battles.write.option("header", True).csv(path)
    return bt.pair_stats(io.read_battles(spark, path, str(inputs.table(spark, sf, "supplier").agg(F.min("s_nationkey")).first()[0])))


@query("""SELECT 'demo' AS app, task_def, count(DISTINCT y) AS t_tasks, (SELECT count(DISTINCT year(o_orderdate)) FROM orders) - count(DISTINCT y) AS t_hist, count(*) AS n_rows, CASE task_def WHEN 'early' THEN 'temporal' ELSE 'loo' END AS mode,
  CASE task_def WHEN 'early' THEN array_to_string(list_sort(list(DISTINCT y::VARCHAR)), ',') ELSE '' END AS waves FROM (SELECT year(o_orderdate) AS y, CASE WHEN year(o_orderdate) < 1996 THEN 'early' ELSE 'late' END AS task_def FROM orders) GROUP BY task_def""")
def task_definitions(spark, sf):
    """Task definitions (made from the order years) written as JSON and written anew: hand-written fields stay."""
    years = inputs.table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).withColumn("task_def", F.when(F.col("y") < 1996, "early").otherwise("late"))
    every = years.agg(F.count_distinct("y")).first()[0]  # the years of the other definition are a definition's history
    found = years.groupBy("task_def").agg(F.count_distinct("y").alias("t_tasks"), (F.lit(every) - F.count_distinct("y")).cast("long").alias("t_hist"), F.count("*").alias("n_rows"), F.array_sort(F.collect_set(F.col("y").cast("string"))).alias("waves"))
    plain = found.select(F.lit("demo").alias("app"), "task_def", "t_tasks", "t_hist", "n_rows", F.struct(F.lit("loo").alias("mode"), F.array().cast("array<string>").alias("predict_waves")).alias("eval"), "waves")
    plain = written(plain, "definitions")
    authored = plain.where("task_def = 'early'").withColumn("eval", F.struct(F.lit("temporal").alias("mode"), F.col("waves").alias("predict_waves")))
    old, new = fresh(spark, "info"), fresh(spark, "info")
    io.write_task_defs(authored, old)
    io.write_task_defs(io.keep_authored(plain.drop("waves"), io.read_task_defs(spark, old)), new)
    return io.read_task_defs(spark, new).select("app", "task_def", "t_tasks", "t_hist", "n_rows", "eval.mode", F.array_join("eval.predict_waves", ",").alias("waves"))


@query(f"WITH {q.PAIRS}, r AS (SELECT year(o_orderdate) AS wave, count(*) AS n FROM pairs JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT wave, n, CASE WHEN wave >= (SELECT max(wave) - 1 FROM r) THEN 'predict' ELSE 'calib' END AS role FROM r")
def eval_spec(spark, sf):
    """A specification (the last two waves are predicted) written as JSON and applied to the rows' waves."""
    orders = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("wave"))
    waves = written(inputs.pairs(spark, sf).join(orders, "l_orderkey").groupBy("wave").agg(F.count("*").alias("n")), "waves")
    path = fresh(spark, "spec")
    last = waves.orderBy(F.desc("wave")).limit(2).agg(F.collect_list(F.col("wave").cast("string")).alias("predict_waves"))
    last.select(F.lit("demo").alias("task_def"), F.lit("temporal").alias("mode"), "predict_waves").write.json(path)
    spec = io.read_spec(spark, path).select(F.explode("predict_waves").alias("predicted"))
    return waves.join(spec, F.col("wave").cast("string") == F.col("predicted"), "left").select("wave", "n", F.when(F.col("predicted").isNotNull(), "predict").otherwise("calib").alias("role"))


@query(f"""WITH p AS (SELECT s_name AS player, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END AS pos FROM supplier), o AS (SELECT player, row_number() OVER (ORDER BY pos NULLS LAST, player) AS place FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY player = 'Supplier#000000003' ORDER BY place) AS k FROM o)
  SELECT player, place::INT AS place, CASE WHEN player = 'Supplier#000000003' OR k <= 4 THEN 'background' ELSE 'task' END AS role FROM r""")
def anchor_split(spark, sf):
    """Ordered players, listed ones first, parted into background and tasks."""
    s = inputs.table(spark, sf, "supplier").select(F.col("s_name").alias("player"), "s_nationkey")
    ordered = bt.order_players(s.select("player"), s.where("s_nationkey % 2 = 0").select("player", F.col("s_nationkey").alias("pos")))
    return bt.split_players(ordered, "Supplier#000000003", 5).select("player", "place", "role")


DATE_SQL = r"""SELECT page_id, CASE WHEN regexp_matches(u, '20\d{6}') THEN regexp_replace(regexp_extract(u, '(20\d{2})(\d{2})(\d{2})', 0), '(\d{4})(\d{2})(\d{2})', '\1-\2-\3')
  WHEN a BETWEEN 1 AND 12 AND b BETWEEN 1 AND 31 THEN '2026-' || pa || '-' || pb WHEN a >= 24 THEN '20' || pa || '-' || pb || '-15' END AS released
  FROM (SELECT *, try_cast(pa AS INT) AS a, try_cast(pb AS INT) AS b FROM (SELECT page_id, u, regexp_extract(u, '-(\d{2})(\d{2})(?:\D|$)', 1) AS pa, regexp_extract(u, '-(\d{2})(\d{2})(?:\D|$)', 2) AS pb
  FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'm-20' || (210000 + page_id * 37 % 9000)::VARCHAR ELSE replace(url, '/en/', '-') END AS u FROM pages)))"""


@query(DATE_SQL)
def dates_in_names(spark, sf):
    """Dates written in names (page addresses and names made from ids)."""
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("m-20"), (F.lit(210000) + F.col("page_id") * 37 % 9000).cast("string"))).otherwise(F.replace("url", F.lit("/en/"), F.lit("-")))
    return inputs.table(spark, sf, "pages").select("page_id", ex.date_in_name(u).alias("released"))


# --- sets


@query("""WITH a AS (SELECT DISTINCT n_name AS player FROM nation JOIN supplier ON s_nationkey = n_nationkey), b AS (SELECT DISTINCT n_name AS player FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000)
  SELECT 'union' AS what, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'absent', count(*) FROM (SELECT n_name FROM nation EXCEPT SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def shown_players(spark, sf):
    """Players of two figures: their union, those in neither and those in the first only."""
    nation = inputs.table(spark, sf, "nation")
    name = nation.select("n_nationkey", F.col("n_name").alias("player"))
    a = name.join(inputs.table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("player")
    b = name.join(inputs.table(spark, sf, "customer").where("c_acctbal > 9000"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("player")
    every = name.select("player")
    parts = [("union", a.union(b).distinct()), ("absent", every.subtract(a).subtract(b)), ("first_only", a.subtract(b))]
    out = None
    for label, df in parts:
        part = df.agg(F.lit(label).alias("what"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# --- pseudonyms

#: Names looked for in the texts: short words of the corpus and one nested in another.
TEXT_NAMES = {"the": "name-1", "then": "name-2", "ing": "name-3", "und": "name-4"}


@query("""WITH n AS (SELECT DISTINCT s_name AS name FROM supplier), k AS (SELECT name, 'model-' || lpad((row_number() OVER (ORDER BY md5('0:' || name), name))::VARCHAR, length((SELECT count(*) FROM n)::VARCHAR)::INT, '0') AS alias FROM n)
  SELECT CASE WHEN s_nationkey < 5 THEN alias ELSE s_name END AS name, s_nationkey, s_acctbal, CASE WHEN s_nationkey >= 5 THEN '2026-01-01' END AS released FROM supplier JOIN k ON s_name = name""")
def pseudonymised_players(spark, sf):
    """Supplier names in key columns replaced."""
    s = inputs.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_nationkey", "s_acctbal", F.lit("2026-01-01").alias("released"))
    names = deident.mapping(s, s.where("s_nationkey < 5"))
    return deident.rename_keys(s, ["name"], names, {"released": "name"})


@query("SELECT 'name' AS column, count(*) FILTER (WHERE s_nationkey < 5) AS n FROM supplier")
def pseudonym_counts(spark, sf):
    s = inputs.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_nationkey")
    return deident.substitutions(s, ["name"], deident.mapping(s, s.where("s_nationkey < 5")))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, 'then', chr(1)), 'the', 'name-1'), 'ing', 'name-3'), 'und', 'name-4'), chr(1), 'name-2')) AS text_sha256 FROM documents")
def pseudonymised_texts(spark, sf):
    """Names in free text replaced, longest match first."""
    rows = deident.replace_in_text(inputs.table(spark, sf, "documents").select("doc_id", "text"), "text", TEXT_NAMES)
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id, name, n FROM (SELECT doc_id, name, ((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS n FROM documents, (VALUES ('the'), ('then'), ('ing'), ('und')) v(name)) WHERE n > 0")
def leaked_names(spark, sf):
    return deident.leaks(inputs.table(spark, sf, "documents"), "doc_id", "text", list(TEXT_NAMES))
