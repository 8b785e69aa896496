import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from synthcal.functions.levels import ALLOCATIONS, split_bonferroni, z
from synthcal.operators import conformal, moments
from synthcal.plans import methods, multidim

STATS = "task_id string, role string, n_real long, n_synth long, theta double, synth double, synth_se double, gap double, gap_se double"


def made(n, seed=1, ties=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        gap = rng.choice([0.0, 0.1]) if ties else rng.gauss(0.05, 0.1)
        synth = rng.random()
        out.append((f"t{i:03d}", "calib" if i % 2 else "predict", 50, 50, synth + gap, synth, 0.02 + 0.01 * (i % 3), gap, 0.01 if ties else 0.01 + 0.005 * (i % 4)))
    return out


def kth(values, t, a3):
    low, high = math.floor((t + 1) * a3 / 2.0), math.ceil((t + 1) * (1.0 - a3 / 2.0))
    s = sorted(values)
    return (-math.inf if low <= 0 else s[low - 1]), (math.inf if high > t else s[high - 1])


def brute(rows, algo, alpha, mode):
    a1, a2, a3 = ALLOCATIONS["prop_127"](0, alpha)
    out = {}
    for r in rows:
        if mode == "split" and r[1] != "predict":
            continue
        hist = [h for h in rows if (h[1] == "calib" if mode == "split" else h[0] != r[0])]
        t = len(hist)
        if algo == "synth_only":
            out[r[0]] = (r[5] - z(alpha) * r[6], r[5] + z(alpha) * r[6])
            continue
        level = a2 / t if algo == "alg2" else a2
        half = 0 if algo == "alg3" else NormalDist().inv_cdf(1 - level / 2)
        own = 0 if algo == "alg3" else z(a1)
        third = alpha if algo == "alg3" else a3
        dl = kth([h[7] - half * h[8] for h in hist], t, third)[0]
        du = kth([h[7] + half * h[8] for h in hist], t, third)[1]
        out[r[0]] = (r[5] - own * r[6] + dl, r[5] + own * r[6] + du)
    return out


@pytest.mark.parametrize("mode", ["split", "loo"])
@pytest.mark.parametrize("algo", methods.METHODS)
@pytest.mark.parametrize("ties", [False, True])
def test_methods_equal_brute_force(spark, algo, mode, ties):
    rows = made(60, ties=ties)
    got = methods.run(spark.createDataFrame(rows, STATS), algo, 0.2, mode=mode, clip=(0.0, 1.0)).collect()
    expected = brute(rows, algo, 0.2, mode)
    assert {r["task_id"] for r in got} == set(expected)
    for r in got:
        lo, hi = expected[r["task_id"]]
        assert r["ci_lo"] == pytest.approx(lo) and r["ci_hi"] == pytest.approx(hi)
        assert r["ci_lo"] == pytest.approx(r["synth_lo"] + r["delta_lo"])
        if math.isfinite(r["width"]):
            assert r["w1"] + r["w2"] + r["w3"] == pytest.approx(r["width"])
            assert r["covered"] == (lo <= r["theta"] <= hi)


@pytest.mark.parametrize("mode", ["split", "loo"])
def test_plugged_intervals(spark, mode):
    rows = made(60)
    df = spark.createDataFrame(rows, STATS)
    a1, a2, a3 = ALLOCATIONS["prop_127"](0, 0.2)
    half = lambda a, n: math.sqrt(math.log(2 / a) / (2 * n))
    gap = math.sqrt(2 * (1 / 50 + 1 / 50) / 4 * math.log(2 / a2))
    got = methods.run(df, ["alg1", "alg3"], [0.1, 0.2], mode=mode, mean_interval="hoeffding", gap_interval="hoeffding", bounds=(0.0, 1.0)).where("algo = 'alg1' and alpha = 0.2").collect()
    for r in got:
        hist = [h for h in rows if (h[1] == "calib" if mode == "split" else h[0] != r["task_id"])]
        own = next(x for x in rows if x[0] == r["task_id"])
        assert r["ci_lo"] == pytest.approx(own[5] - half(a1, 50) + kth([h[7] - gap for h in hist], len(hist), a3)[0])
        assert r["ci_hi"] == pytest.approx(own[5] + half(a1, 50) + kth([h[7] + gap for h in hist], len(hist), a3)[1])
    columns = df.withColumns({"mean_ci_lo": F.col("synth") - 1, "mean_ci_hi": F.col("synth") + 1, "gap_ci_lo": F.col("gap"), "gap_ci_hi": F.col("gap") + 2})
    wide = methods.run(columns, "alg1", 0.2, mode=mode, mean_interval="columns", gap_interval=lambda level, bounds: (F.col("gap_ci_lo"), F.col("gap_ci_hi"))).first()
    assert wide["w1"] == pytest.approx(2) and wide["delta_hi"] > 1


def test_too_few_tasks_give_infinite_intervals(spark):
    got = methods.run(spark.createDataFrame(made(8), STATS), "alg1", 0.1, mode="loo").collect()
    assert all(math.isinf(r["width"]) and not r["covered"] and r["w3"] is None and r["width_clip"] is None for r in got)
    got = methods.run(spark.createDataFrame(made(8), STATS), "alg1", 0.1, mode="loo", infinite_covers=True).collect()
    assert all(r["covered"] for r in got)


def test_partitioning_and_names_do_not_matter(spark):
    df = spark.createDataFrame(made(40), STATS)
    run = lambda d: sorted((r["ci_lo"], r["ci_hi"]) for r in methods.run(d, "alg1", 0.2, mode="loo").collect())
    first = run(df)
    assert run(df.repartition(7)) == first == run(df.withColumn("task_id", F.reverse("task_id")))


def test_checks(spark):
    df = spark.createDataFrame(made(10), STATS)
    with pytest.raises(ValueError):
        methods.run(df, "alg9", 0.1)
    with pytest.raises(ValueError):
        methods.run(df, "alg1", 1.5)
    with pytest.raises(ValueError):
        methods.run(df, "alg1", 0.005, "abs_005_005")


def test_sets_are_kept_apart(spark):
    one, two = made(30, 1), made(44, 2)
    df = spark.createDataFrame([("a", *r) for r in one] + [("b", *r) for r in two], f"s string, {STATS}")
    for algo in ("alg1", "alg2"):
        got = methods.run(df, algo, 0.2, mode="loo", by=["s"]).collect()
        for name, rows in (("a", one), ("b", two)):
            expected = brute(rows, algo, 0.2, "loo")
            for r in got:
                if r["s"] == name:
                    assert (r["ci_lo"], r["ci_hi"]) == pytest.approx(expected[r["task_id"]])


def test_global_order_stats(spark):
    rng = random.Random(3)
    rows = [(k, v) for k in "ab" for v in [rng.gauss(0, 1) for _ in range(500)] + [0.5] * 300]
    got = conformal.global_order_stats(spark.createDataFrame(rows, "g string, v double"), "v", [1, 7, 400, 700, 800, 900], ["g"], splitters=16).collect()
    for k in "ab":
        s = sorted(v for a, v in rows if a == k)
        assert sorted((r[1], r["value"]) for r in got if r[0] == k) == [(i, s[i - 1]) for i in (1, 7, 400, 700, 800)]
    odd = [1e300, -1e300, math.inf, -math.inf, math.inf] + [rng.random() for _ in range(995)]
    got = conformal.global_order_stats(spark.createDataFrame([(v,) for v in odd] + [(None,), (math.nan,)], "v double"), "v", [1, 2, 500, 998, 1000, 1001]).collect()
    assert sorted((r["k"], r["value"]) for r in got) == [(i, sorted(odd)[i - 1]) for i in (1, 2, 500, 998, 1000)]
    same = spark.createDataFrame([(5.0,)] * 20, "v double")
    assert conformal.global_order_stats(same, "v", [3]).first()["value"] == 5.0


def test_paired_stats_of_single_rows_and_nulls(spark):
    rows = [("a", 1.0, 0.5), ("a", None, 1.0), ("b", 1.0, 0.0), ("b", 0.0, 0.0), (None, 1.0, 1.0)]
    got = {r["k"]: r for r in moments.paired_stats(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["n_real"], got["a"]["gap_se"], got["a"]["gap"]) == (1, 0.0, 0.5)
    assert got["b"]["gap_se"] == pytest.approx(math.sqrt(0.5 / 2))


def test_weighted_cells(spark):
    rng = random.Random(5)
    rows = [("c", rng.random(), rng.random(), rng.random() + 0.1) for _ in range(50)]
    got = moments.weighted_cells(spark.createDataFrame(rows, "k string, x double, y double, w double"), ["k"], "x", "y", "w").first()
    sw = sum(r[3] for r in rows)
    mean = lambda f: sum(r[3] * f(r) for r in rows) / sw
    gap, synth = mean(lambda r: r[1] - r[2]), mean(lambda r: r[2])
    assert got["gap"] == pytest.approx(gap) and got["synth"] == pytest.approx(synth)
    assert got["gap_se"] == pytest.approx(math.sqrt(sum((r[3] * (r[1] - r[2] - gap)) ** 2 for r in rows)) / sw)
    assert got["n_eff"] == pytest.approx(sw**2 / sum(r[3] ** 2 for r in rows))


def test_rectangles_clip_before_scoring(spark):
    rng = random.Random(9)
    rows = [(f"w{i}", c, 200, 0.5, rng.gauss(0, 0.05), 0.01, 0.5, 0.01) for i in range(10) for c in ("co", "opp")]
    tasks = spark.createDataFrame(rows, "task_id string, coord string, n long, theta double, gap double, gap_se double, synth double, synth_se double")
    got = multidim.rectangles(tasks, 0.1).collect()
    assert len(got) == 20 and all(r["covered"] and not r["feasible"] and r["width"] == 1.0 and r["joint_covered"] for r in got)
    a1, a2, a3 = split_bonferroni(0, 0.5)
    wide = multidim.rectangles(tasks, 0.9).collect()
    assert any(r["feasible"] for r in wide)


def test_cells_need_both_parties_and_enough_rows(spark):
    rows = [(1, "A", 50), (1, "R", 50), (2, "A", 50), (3, "A", 50), (3, "R", 5)]
    cells = spark.createDataFrame(rows, "wave int, party string, n long").withColumns({c: F.lit(0.1) for c in ("theta", "gap", "gap_se", "synth", "synth_se")})
    role = F.when(F.col("party") == "A", "co").when(F.col("party") == "R", "opp")
    assert {r["task_id"] for r in multidim.pair_cells(cells, ["wave"], role, 10).collect()} == {"1"}
    with pytest.raises(Exception, match="twice"):
        multidim.pair_cells(cells.union(cells.where("wave = 1 and party = 'A'")), ["wave"], role, 10).collect()
