"""Order statistics, bootstrap, weighted moments, player fits and record files at sizes where no set fits in one task."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from synthcal.operators import allocation, bootstrap, conformal, deident, moments
from synthcal.operators import bradley_terry as bt
from synthcal.plans import methods
from synthcal.sources import io
from synthcal.sources.scratch import written
from test_methods import STATS, made

# --- ranks


def without_self(values, k):
    """The k-th smallest of the other values, for each value."""
    ordered = np.sort(values)
    return np.where(values <= ordered[k - 1], ordered[k], ordered[k - 1])


def test_a_million_tasks_leave_themselves_out(spark):
    n, a3 = 1_000_000, 0.07
    share = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    tasks = spark.range(0, n, 1, 8).select(F.col("id").alias("task_id"), F.round(share(1), 3).alias("x"), share(2).alias("w"))  # many ties
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    out = conformal.loo_bands(tasks, F.col("x") - F.col("w"), F.col("x") + F.col("w"), F.col("x"), a3).toPandas().sort_values("task_id")
    spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    x, w = out["x"].to_numpy(), out["w"].to_numpy()
    low, high = math.floor(n * a3 / 2), math.ceil(n * (1 - a3 / 2))
    assert (out["t_hist"] == n - 1).all()
    for column, values, k in (("delta_lo", x - w, low), ("delta_hi", x + w, high), ("mid_lo", x, low), ("mid_hi", x, high)):
        assert np.array_equal(out[column], without_self(values, k))


def test_bands_of_small_and_missing_sets(spark):
    rows = [("a", i, float(i % 3), "calib") for i in range(30)] + [("b", 0, 1.0, "calib"), (None, 0, 2.0, "predict"), ("a", 99, 5.0, "predict"), ("b", 9, 5.0, "predict")]
    tasks = spark.createDataFrame(rows, "s string, i int, g double, role string")
    out = {(r["s"], r["i"]): r for r in conformal.history_bands(tasks, F.col("role") == "calib", F.col("g"), F.col("g"), F.col("g"), 0.2, ["s"]).collect()}
    assert len(out) == len(rows) and out[None, 0]["t_hist"] == 0 and out[None, 0]["delta_lo"] == -math.inf and out["b", 9]["delta_hi"] == math.inf
    assert (out["a", 99]["t_hist"], out["a", 99]["delta_lo"], out["a", 99]["delta_hi"]) == (30, 0.0, 2.0)
    bands = {r["s"]: r for r in conformal.split_bands(tasks.where("role = 'calib'"), F.col("g"), F.col("g"), F.col("g"), 0.2, ["s"]).collect()}
    assert bands["a"]["delta_hi"] == 2.0 and bands["b"]["delta_lo"] == -math.inf and len(bands) == 2
    assert conformal.loo_bands(tasks.limit(0), F.col("g"), F.col("g"), F.col("g"), 0.2, ["s"]).count() == 0


def test_ranks_over_partitions(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 3000)
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(rng.random(3000) < 0.9, "hot", "cold"), "v": values, "i": np.arange(3000)})).repartition(6)
    got = conformal.with_ranks(df, ["v", "i"], ["k"]).toPandas()
    for _, part in got.groupby("k"):
        assert part.sort_values(["v", "i"])["rank"].tolist() == list(range(1, len(part) + 1))
    assert sorted(r["rank"] for r in conformal.with_ranks(df, ["i"]).collect()) == list(range(1, 3001))


# --- bootstrap


def pairs_of(spark, n=4000, kinds=3000):
    rng = np.random.default_rng(5)
    x = rng.integers(0, kinds, n) / kinds
    y = np.clip(x + rng.normal(0, 0.1, n), 0, 1)
    return x, y, spark.createDataFrame(pd.DataFrame({"k": "t", "x": x, "y": y})).repartition(5)


def test_split_draws_have_the_distribution_of_whole_ones(spark):
    x, y, df = pairs_of(spark)
    whole = bootstrap.grouped_intervals(df, ["k"], "x", "y", dict.fromkeys(bootstrap.TARGETS, 0.1), 1500, bootstrap.mean_of, F.count("*"))
    whole = {(r["target"], r["kind"]): r for r in whole.collect()}
    for chunk in (bootstrap.CHUNK, 100):
        got = {(r["target"], r["kind"]): r for r in bootstrap.bootstrap_intervals(df, ["k"], "x", "y", 0.1, 1500, chunk=chunk).collect()}
        assert set(got) == set(whole) and len(got) == 8
        for key, r in got.items():
            assert r["point"] == pytest.approx(whole[key]["point"], abs=1e-9)
            assert r["se"] == pytest.approx(whole[key]["se"], rel=0.12)
            assert (r["ci_lo"], r["ci_hi"]) == pytest.approx((whole[key]["ci_lo"], whole[key]["ci_hi"]), abs=0.35 * r["se"])
        assert got["paired_gap", "basic"]["se"] == pytest.approx((x - y).std() / math.sqrt(len(x)), rel=0.12)


def test_chunks_share_every_draw(spark):
    sizes = [7, 1, 500, 92, 0, 400]
    chunks = spark.createDataFrame([("t", c, n, sum(sizes)) for c, n in enumerate(sizes)] + [("u", 0, 5, 5)], "k string, chunk long, n_chunk long, n long")
    got = {(r["k"], r["chunk"]): np.array(r["draws"]).reshape(2, -1) for r in bootstrap.chunk_draws(chunks, ["k"], ["real", "synth"], 4000).collect()}
    assert (sum(got["t", c] for c in range(6)) == sum(sizes)).all() and (got["u", 0] == 5).all() and (got["t", 4] == 0).all()
    assert got["t", 2].mean() == pytest.approx(500, rel=0.01) and got["t", 2].std() == pytest.approx(math.sqrt(1000 * 0.25), rel=0.05)
    assert np.corrcoef(got["t", 2][0], got["t", 5][0])[0, 1] == pytest.approx(-math.sqrt(0.5 * 0.4 / (0.5 * 0.6)), abs=0.05)


@pytest.mark.parametrize("q", [0.1, 0.5, 0.75])
def test_drawn_ranks_agree_with_resampling(spark, q):
    x, y, df = pairs_of(spark, 900)
    got = {(r["target"], r["kind"]): r for r in bootstrap.bootstrap_intervals(df, ["k"], "x", "y", 0.1, 3000, q).collect()}
    assert set(got) == {(t, k) for t in bootstrap.TARGETS[:3] for k in bootstrap.KINDS}
    rng = np.random.default_rng(9)
    for target, values in (("real", x), ("synth", y)):
        draws = np.quantile(rng.choice(values, (3000, len(values))), q, axis=1)
        r = got[target, "percentile"]
        assert r["point"] == pytest.approx(np.quantile(values, q)) and r["se"] == pytest.approx(draws.std(), rel=0.12)
        assert (r["ci_lo"], r["ci_hi"]) == pytest.approx(tuple(np.quantile(draws, [0.05, 0.95])), abs=0.3 * r["se"])
    gap = got["gap", "percentile"]
    assert gap["point"] == pytest.approx(np.quantile(x, q) - np.quantile(y, q)) and gap["se"] == pytest.approx(math.hypot(got["real", "basic"]["se"], got["synth", "basic"]["se"]), rel=0.12)
    with pytest.raises(ValueError):
        bootstrap.bootstrap_intervals(df, ["k"], "x", "y", 0.1, 10, 1.5)


def test_resampled_ranks_of_one_row_and_counted_pairs(spark):
    low, high, part = bootstrap.resampled_ranks(1, 0.5, 20, np.random.default_rng(1))
    assert set(low) == set(high) == {1} and part == 0
    _, _, df = pairs_of(spark, 500, 20)
    df = df.withColumn("y", F.round("y", 1))
    counted = df.groupBy("k", "x", "y").agg(F.count("*").alias("n"))
    a, b = (sorted(map(tuple, bootstrap.bootstrap_intervals(d, ["k"], "x", "y", {"synth": 0.1, "paired_gap": 0.3}, 200, count=c).collect())) for d, c in ((df, None), (counted, "n")))
    assert [r[:3] for r in a] == [r[:3] for r in b] and {r[1] for r in a} == {"synth", "paired_gap"}
    assert all(r[3:] == pytest.approx(t[3:]) for r, t in zip(a, b, strict=True))
    plain, table = moments.paired_stats(df, ["k"], "x", "y").first(), moments.counted_stats(counted, ["k"], "x", "y", "n").first()
    assert all(table[c] == pytest.approx(plain[c]) for c in plain.asDict())
    widest = bootstrap.bootstrap_intervals(df, ["k"], "x", "y", 0.1, 50, lambda values, counts: np.array([values[c > 0].max() for c in counts]))
    assert widest.where("target = 'real' and kind = 'percentile'").first()["point"] == df.agg(F.max("x")).first()[0]
    with pytest.raises(ValueError):
        bootstrap.bootstrap_intervals(counted, ["k"], "x", "y", 0.1, 10, 0.5, count="n")


# --- weighted moments


@pytest.mark.parametrize("at", [0.0, 1e9])
def test_weighted_cells_in_one_pass(spark, at):
    rng = np.random.default_rng(3)
    n = 5000
    df = pd.DataFrame({"c": rng.integers(0, 7, n), "r": rng.choice(["n", "s"], n), "x": at + rng.normal(0, 1, n), "y": at + 1 + rng.normal(0, 2, n), "w": rng.random(n) + 0.1})
    rows = spark.createDataFrame(df).repartition(6)
    holes = spark.createDataFrame([(None, "n", 1.0, 1.0, 1.0), (1, "n", None, 1.0, 1.0)], "c long, r string, x double, y double, w double")
    got = {(r["c"], r["r"]): r for r in moments.weighted_cells(rows.unionByName(holes), ["c", "r"], "x", "y", "w").collect()}
    assert len(got) == 14
    for (c, r), part in df.groupby(["c", "r"]):
        w, y, d = part["w"].to_numpy(), part["y"].to_numpy(), (part["x"] - part["y"]).to_numpy()
        mean = lambda v: at + ((v - at) * w).sum() / w.sum()  # noqa: B023, E731
        se = lambda v: math.sqrt((w**2 * (v - v.mean() - ((v - v.mean()) * w).sum() / w.sum()) ** 2).sum()) / w.sum()  # noqa: B023, E731
        row = got[c, r]
        assert row["n"] == len(part) and row["synth"] == pytest.approx(mean(y), rel=1e-14) and row["theta"] == pytest.approx(mean(part["x"].to_numpy()), rel=1e-14)
        assert row["gap_se"] == pytest.approx(se(d), rel=1e-6) and row["synth_se"] == pytest.approx(se(y), rel=1e-6) and row["n_eff"] == pytest.approx(w.sum() ** 2 / (w**2).sum())
    assert moments.weighted_cells(rows.limit(0), ["c", "r"], "x", "y", "w").count() == 0


# --- players


def league(spark, players, opponents, seed=4, each=6):
    rng = np.random.default_rng(seed)
    strength = rng.normal(0, 0.7, players)
    a = np.repeat(np.arange(players), opponents)
    b = (a + rng.integers(1, players, len(a))) % players
    p = 1 / (1 + np.exp(strength[b] - strength[a]))
    wins = lambda tilt: (rng.random((len(a), each)) < (p + tilt * 0.1 * (1 - p))[:, None])
    y, auto = wins(0), wins(1)
    flat = pd.DataFrame({"a": np.repeat(a, each), "b": np.repeat(b, each), "y": y.ravel().astype(float), "y_auto": auto.ravel().astype(float)})
    return bt.pair_stats(spark.createDataFrame(flat)), strength


def test_frames_of_all_columns_equal_single_fits(spark):
    pairs, _ = league(spark, 25, 8)
    tasks = spark.createDataFrame([(i,) for i in range(3, 25)], "player long")
    rows = pairs.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("y")).alias("w"), F.sum("n").alias("n")).toPandas()
    start = {r["player"]: r["score"] for r in bt.joint_scores(pairs, 0).collect()}
    expected = {}
    for held in range(3, 25):
        others = np.array([i for i in range(25) if i != held])
        left = rows[(rows["a"] != held) & (rows["b"] != held)]
        fit = bt.fit_scores(others, left["a"], left["b"], left["w"].to_numpy(float), left["n"].to_numpy(float), 0, np.array([start[i] for i in others]))
        expected |= {(held, i): s for i, s in zip(others.tolist(), fit, strict=True)}
    expected |= {(77, i): s for i, s in start.items()}  # in no battle
    frame = bt.frames(pairs, tasks.union(spark.range(77, 78)), 0)
    for found in (frame, bt.frames(pairs, tasks.limit(3).union(spark.range(77, 78)), 0, at_once=0)):
        got = {(r["held_out"], r["player"]): r["score"] for r in found.collect()}
        assert all(got[k] == pytest.approx(expected[k], abs=1e-7) for k in got)
    assert set(expected) == {(r["held_out"], r["player"]) for r in frame.collect()}
    sides = bt.oriented(pairs)
    a, b = ({(r["held_out"], r["player"]): tuple(r)[2:] for r in bt.placements(sides, frame, tasks, 10, at_once).collect()} for at_once in (4_000_000, 0))
    assert set(a) == set(b) and len(a) == 22 * 22
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-8), k


def test_two_thousand_players_are_left_out(spark):
    pairs, strength = league(spark, 2000, 10, each=3)
    held = spark.createDataFrame([(i,) for i in range(1, 2000)], "player long")
    frame = written(bt.frames(pairs, held, 0), "frames")
    found = frame.groupBy("held_out").agg(F.count("*").alias("n"), F.sum("score").alias("s")).toPandas()
    assert len(found) == 1999 and (found["n"] == 1999).all()
    joint = {r["player"]: r["score"] for r in bt.joint_scores(pairs, 0, at_once=3000).collect()}
    one = frame.where("held_out = 7").toPandas()
    assert np.corrcoef(one["score"], [joint[i] for i in one["player"]])[0, 1] > 0.99
    placed = bt.placements(bt.oriented(pairs), frame.where("held_out < 40"), held.where("player < 40")).toPandas()
    assert len(placed) == 39 * 39 and np.corrcoef(placed["truth"], strength[placed["player"]])[0, 1] > 0.8


# --- record files


def records(spark, algo, n=40):
    return methods.run(spark.createDataFrame(made(n), STATS), algo, 0.2, mode="loo", clip=(0.0, 1.0))


def test_records_are_replaced_set_by_set(spark, tmp_path):
    path = str(tmp_path / "r")
    both = records(spark, "alg1").withColumn("note", F.lit("x")).unionByName(records(spark, "alg3"), allowMissingColumns=True)
    for _ in range(2):
        io.write_records(both, path, "app", "def")
    assert io.read_records(spark, path).count() == 80
    sets = {r["algo"]: list(r["columns"]) for r in io.read_manifest(spark, path).collect()}
    assert "note" in sets["alg1"] and "note" not in sets["alg3"]
    io.write_records(records(spark, "alg3", 7), path, "app", "def")
    assert {r["algo"]: r["count"] for r in io.read_records(spark, path).groupBy("algo").count().collect()} == {"alg1": 40, "alg3": 7}
    assert {r["algo"]: r["n"] for r in io.read_manifest(spark, path).collect()} == {"alg1": 40, "alg3": 7}
    broken = records(spark, "alg1", 9).withColumn("w1", F.when(F.col("task_id") != "", F.raise_error(F.lit("lost"))).cast("double"))
    with pytest.raises(Exception, match="lost"):
        io.write_records(broken, path, "app", "def")
    assert io.read_records(spark, path).count() == 47


# --- grid allocation, names


@pytest.mark.parametrize("n", [3, 105, 20_000])
def test_levels_of_many_lines(spark, n):
    rng = np.random.default_rng(n)
    gap, se = np.round(rng.standard_cauchy(n), 2), rng.choice([0.0, 0.01, 0.3, 2.0], n) * rng.integers(1, 3, n)
    tasks = written(spark.createDataFrame(pd.DataFrame({"gap": gap, "gap_se": se})).repartition(5), "lines")
    slope = np.concatenate([-rng.random(12) * 4, rng.random(12) * 4, [0.0]])
    k = rng.integers(1, n + 1, len(slope))
    k[:2] = 1, n
    got = allocation.levels_of(tasks, slope, k)
    for (x, after), s, r in zip(got, slope, k, strict=True):
        ordered = np.sort(gap + s * se)
        assert (x, after) == (ordered[r - 1], ordered[min(r, n - 1)])


def test_grid_of_many_tasks(spark):
    rng = np.random.default_rng(6)
    n = 3000
    stats = pd.DataFrame({"task_id": [f"t{i}" for i in range(n)], "n": 10, "theta": rng.random(n), "synth": rng.random(n), "synth_se": rng.random(n) / 9, "gap": rng.normal(0, 0.1, n), "gap_se": rng.random(n) / 9})
    got = allocation.grid_intervals(spark.createDataFrame(stats), 0.1, 5).toPandas().set_index("task_id")
    points = np.array(allocation.grid_points(0.1, n - 1, 5))
    gap, se = stats["gap"].to_numpy(), stats["gap_se"].to_numpy()
    for i in rng.integers(0, n, 40):
        others = np.arange(n) != i
        widths = [2 * p[5] * stats["synth_se"][i] + np.sort((gap + p[6] * se)[others])[int(p[8]) - 1] - np.sort((gap - p[6] * se)[others])[int(p[7]) - 1] for p in points]
        row = got.loc[f"t{i}"]
        assert row["w_synth"] + row["w_band"] == pytest.approx(min(widths), abs=1e-12) and row["alpha3"] == points[int(np.argmin(widths)), 4]
    assert allocation.grid_intervals(spark.createDataFrame(stats[:5]), 0.1).count() == 0


def test_ten_thousand_names(spark):
    rng = np.random.default_rng(8)
    names = {f"n{''.join(rng.choice(list('abé-1'), rng.integers(1, 7)))}": f"<{i}>" for i in range(10_000)}
    texts = ["".join(rng.choice(list("nabé-1 "), 300)) for _ in range(40)] + [None, "", "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    pattern = re.compile("|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)))
    listed = spark.createDataFrame(list(names.items()), "name string, alias string")
    for given in (names, listed):
        assert {r["id"]: r["t"] for r in deident.replace_in_text(df, "t", given).collect()} == {i: t and pattern.sub(lambda m: names[m[0]], t) for i, t in enumerate(texts)}
    assert {(r["id"], r["name"]): r["n"] for r in deident.leaks(df, "id", "t", listed).collect()} == {(i, n): t.count(n) for i, t in enumerate(texts) if t for n in names if n in t}
    assert deident.leaks(df, "id", "t", []).count() == 0 and deident.replace_in_text(df, "t", {}).count() == len(texts)


def test_splits_as_functions(spark):
    def thirds(t, alpha):
        return alpha / 10, alpha / 5, 0.7 * alpha if t > 10 else alpha / 2

    tasks = spark.createDataFrame(made(40), STATS)
    named, given = (methods.run(tasks, "alg1", 0.2, alloc, mode="loo") for alloc in ("prop_127", thirds))
    a, b = ({r["task_id"]: (r["ci_lo"], r["ci_hi"]) for r in d.collect()} for d in (named, given))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a) and {r["alloc"] for r in given.collect()} == {"thirds"}
    small = methods.run(tasks.limit(8), "alg1", 0.2, thirds, mode="loo").first()
    assert small["alpha3"] == 0.1
    with pytest.raises(ValueError):
        methods.run(tasks, "alg1", 0.2, lambda t, alpha: (0.0, 0.1, 0.1), mode="loo")
