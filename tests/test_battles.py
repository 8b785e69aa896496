import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthcal.operators import bradley_terry as bt
from synthcal.operators import bootstrap


def made(spark, players="abcde", n=600, seed=2):
    rng = random.Random(seed)
    strength = {p: i * 0.4 for i, p in enumerate(players)}
    rows = []
    for _ in range(n):
        a, b = rng.sample(players, 2)
        y = rng.choices([1.0, 0.0, 0.5], [1 / (1 + math.exp(strength[b] - strength[a])), 1 / (1 + math.exp(strength[a] - strength[b])), 0.2])[0]
        rows.append((a, b, y, y if rng.random() < 0.8 else 1 - y))
    return rows, spark.createDataFrame(rows, "a string, b string, y double, y_auto double")


def loss(rows, s):
    return sum(-(y * -math.log1p(math.exp(-(s[a] - s[b]))) + (1 - y) * -math.log1p(math.exp(s[a] - s[b]))) for a, b, y, _ in rows)


def test_joint_fit_is_the_optimum(spark):
    rows, battles = made(spark)
    s = {r["player"]: r["score"] for r in bt.joint_scores(bt.pair_stats(battles), "c").collect()}
    assert s["c"] == 0
    for p in s:
        if p != "c":
            wins = sum((y if a == p else 1 - y) - 1 / (1 + math.exp(-(s[p] - s[b if a == p else a]))) for a, b, y, _ in rows if p in (a, b))
            assert wins == pytest.approx(0, abs=1e-6)
    best = loss(rows, s)
    for p in "abde":
        assert loss(rows, s | {p: s[p] + 0.01}) > best < loss(rows, s | {p: s[p] - 0.01})


def test_reference_must_be_in_a_battle(spark):
    _, battles = made(spark)
    pairs = bt.pair_stats(battles)
    tasks = spark.createDataFrame([("d",)], "player string")
    for fit in (bt.joint_scores(pairs, "a"), bt.frames(pairs, tasks, "a")):
        assert fit.count() > 0
    for broken in (lambda: bt.joint_scores(pairs, "zz"), lambda: bt.frames(pairs, tasks, "zz"), lambda: bt.iterated_scores(pairs.groupBy("a", "b").agg(F.sum("y").alias("w"), F.sum("n").alias("n")), "zz")):
        with pytest.raises(Exception, match="in no battle"):
            broken().collect()
    assert bt.reference_of(pairs) == "a"


def test_players_without_rows_stay_in_the_frame(spark):
    rows, battles = made(spark)
    battles = battles.union(spark.createDataFrame([("e", "x", 1.0, 1.0), ("x", "e", 1.0, 0.0), ("e", "x", 1.0, 1.0)], battles.schema))
    pairs = bt.pair_stats(battles)
    full = {r["player"]: r["score"] for r in bt.joint_scores(pairs, "a").collect()}
    tasks = spark.createDataFrame([("e",), ("d",)], "player string")
    frame = bt.frames(pairs, tasks, "a")
    score = {(r["held_out"], r["player"]): r["score"] for r in frame.collect()}
    assert score["e", "x"] == pytest.approx(full["x"]) and len(score) == 10
    placed = {(r["held_out"], r["player"]): r["n"] for r in bt.placements(bt.oriented(pairs), frame, tasks).collect()}
    assert placed["e", "e"] == sum("e" in (r[0], r[1]) for r in rows) + 3


def test_iterated_fit_equals_the_fit_in_one_worker(spark):
    _, battles = made(spark, n=300)
    pairs = bt.pair_stats(battles)
    small = {r["player"]: r["score"] for r in bt.joint_scores(pairs, "c").collect()}
    large = {r["player"]: r["score"] for r in bt.joint_scores(pairs, "c", at_once=2).collect()}
    assert small == pytest.approx(large, abs=1e-6) and large["c"] == 0


def test_placement_equals_row_by_row_newton():
    rng = np.random.default_rng(0)
    c, y = rng.normal(size=200), rng.integers(0, 2, 200).astype(float)
    (b,), (se,) = bt.place(y[None], np.ones((1, 200)), c)
    p = 1 / (1 + np.exp(-(b - c)))
    assert (y - p).sum() - bt.RIDGE * b == pytest.approx(0, abs=1e-8)
    assert se == pytest.approx(1 / math.sqrt((p * (1 - p)).sum() + bt.RIDGE))


def test_frames_placements_and_ranks(spark):
    rows, battles = made(spark)
    pairs = bt.pair_stats(battles)
    tasks = spark.createDataFrame([("d",), ("e",), ("b",)], "player string")
    frame = bt.frames(pairs, tasks, "a").cache()
    score = {(r["held_out"], r["player"]): r["score"] for r in frame.collect()}
    assert all(h != p for h, p in score) and len(score) == 12
    placed = {(r["held_out"], r["player"]): r for r in bt.placements(bt.oriented(pairs), frame, tasks, 30).collect()}
    assert len(placed) == 9
    # a player placed against a frame that was fitted with it stays where it was
    assert placed["d", "e"]["truth"] == pytest.approx(score["d", "e"], abs=1e-4)
    assert placed["d", "d"]["gap_se"] is None and placed["d", "e"]["gap_se"] > 0
    assert placed["d", "e"]["n"] == sum(1 for a, b, *_ in rows if "e" in (a, b) and "d" not in (a, b))
    again = {(r["held_out"], r["player"]): r["gap_se"] for r in bt.placements(bt.oriented(pairs.repartition(5)), frame, tasks, 30).collect()}
    assert again == {k: r["gap_se"] for k, r in placed.items()}
    for algo in ("alg1", "alg4", "synth_only"):
        for r in bt.intervals(bt.placements(bt.oriented(pairs), frame, tasks, 30), frame, algo, 0.9).collect():
            field = [s for (h, _), s in score.items() if h == r["player"]]
            assert (r["rank"], r["rank_lo"], r["rank_hi"]) == tuple(1 + sum(s > x for s in field) for x in (r["theta"], r["ci_hi"], r["ci_lo"]))
            assert r["n_models"] == 5 and r["elo_lo"] == pytest.approx(400 / math.log(10) * r["ci_lo"])


def test_win_rates_from_counts(spark):
    rows, battles = made(spark, n=200)
    got = {r["task_id"]: r for r in bt.win_rates(bt.oriented(bt.pair_stats(battles))).collect()}
    for p, r in got.items():
        d = [(y - v) if a == p else (v - y) for a, b, y, v in rows if p in (a, b)]
        assert r["n_real"] == len(d) and r["gap"] == pytest.approx(np.mean(d)) and r["gap_se"] == pytest.approx(np.std(d, ddof=1) / math.sqrt(len(d)))


def test_order_and_split(spark):
    players = spark.createDataFrame([("z", None), ("a", "2026-02-01"), ("b", "2026-01-01"), ("c", "2026-01-01")], "player string, date string")
    assert [r["player"] for r in bt.order_players(players, None).orderBy("place").collect()] == ["b", "c", "a", "z"]
    listed = bt.order_players(players.select("player"), spark.createDataFrame([("z", 0), ("c", 1)], "player string, pos int"))
    assert [r["player"] for r in listed.orderBy("place").collect()] == ["z", "c", "a", "b"]
    roles = {r["player"]: r["role"] for r in bt.split_players(listed, "b", 2).collect()}
    assert roles == {"z": "background", "b": "background", "c": "task", "a": "task"}


def test_bootstrap_agrees_with_the_normal_interval(spark):
    rng = np.random.default_rng(4)
    rows = [("g", float(x), float(y)) for x, y in zip(rng.integers(0, 5, 800), rng.integers(0, 4, 800), strict=True)]
    got = {(r["target"], r["kind"]): r for r in bootstrap.bootstrap_intervals(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", 0.1, 2000).collect()}
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for target, se in (("real", x.std(ddof=1)), ("gap", math.hypot(x.std(ddof=1), y.std(ddof=1))), ("paired_gap", (x - y).std(ddof=1))):
        assert got[target, "percentile"]["se"] == pytest.approx(se / math.sqrt(800), rel=0.08)
        a, b = got[target, "percentile"], got[target, "basic"]
        assert a["ci_lo"] + b["ci_hi"] == pytest.approx(2 * a["point"]) and a["ci_lo"] < a["point"] < a["ci_hi"]


def test_weighted_median_equals_numpy():
    rng = np.random.default_rng(1)
    values = np.sort(rng.normal(size=9))
    counts = rng.integers(1, 5, size=(3, 9))
    for q in (0.1, 0.5, 0.9):
        expected = [np.quantile(np.repeat(values, c), q) for c in counts]
        assert bootstrap.quantile_of(q)(values, counts) == pytest.approx(expected)


def test_poisson_means(spark):
    df = spark.range(4000).selectExpr("id", "'g' as k", "id % 10 as v")
    means = [r["mean"] for r in bootstrap.poisson_means(df, ["k"], "id", "v", 60).collect()]
    assert np.mean(means) == pytest.approx(4.5, abs=0.03) and np.std(means) == pytest.approx(math.sqrt(8.25 / 4000), rel=0.3)
    again = [r["mean"] for r in bootstrap.poisson_means(df.repartition(9), ["k"], "id", "v", 60).collect()]
    assert sorted(again) == pytest.approx(sorted(means))
