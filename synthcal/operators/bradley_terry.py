"""Bradley-Terry scores from battles.

The likelihood needs counts and outcome sums per ordered pair only, so battles are aggregated first (one shuffle of partial
sums) and everything after it is of the size of the players' pairs. Joint fits, leave-one-player-out frames, placements and
their bootstrap run in grouped workers over these counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthcal.functions.expressions import covers
from synthcal.functions.levels import ALLOCATIONS, ELO_SCALE, z
from synthcal.operators.conformal import split_bands, with_ranks
from synthcal.sources.scratch import written

#: Ridge towards 0, longest Newton step, its tolerance and the rounds of a placement and of a replicate's.
RIDGE = 1e-6
LONGEST, TOLERANCE, ROUNDS, REPLICATE_ROUNDS = 4.0, 1e-10, 60, 40


def pair_stats(battles: DataFrame) -> DataFrame:
    """a, b, y, y_auto, n: battles of an ordered pair with the same outcomes."""
    rows = battles.na.drop(subset=["a", "b", "y", "y_auto"])
    return rows.groupBy("a", "b", "y", "y_auto").agg(F.count("*").alias("n"))


def oriented(pairs: DataFrame) -> DataFrame:
    """player, opponent, y, y_auto, n from either side. Aggregated rows are doubled, not battles."""
    sides = F.array(F.struct(F.col("a").alias("player"), F.col("b").alias("opponent"), F.col("y"), F.col("y_auto")), F.struct(F.col("b").alias("player"), F.col("a").alias("opponent"), (1 - F.col("y")).alias("y"), (1 - F.col("y_auto")).alias("y_auto")))
    return pairs.select("n", F.explode(sides).alias("s")).groupBy("s.player", "s.opponent", "s.y", "s.y_auto").agg(F.sum("n").alias("n"))


def participants(battles: DataFrame) -> DataFrame:
    return battles.select(F.col("a").alias("player")).union(battles.select(F.col("b").alias("player"))).distinct()


def win_rates(sides: DataFrame) -> DataFrame:
    """Paired statistics of each player's outcomes, from aggregated counts: the columns that the methods expect."""
    n, d = F.sum("n"), F.col("y") - F.col("y_auto")
    weighted = lambda v: F.sum(F.col("n") * v)
    means = sides.groupBy("player").agg(n.alias("n_real"), (weighted(F.col("y")) / n).alias("theta"), (weighted(F.col("y_auto")) / n).alias("synth"), (weighted(d) / n).alias("gap"))
    around = sides.join(means, "player").groupBy("player").agg(weighted((F.col("y_auto") - F.col("synth")) ** 2).alias("vs"), weighted((d - F.col("gap")) ** 2).alias("vd"))
    rows = means.join(around, "player")
    se = lambda v: F.when(F.col("n_real") > 1, F.sqrt(F.col(v) / (F.col("n_real") - 1) / F.col("n_real"))).otherwise(F.lit(0.0))
    return rows.select(F.col("player").cast("string").alias("task_id"), "n_real", F.col("n_real").alias("n_synth"), "theta", "synth", se("vs").alias("synth_se"), "gap", se("vd").alias("gap_se"))


def order_players(players: DataFrame, curated: DataFrame | None, name: str = "player") -> DataFrame:
    """Players with their place: curated order first, then by name; without a list by date (missing last), then name.

    ``players`` may have a ``date`` column; ``curated`` has name and pos.
    """
    if curated is not None:
        rows = players.join(curated, name, "left")
        order = [F.asc_nulls_last("pos"), F.asc(name)]
    else:
        rows, order = players, [F.asc_nulls_last("date"), F.asc(name)]
    return with_ranks(rows, order, name="place").withColumn("place", F.col("place").cast("int"))


def split_players(ordered: DataFrame, reference, m: int, name: str = "player") -> DataFrame:
    """role: background for the reference and the first m - 1 others, task for the rest."""
    first = ordered.where(F.col(name) == F.lit(reference)).agg(F.min("place")).first()[0]
    others = F.col("place") - F.when(F.col("place") > F.lit(first), 1).otherwise(0)
    return ordered.withColumn("role", F.when((F.col(name) == F.lit(reference)) | (others <= m - 1), "background").otherwise("task"))


def reference_of(pairs: DataFrame):
    """The smallest player: a reference that every table of battles has."""
    return pairs.agg(F.min(F.least("a", "b"))).first()[0]


def fit_scores(players: np.ndarray, a: np.ndarray, b: np.ndarray, wins: np.ndarray, n: np.ndarray, reference, start: np.ndarray | None = None, rounds: int = 200, tol: float = 1e-11) -> np.ndarray:
    """Joint maximum likelihood by Newton steps with the reference at 0; players without battles keep their start.

    A reference that is none of the players is an error: without it the scores have no level.
    """
    at = {p: i for i, p in enumerate(players)}
    if reference not in at:
        raise ValueError(f"reference {reference!r} is in no battle")
    ia, ib = np.array([at[x] for x in a], dtype=int), np.array([at[x] for x in b], dtype=int)
    seen = np.zeros(len(players), bool)
    seen[ia] = seen[ib] = True
    free = np.array([i for i, p in enumerate(players) if p != reference and seen[i]])
    score = np.zeros(len(players)) if start is None else np.array(start, dtype=float)
    score[at[reference]] = 0.0
    if not len(free):
        return score

    def loss(x: np.ndarray) -> float:
        d = x[ia] - x[ib]
        return float((wins * np.logaddexp(0, -d) + (n - wins) * np.logaddexp(0, d)).sum())

    now = loss(score)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(score[ia] - score[ib])))
        g = np.bincount(ia, wins - n * p, len(players)) - np.bincount(ib, wins - n * p, len(players))
        h = np.zeros((len(players), len(players)))
        w = n * p * (1 - p)
        np.add.at(h, (ia, ia), w)
        np.add.at(h, (ib, ib), w)
        np.add.at(h, (ia, ib), -w)
        np.add.at(h, (ib, ia), -w)
        step = np.zeros(len(players))
        step[free] = np.linalg.solve(h[np.ix_(free, free)] + 1e-12 * np.eye(len(free)), g[free])
        size = 1.0
        while size > 1e-6 and loss(score + size * step) > now + 1e-12 * abs(now):
            size /= 2
        score = score + size * step
        now = loss(score)
        if np.abs(step).max() < tol:
            break
    return score


def place(wins: np.ndarray, n: np.ndarray, c: np.ndarray, start: np.ndarray | float = 0.0, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """One-parameter placements against fixed opponents, vectorised over leading rows: (score, standard error)."""
    b = np.zeros(wins.shape[0]) + start
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-(b[:, None] - c)))
        step = np.clip((RIDGE * b - (wins - n * s).sum(axis=1)) / ((n * s * (1 - s)).sum(axis=1) + RIDGE), -LONGEST, LONGEST)
        b = b - step
        if np.abs(step).max(initial=0) < TOLERANCE:
            break
    s = 1 / (1 + np.exp(-(b[:, None] - c)))
    return b, 1 / np.sqrt((n * s * (1 - s)).sum(axis=1) + RIDGE)


def coded_pairs(pairs: DataFrame) -> tuple[DataFrame, list]:
    """(ia, ib, w, n) of each ordered pair by the players' numbers, written, and the players in order: a few bytes per player."""
    totals = written(pairs.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("y")).alias("w"), F.sum("n").alias("n")), "pair-totals")
    players = [r["player"] for r in participants(totals).orderBy("player").collect()]
    code = totals.sparkSession.createDataFrame(list(enumerate(players)), f"i int, player {dict(totals.dtypes)['a']}")
    coded = totals.join(code.select(F.col("player").alias("a"), F.col("i").alias("ia")), "a").join(code.select(F.col("player").alias("b"), F.col("i").alias("ib")), "b")
    return written(coded.select("ia", "ib", F.col("w").cast("double"), F.col("n").cast("double")), "coded-pairs"), players


class PairArrays:
    """Pairs sorted by their first player, with sums per player over many columns at once; a column leaves one player out."""

    def __init__(self, ia: np.ndarray, ib: np.ndarray, w: np.ndarray, n: np.ndarray, held: np.ndarray, k: int):
        order = np.argsort(ia, kind="stable")
        self.ia, self.ib, self.w, self.n, self.k = ia[order], ib[order], w[order][:, None], n[order][:, None], k
        self.by_b = np.argsort(self.ib, kind="stable")
        self.starts_a, self.starts_b = (np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, int) for x in (self.ia, self.ib[self.by_b]))
        self.mask(held)

    def mask(self, held: np.ndarray) -> None:
        """The places (pair, column) where a pair belongs to the player that the column leaves out."""
        column_of = np.full(self.k, -1)
        column_of[held[held >= 0]] = np.flatnonzero(held >= 0)
        rows, columns = (np.concatenate([x, y]) for x, y in zip(*((np.flatnonzero(column_of[i] >= 0), column_of[i][column_of[i] >= 0]) for i in (self.ia, self.ib)), strict=True))
        self.out_rows, self.out_columns = rows, columns

    def total(self, v: np.ndarray, sign: int) -> np.ndarray:
        """Sums of ``v`` over the pairs of each player, those where it is second with the sign."""
        out = np.zeros((self.k, v.shape[1]))
        if len(v):
            out[self.ia[self.starts_a]] += np.add.reduceat(v, self.starts_a, axis=0)
            out[self.ib[self.by_b][self.starts_b]] += sign * np.add.reduceat(v[self.by_b], self.starts_b, axis=0)
        return out

    def curvature(self, score: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(score[self.ia] - score[self.ib])))
        h = self.n * p * (1 - p)
        h[self.out_rows, self.out_columns] = 0.0
        return h

    def slope(self, score: np.ndarray) -> np.ndarray:
        v = self.w - self.n / (1 + np.exp(-(score[self.ia] - score[self.ib])))
        v[self.out_rows, self.out_columns] = 0.0
        return v

    def product(self, h: np.ndarray, along: np.ndarray) -> np.ndarray:
        return self.total(h * (along[self.ia] - along[self.ib]), -1)


def newton_columns(start: np.ndarray, free: np.ndarray, local: Callable, rounds: int = 200, tol: float = 1e-11) -> np.ndarray:
    """Scores of many fits at once, a column each, by Newton steps whose systems are solved by conjugate gradients.

    ``local(scores)`` gives the log-likelihoods' slopes there, the Hessians' diagonals and a function that multiplies columns
    with the Hessians. Steps beyond LONGEST are shortened. What is not ``free`` keeps its start; so does a player without
    battles in a column.
    """
    score = start.copy()
    ridge = 1e-12
    for _ in range(rounds):
        g, diagonal, times = local(score)
        g = np.where(free, g, 0.0)
        scale = np.where(free, 1 / np.maximum(diagonal + ridge, ridge), 0.0)
        step, left = np.zeros_like(g), g.copy()
        along = scale * left
        power = (left * along).sum(axis=0)
        first, active = power.copy(), power > 0
        for _ in range(4 * len(g)):
            if not active.any():
                break
            product = np.where(free, times(along), 0.0) + ridge * along
            size = np.where(active, power / np.maximum((along * product).sum(axis=0), 1e-300), 0.0)
            step, left = step + size * along, left - size * product
            old, power = power, (left * scale * left).sum(axis=0)
            active &= power > 1e-13 * first
            along = np.where(active, scale * left + np.where(active, power / np.maximum(old, 1e-300), 0.0) * along, 0.0)
        step = np.clip(step, -LONGEST, LONGEST)
        score = score + step
        if np.abs(step).max(initial=0) < tol:
            break
    return score


def frames(pairs: DataFrame, held_out: DataFrame, reference, at_once: int = 4_000_000) -> DataFrame:
    """held_out, player, score: one fit per held-out player without its battles, over all other players.

    Fits start from the scores of all battles, and a player who met only the held-out one keeps that start; a held-out player
    without battles leaves all of them in. The fits of many
    held-out players are columns over one table of pairs: no row of it is repeated for each of them. Up to ``at_once`` ordered
    pairs (a count, 32 bytes each) are broadcast and every task fits a share of the columns; beyond that the pairs stay where
    they are and every product is a pass over them (see :func:`passed_frames`). Both find the same optima.
    """
    spark, kind = pairs.sparkSession, dict(pairs.dtypes)["a"]
    coded, players = coded_pairs(pairs)
    at = {p: i for i, p in enumerate(players)}
    if reference not in at:
        raise ValueError(f"reference {reference!r} is in no battle")
    code = spark.createDataFrame(list(at.items()), f"player {kind}, i int")
    held = held_out.select("player").distinct().join(code, "player", "left").select("player", F.coalesce("i", F.lit(-1)).alias("i"))  # -1: in no battle
    if coded.count() > at_once:
        joint = np.zeros(len(players))
        for r in joint_scores(pairs, reference).collect():  # a number per player
            joint[at[r["player"]]] = r["score"]
        return passed_frames(coded, players, joint, [(r["player"], r["i"]) for r in held.collect()], at[reference], kind)
    found = coded.toPandas()  # at most at_once rows
    fixed, width = at[reference], max(1, min(64, 4_000_000 // max(1, len(found))))
    arrays = [found[c].to_numpy() for c in ("ia", "ib", "w", "n")]
    joint = fitted_columns(*arrays, np.zeros(len(players)), np.array([-1]), fixed)[:, 0]
    sent = spark.sparkContext.broadcast((*arrays, joint, players))

    def run(batches):
        ia, ib, w, n, start, names = sent.value
        names = pd.Series(names)
        for pdf in batches:
            for first in range(0, len(pdf), width):
                own, out = (pdf[c].to_numpy()[first : first + width] for c in ("player", "i"))
                score = fitted_columns(ia, ib, w, n, start, out, fixed)
                i, column = np.nonzero(np.arange(len(start))[:, None] != out)
                yield pd.DataFrame({"held_out": own[column], "player": names.take(i).to_numpy(), "score": score[i, column]})

    tasks = max(1, min(len(players), spark.sparkContext.defaultParallelism))
    return held.repartition(tasks).mapInPandas(run, f"held_out {kind}, player {kind}, score double")


def fitted_columns(ia, ib, w, n, start: np.ndarray, held: np.ndarray, fixed: int) -> np.ndarray:
    """players x held-out scores over pairs that fit in memory; a held-out number below 0 leaves no one out."""
    k = len(start)
    pairs = PairArrays(ia, ib, w, n, held, k)
    free = np.arange(k)[:, None] != held
    free[fixed] = False

    def local(score: np.ndarray):
        h = pairs.curvature(score)
        return pairs.total(pairs.slope(score), -1), pairs.total(h, 1), lambda along: pairs.product(h, along)

    return newton_columns(np.repeat(start[:, None], len(held), axis=1), free, local)


def passed_frames(coded: DataFrame, players: list, joint: np.ndarray, held: list[tuple], fixed: int, kind: str, numbers: int = 2_000_000) -> DataFrame:
    """The same over any number of pairs: gradients and products are passes over the written pairs with partial sums per
    player and column. The driver holds ``numbers`` scores at a time, as many columns as fit, and each batch is written."""
    spark, k = coded.sparkSession, len(joint)
    width, out = max(1, numbers // k), None
    for first in range(0, len(held), width):
        own = pd.Series([name for name, _ in held[first : first + width]])
        columns = np.array([i for _, i in held[first : first + width]], dtype=int)

        def summed(score: np.ndarray, along: np.ndarray | None, columns=columns) -> tuple[np.ndarray, np.ndarray]:
            sent = spark.sparkContext.broadcast((score, along))

            def run(batches):
                x, d = sent.value
                total = np.zeros((2, *x.shape))
                for pdf in batches:
                    step = max(1, 4_000_000 // x.shape[1])
                    for i in range(0, len(pdf), step):
                        part = pdf.iloc[i : i + step]
                        pairs = PairArrays(*(part[c].to_numpy() for c in ("ia", "ib", "w", "n")), columns, k)
                        h = pairs.curvature(x)
                        total[0] += pairs.total(pairs.slope(x), -1) if d is None else pairs.product(h, d)
                        total[1] += pairs.total(h, 1)
                i, j = np.nonzero(total[1])
                yield pd.DataFrame({"i": i, "j": j, "v": total[0, i, j], "h": total[1, i, j]})

            found = coded.mapInPandas(run, "i int, j int, v double, h double").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("h").alias("h")).toPandas()
            v, h = np.zeros(score.shape), np.zeros(score.shape)
            v[found["i"], found["j"]], h[found["i"], found["j"]] = found["v"], found["h"]
            sent.unpersist()
            return v, h

        others = np.arange(k)[:, None] != columns
        free = others & (np.arange(k) != fixed)[:, None]
        score = newton_columns(np.repeat(joint[:, None], len(columns), axis=1), free, lambda x: (*summed(x, None), lambda along: summed(x, along)[0]), tol=1e-9)
        keep = np.argwhere(others)
        names = pd.Series(players)
        part = spark.createDataFrame(pd.DataFrame({"held_out": own.take(keep[:, 1]).to_numpy(), "player": names.take(keep[:, 0]).to_numpy(), "score": score[keep[:, 0], keep[:, 1]]}), f"held_out {kind}, player {kind}, score double")
        part = written(part, "frames")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], f"held_out {kind}, player {kind}, score double")


def joint_scores(pairs: DataFrame, reference, at_once: int = 500) -> DataFrame:
    """player, score of all battles: in one worker for up to ``at_once`` players (the pair table has at most that squared
    rows), else by :func:`iterated_scores`; both find the same optimum."""
    kind = dict(pairs.dtypes)["a"]
    totals = pairs.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("y")).alias("w"), F.sum("n").alias("n"))
    totals = written(totals, "pair-totals")
    if participants(totals).count() > at_once:
        return iterated_scores(totals, reference)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        players = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]))
        return pd.DataFrame({"player": players, "score": fit_scores(players, pdf["a"], pdf["b"], pdf["w"].to_numpy(float), pdf["n"].to_numpy(float), reference)})

    return totals.groupBy(F.lit(0).alias("all")).applyInPandas(run, f"player {kind}, score double")


def iterated_scores(totals: DataFrame, reference, rounds: int = 500, tol: float = 1e-8) -> DataFrame:
    """The scores of many players by Newton steps whose linear systems are solved by conjugate gradients.

    ``totals`` is a table (a, b, w, n). Every product with the Hessian and every gradient is one pass over it with
    partial sums per player; the driver holds a few numbers per player and nothing per pair. ``rounds`` bounds the passes;
    more are an error.
    """
    spark = totals.sparkSession
    coded, players = coded_pairs(totals.withColumn("y", F.when(F.col("n") > 0, F.col("w") / F.col("n"))))
    at = {p: i for i, p in enumerate(players)}
    if reference not in at:
        raise ValueError(f"reference {reference!r} is in no battle")
    schema = f"player {dict(totals.dtypes)['a']}, i int"
    passes, k, fixed = 0, len(players), at[reference]

    def summed(score: np.ndarray, along: np.ndarray | None) -> np.ndarray:
        """The gradient at the scores, or the Hessian's product with ``along``, and the diagonal of the Hessian."""
        nonlocal passes
        passes += 1
        if passes > rounds:
            raise RuntimeError(f"scores did not settle in {rounds} passes")
        sent = spark.sparkContext.broadcast((score, along))  # numbers per player

        def run(batches):
            x, d = sent.value
            out = np.zeros((2, k))
            for pdf in batches:
                a, b = pdf["ia"].to_numpy(), pdf["ib"].to_numpy()
                p = 1 / (1 + np.exp(-(x[a] - x[b])))
                h = pdf["n"].to_numpy() * p * (1 - p)
                v = pdf["w"].to_numpy() - pdf["n"].to_numpy() * p if d is None else h * (d[a] - d[b])
                out[0] += np.bincount(a, v, k) - np.bincount(b, v, k)
                out[1] += np.bincount(a, h, k) + np.bincount(b, h, k)
            met = np.flatnonzero(out[1])
            yield pd.DataFrame({"i": met, "v": out[0, met], "h": out[1, met]})

        found = coded.mapInPandas(run, "i int, v double, h double").groupBy("i").agg(F.sum("v").alias("v"), F.sum("h").alias("h")).toPandas()
        out = np.zeros((2, k))
        out[:, found["i"]] = found[["v", "h"]].to_numpy().T
        out[0, fixed] = 0.0
        sent.unpersist()
        return out

    score = np.zeros(k)
    while True:
        g, diagonal = summed(score, None)
        scale = 1 / np.maximum(diagonal, 1e-12)
        step, left = np.zeros(k), g.copy()
        along, power = scale * left, float(left @ (scale * left))
        first = power
        while power > 1e-6 * first and power > 0:
            product = summed(score, along)[0]
            size = power / float(along @ product)
            step, left = step + size * along, left - size * product
            old, power = power, float(left @ (scale * left))
            along = scale * left + power / old * along
        score = score + np.clip(step, -LONGEST, LONGEST)
        if np.abs(step).max(initial=0) < tol:
            break
    return spark.createDataFrame([(p, float(x)) for p, x in zip(players, score, strict=True)], schema.replace("i int", "score double"))


def placements(sides: DataFrame, frame: DataFrame, tasks: DataFrame, draws: int = 0, at_once: int = 4_000_000) -> DataFrame:
    """For each held-out M and each task player j: truth, synth (with standard errors), n and the gap's error, by the bootstrap
    (if there are draws) and by the delta method.

    j = M uses all of M's battles; another j its battles without those against M. ``draws`` replicates resample a
    player's battles as counts over (opponent, outcomes), the same draw for both placements.

    All placements of one frame are found at once, from its scores and the task players' aggregated battles. Up to ``at_once``
    rows of these (a count, 40 bytes each) are broadcast, and a task needs nothing but frames; beyond that they are joined
    with the frames and grouped by both players.
    """
    kind = dict(sides.dtypes)["player"]
    own = written(sides.join(tasks.select("player").distinct(), "player", "left_semi"), "task-sides")
    schema = f"held_out {kind}, player {kind}, n long, truth double, truth_se double, synth double, synth_se double, gap_se double, gap_delta_se double"
    if own.count() > at_once:
        return joined_placements(own, frame, tasks, draws, schema)
    found = own.toPandas().sort_values(["player", "opponent", "y", "y_auto"])  # at most at_once rows
    names = np.unique(np.concatenate([found["player"].to_numpy(), found["opponent"].to_numpy()])) if len(found) else np.empty(0, object)
    columns = {"player": np.searchsorted(names, found["player"].to_numpy()), "opponent": np.searchsorted(names, found["opponent"].to_numpy()), **{c: found[c].to_numpy(float) for c in ("y", "y_auto", "n")}}
    sent = sides.sparkSession.sparkContext.broadcast((names, columns))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        players, battles = sent.value
        if not len(players):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        held, score = pdf["held_out"].iloc[0], np.full(len(players), np.nan)
        at = np.searchsorted(players, pdf["player"].to_numpy())
        known = (at < len(players)) & (players[np.minimum(at, len(players) - 1)] == pdf["player"].to_numpy())
        score[at[known]] = pdf["score"].to_numpy()[known]
        c = score[battles["opponent"]]
        met = ~np.isnan(c)
        part = {k: v[met] for k, v in battles.items()}
        segment, c, seen = part["player"], c[met], np.unique(part["player"])
        total = np.bincount(segment, part["n"], len(players))
        truth, truth_se = placed_segments(segment, part["n"] * part["y"], part["n"], c, len(players))
        synth, synth_se = placed_segments(segment, part["n"] * part["y_auto"], part["n"], c, len(players), truth)
        each = influence(truth[segment], truth_se[segment], part["y"], c) - influence(synth[segment], synth_se[segment], part["y_auto"], c)
        delta = np.sqrt(np.maximum(np.bincount(segment, part["n"] * each**2, len(players)) - np.bincount(segment, part["n"] * each, len(players)) ** 2 / np.maximum(total, 1), 0))
        gap_se = np.full(len(players), np.nan)
        if draws:
            for j, first, last in zip(seen, np.searchsorted(segment, seen), np.searchsorted(segment, seen, "right"), strict=True):
                if players[j] != held:
                    of = {k: part[k][first:last] for k in ("n", "y", "y_auto")}
                    gap_se[j] = gap_error(held, players[j], of["n"], of["y"], of["y_auto"], c[first:last], truth[j], synth[j], draws)
        return pd.DataFrame({"held_out": held, "player": players[seen], "n": total[seen].astype(np.int64), "truth": truth[seen], "truth_se": truth_se[seen], "synth": synth[seen], "synth_se": synth_se[seen], "gap_se": pd.Series(gap_se[seen]).astype(object).where(~np.isnan(gap_se[seen]), None), "gap_delta_se": delta[seen]})

    asked = frame.join(tasks.select(F.col("player").alias("held_out")).distinct(), "held_out", "left_semi")
    return asked.groupBy("held_out").applyInPandas(run, schema)  # a group is one frame: a row per player


def placed_segments(segment: np.ndarray, wins: np.ndarray, n: np.ndarray, c: np.ndarray, k: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """:func:`place` for ``k`` players at once whose battles are segments of the arrays."""
    b = np.zeros(k) if start is None else start.copy()
    for _ in range(ROUNDS):
        s = 1 / (1 + np.exp(-(b[segment] - c)))
        slope, curve = np.bincount(segment, wins - n * s, k), np.bincount(segment, n * s * (1 - s), k)
        step = np.clip((RIDGE * b - slope) / (curve + RIDGE), -LONGEST, LONGEST)
        b = b - step
        if np.abs(step).max(initial=0) < TOLERANCE:
            break
    s = 1 / (1 + np.exp(-(b[segment] - c)))
    return b, 1 / np.sqrt(np.bincount(segment, n * s * (1 - s), k) + RIDGE)


def influence(score: np.ndarray, se: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How far a battle moves a placement, to first order."""
    return (y - 1 / (1 + np.exp(-(score - c)))) * se**2


def gap_error(held, player, n: np.ndarray, y: np.ndarray, y_auto: np.ndarray, c: np.ndarray, truth: float, synth: float, draws: int) -> float:
    """The standard deviation of a gap over resampled battles; the seed comes from both players' names."""
    rng = np.random.default_rng(zlib.crc32(f"{held}\x1f{player}".encode()))
    m = rng.multinomial(int(n.sum()), n / n.sum(), size=draws).astype(float)
    return float(np.std(place(m * y, m, c, truth, REPLICATE_ROUNDS)[0] - place(m * y_auto, m, c, synth, REPLICATE_ROUNDS)[0], ddof=1))


def joined_placements(sides: DataFrame, frame: DataFrame, tasks: DataFrame, draws: int, schema: str) -> DataFrame:
    """Placements where the battles are too many to be broadcast: joined with the frames, a group per pair of players."""
    rows = sides.join(frame.select("held_out", F.col("player").alias("opponent"), "score"), "opponent").join(tasks.select(F.col("player").alias("held_out")).distinct(), "held_out", "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["opponent", "y", "y_auto"])
        c, n, y, ya = (pdf[k].to_numpy(float) for k in ("score", "n", "y", "y_auto"))
        held, player = pdf["held_out"].iloc[0], pdf["player"].iloc[0]
        (truth,), (truth_se,) = place((n * y)[None], n[None], c)
        (synth,), (synth_se,) = place((n * ya)[None], n[None], c, truth)
        gap_se = gap_error(held, player, n, y, ya, c, truth, synth, draws) if draws and held != player else None
        each = influence(truth, truth_se, y, c) - influence(synth, synth_se, ya, c)
        delta = math.sqrt(max(0.0, (n * each**2).sum() - (n * each).sum() ** 2 / n.sum()))
        return pd.DataFrame({"held_out": [held], "player": [player], "n": [int(n.sum())], "truth": [truth], "truth_se": [truth_se], "synth": [synth], "synth_se": [synth_se], "gap_se": pd.Series([gap_se], dtype=float), "gap_delta_se": [delta]})

    return rows.groupBy("held_out", "player").applyInPandas(run, schema)


def intervals(placed: DataFrame, frame: DataFrame, algo: str, alpha: float, alloc: str | Callable = "prop_127") -> DataFrame:
    """Interval, Elo and rank records of every held-out player: ``alg1``, ``alg4`` (one-piece) or ``synth_only``."""
    own = placed.where("player = held_out").drop("player")
    gaps = placed.where("player <> held_out").select("held_out", (F.col("truth") - F.col("synth")).alias("gap"), "gap_se")
    split = ALLOCATIONS[alloc] if isinstance(alloc, str) else alloc
    a1, a2, a3 = split(0, alpha) if algo == "alg1" else (0.0, 0.0, alpha) if algo == "alg4" else (alpha, 0.0, 0.0)
    s, se = F.col("synth"), F.col("synth_se")
    if algo == "synth_only":
        rows = own.withColumns({"delta_lo": F.lit(0.0), "delta_hi": F.lit(0.0), "mid_lo": F.lit(0.0), "mid_hi": F.lit(0.0), "synth_lo": s - z(alpha) * se, "synth_hi": s + z(alpha) * se})
    else:
        half = z(a2) * F.col("gap_se") if algo == "alg1" else F.lit(0.0)
        bands = split_bands(gaps, F.col("gap") - half, F.col("gap") + half, F.col("gap"), a3, ["held_out"])
        rows = own.join(bands, "held_out").withColumns({"synth_lo": s - z(a1) * se if algo == "alg1" else s, "synth_hi": s + z(a1) * se if algo == "alg1" else s})
    rows = rows.withColumns({"ci_lo": F.col("synth_lo") + F.col("delta_lo"), "ci_hi": F.col("synth_hi") + F.col("delta_hi"), "theta_lo": F.col("truth") - z(alpha) * F.col("truth_se"), "theta_hi": F.col("truth") + z(alpha) * F.col("truth_se")})
    bounded = (F.abs("delta_lo") < float("inf")) & (F.abs("delta_hi") < float("inf"))
    rows = rows.withColumns({"w1": F.col("synth_hi") - F.col("synth_lo"), "w3": F.when(bounded, F.col("mid_hi") - F.col("mid_lo"))})
    rows = rows.withColumn("w2", F.when(bounded, F.col("delta_hi") - F.col("delta_lo") - F.col("w3")))
    ranked = rank_intervals(rows, frame)
    elo = {f"elo_{k}": ELO_SCALE * F.col(c) for k, c in (("truth", "truth"), ("lo", "ci_lo"), ("hi", "ci_hi"), ("theta_lo", "theta_lo"), ("theta_hi", "theta_hi"))}
    out = ranked.withColumns({**elo, "covered": covers(F.col("ci_lo"), F.col("ci_hi"), F.col("truth")), "width": F.col("ci_hi") - F.col("ci_lo"), "algo": F.lit(algo), "alpha": F.lit(alpha), "alpha1": F.lit(a1), "alpha2": F.lit(a2), "alpha3": F.lit(a3)})
    return out.select(F.col("held_out").alias("player"), "algo", "alpha", "alpha1", "alpha2", "alpha3", "n", F.col("truth").alias("theta"), "ci_lo", "ci_hi", "covered", "width", "synth_lo", "synth_hi", "delta_lo", "delta_hi", "w1", "w2", "w3", "theta_lo", "theta_hi", *elo, "rank", "rank_lo", "rank_hi", ((F.col("rank_lo") <= F.col("rank")) & (F.col("rank") <= F.col("rank_hi"))).alias("rank_covered"), "n_models")


def rank_intervals(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """rank, rank_lo (best) and rank_hi (worst) within the field of the same held-out player, and the field's size plus one.

    Instead of comparing every target with every member of the field, thresholds and scores are put in one order and
    running counts tell how many scores lie above each threshold.
    """
    marks = rows.select("held_out", F.explode(F.create_map(F.lit("rank"), F.col("truth"), F.lit("rank_lo"), F.col("ci_hi"), F.lit("rank_hi"), F.col("ci_lo"))).alias("what", "value"))
    field = frame.select("held_out", F.lit(None).cast("string").alias("what"), F.col("score").alias("value"))
    part = Window.partitionBy("held_out")
    # scores equal to a threshold don't count as above it: they come before it in descending order only if greater
    order = part.orderBy(F.desc("value"), F.col("what").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(field).withColumns({"above": F.count(F.when(F.col("what").isNull(), 1)).over(order), "size": F.count(F.when(F.col("what").isNull(), 1)).over(part)})
    found = both.where("what is not null").groupBy("held_out").agg(*(F.max(F.when(F.col("what") == w, F.col("above") + 1)).cast("int").alias(w) for w in ("rank", "rank_lo", "rank_hi")), (F.max("size") + 1).cast("int").alias("n_models"))
    return rows.join(found, "held_out")


def leaderboard(scores: DataFrame) -> DataFrame:
    """The scores with rank 1 for the strongest; equal scores share the better rank."""
    placed = with_ranks(scores, [F.desc("score")], name="rank")
    return placed.withColumn("rank", F.min("rank").over(Window.partitionBy("score")).cast("int"))
