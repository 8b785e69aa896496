"""Bootstrap intervals for means, gaps and quantiles.

A task's rows are first reduced to distinct values with counts: resampling n rows is a multinomial draw over them, exact in
distribution. Neither the rows nor the distinct values of a task are ever gathered:

* Means split the draw hierarchically. A task's values are dealt to chunks by hash; how many of a replicate's draws fall to
  each chunk is a multinomial over the chunks' sizes, drawn as a chain of binomials over a stream of chunks; each chunk then
  draws its own values, and only its sums per replicate leave it.
* Quantiles work on ranks. The k-th smallest of n resampled rows is the row of rank ceil(n U), U the k-th smallest of n
  uniform numbers (a beta variable), and the next one's rank follows from it. So all replicates' ranks are drawn first; the
  values at the least and the greatest of them come from :func:`select_ranks`, and only the values between, about the square
  root of n, are put in order.

Any other estimator is a function of a task's distinct values and counts and needs them in one group
(:func:`grouped_intervals`). Seeds come from the task's name and the chunk, not from a row's place. :func:`poisson_means` is a
further way for means: per-row Poisson weights, partial sums per task and replicate.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthcal.operators.conformal import select_ranks
from synthcal.sources.scratch import written

Estimator = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: What is resampled: either side by itself, their gap with independent draws, and with the same draws for both.
TARGETS = ("real", "synth", "gap", "paired_gap")
KINDS = ("percentile", "basic")
#: Distinct values of a chunk.
CHUNK = 65_536


def mean_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Estimator on replicates: rows of counts over the distinct values."""
    return counts @ values / counts.sum(axis=1)


def quantile_of(q: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Linear interpolation between order statistics of each replicate; values ascend."""

    def run(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.cumsum(counts, axis=1)
        at = q * (total[:, -1] - 1)
        low = np.floor(at).astype(int)
        pick = lambda k: values[(total <= k[:, None]).sum(axis=1)]
        a, b = pick(low), pick(np.minimum(low + 1, total[:, -1] - 1))
        return a + (at - low) * (b - a)

    return run


def interval(kind: str, point: float, draws: np.ndarray, alpha: float) -> tuple[float, float]:
    low, high = np.quantile(draws, [alpha / 2, 1 - alpha / 2])
    return (float(low), float(high)) if kind == "percentile" else (2 * point - float(high), 2 * point - float(low))


def rng_of(*names: object) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32("\x1f".join(map(str, names)).encode()))


def drawn(counts: np.ndarray, b: int, rng: np.random.Generator, most: int = 4_000_000):
    """``b`` multinomial draws over the counts, so many at a time that about ``most`` numbers are held."""
    share, step = counts / counts.sum(), max(1, most // len(counts))
    for first in range(0, b, step):
        yield rng.multinomial(int(counts.sum()), share, size=min(step, b - first))


def replicates(values: np.ndarray, counts: np.ndarray, b: int, rng: np.random.Generator, estimator: Callable) -> np.ndarray:
    return np.concatenate([estimator(values, draws) for draws in drawn(counts, b, rng)])


def kinds_of(rows: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)


def levels_of(alpha: float | dict[str, float], targets: tuple[str, ...]) -> dict[str, float]:
    """One level for all targets, or one for each of those that are asked for."""
    return dict(alpha) if isinstance(alpha, dict) else dict.fromkeys(targets, float(alpha))


def bootstrap_intervals(rows: DataFrame, by: list[str], real: str, synth: str, alpha: float | dict[str, float], b: int = 1000, estimator: str | float | Estimator = "mean", chunk: int = CHUNK, count: str | None = None) -> DataFrame:
    """by, target, kind, point, ci_lo, ci_hi, se: percentile and basic intervals of each task.

    ``rows`` are pairs, or distinct pairs with the column ``count`` (not for quantiles); the unpaired gap draws the two sides
    independently. ``alpha`` is a level for all targets, or a level
    for each target that is wanted. ``estimator``: ``mean``, ``median``, a number q in (0, 1) for that quantile (without the
    paired gap, whose replicates have no ranks of their own), or a function of values and counts.
    """
    rows = rows.na.drop(subset=[*by, real, synth])
    times = F.sum(count) if count else F.count("*")
    if estimator == "mean":
        return ends(mean_replicates(rows, by, real, synth, levels_of(alpha, TARGETS), b, chunk, times), by, levels_of(alpha, TARGETS))
    if callable(estimator):
        return grouped_intervals(rows, by, real, synth, levels_of(alpha, TARGETS), b, estimator, times)
    if count:
        raise ValueError("quantiles are drawn from rows, not from counted values")
    levels = levels_of(alpha, TARGETS[:3])
    return ends(quantile_replicates(rows, by, real, synth, 0.5 if estimator == "median" else float(estimator), b), by, levels)


def ends(replicates: DataFrame, by: list[str], levels: dict[str, float]) -> DataFrame:
    """Intervals from replicates: by, replicate, and for each target ``d_<target>`` and ``p_<target>`` (its point)."""
    parts = F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"d_{t}").alias("_d"), F.col(f"p_{t}").alias("point")) for t in levels))
    rows = replicates.select(*by, F.explode(parts).alias("_part")).select(*by, "_part.*")
    drawn = F.lit(None).cast("array<double>")
    for t, a in levels.items():
        share = F.percentile("_d", [a / 2, 1 - a / 2])
        drawn = share if len(set(levels.values())) == 1 else F.when(F.col("target") == t, share).otherwise(drawn)
    found = rows.groupBy(*by, "target").agg(F.first("point").alias("point"), drawn.alias("_q"), F.stddev_samp("_d").alias("se"))
    low, high, p = F.col("_q")[0], F.col("_q")[1], F.col("point")
    kind = F.explode(F.array(F.struct(F.lit(KINDS[0]).alias("kind"), low.alias("ci_lo"), high.alias("ci_hi")), F.struct(F.lit(KINDS[1]).alias("kind"), (2 * p - high).alias("ci_lo"), (2 * p - low).alias("ci_hi"))))
    return found.select(*by, "target", "point", "se", kind.alias("_kind")).select(*by, "target", "_kind.kind", "point", "_kind.ci_lo", "_kind.ci_hi", "se")


def chunk_draws(chunks: DataFrame, by: list[str], streams: list[str], b: int) -> DataFrame:
    """by, chunk, draws: how many draws of each replicate and stream fall to the chunk, a stream after the other.

    ``chunks``: by, chunk, n_chunk, n. A chunk gets a binomial share of what the chunks before it left.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = rest = left = None
        for pdf in batches:
            out = []
            for key in pdf.itertuples(index=False):
                if task != tuple(key[: len(by)]):
                    task, rest, left = tuple(key[: len(by)]), int(key.n), {s: np.full(b, int(key.n)) for s in streams}
                share = min(1.0, key.n_chunk / rest)
                taken = {s: rng_of(*task, s, "split", key.chunk).binomial(left[s], share) for s in streams}
                rest, left = rest - int(key.n_chunk), {s: left[s] - taken[s] for s in streams}
                out.append((*task, key.chunk, np.concatenate([taken[s] for s in streams])))
            yield pd.DataFrame(out, columns=[*by, "chunk", "draws"])

    ordered = chunks.select(*by, "chunk", "n_chunk", "n").repartition(*by).sortWithinPartitions(*by, "chunk")
    return ordered.mapInPandas(run, f"{kinds_of(chunks, by)}, chunk long, draws array<long>")


def mean_replicates(rows: DataFrame, by: list[str], real: str, synth: str, levels: dict[str, float], b: int, chunk: int, times: Column) -> DataFrame:
    """by, replicate, d_<target>, p_<target> for means, by hierarchical splitting."""
    streams = [s for s, of in (("real", {"real", "gap"}), ("synth", {"synth", "gap"}), ("paired", {"paired_gap"})) if of & set(levels)]
    counted = written(rows.groupBy(*by, F.col(real).cast("double").alias("_x"), F.col(synth).cast("double").alias("_y")).agg(times.alias("c")), "value-counts")
    sizes = counted.groupBy(*by).agg(F.sum("c").alias("n"), F.ceil(F.count("*") / chunk).alias("_chunks"), (F.sum(F.col("c") * F.col("_x")) / F.sum("c")).alias("p_real"), (F.sum(F.col("c") * F.col("_y")) / F.sum("c")).alias("p_synth"))
    sizes = written(sizes, "task-sizes")  # a row per task
    dealt = counted.join(sizes.select(*by, "_chunks", "n"), by).withColumn("chunk", F.pmod(F.xxhash64("_x", "_y"), F.col("_chunks")))
    chunks = dealt.groupBy(*by, "chunk").agg(F.sum("c").alias("n_chunk"), F.max("n").alias("n"))
    draws = chunk_draws(chunks, by, streams, b)
    keys = [*by, "chunk"]

    def run(pdf: pd.DataFrame, split: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_x", "_y"])
        share = pdf["c"].to_numpy(float) / pdf["c"].sum()
        task, number = tuple(split[k].iloc[0] for k in by), split["chunk"].iloc[0]
        values = {"real": pdf["_x"].to_numpy(), "synth": pdf["_y"].to_numpy(), "paired": (pdf["_x"] - pdf["_y"]).to_numpy()}
        taken = np.asarray(split["draws"].iloc[0]).reshape(len(streams), b)
        out = pd.DataFrame({"replicate": np.arange(b, dtype=np.int32)})
        step = max(1, 4_000_000 // len(pdf))
        for s, m in zip(streams, taken, strict=True):
            rng = rng_of(*task, s, number)
            out[f"s_{s}"] = np.concatenate([rng.multinomial(m[i : i + step], share) @ values[s] for i in range(0, b, step)])
        for k, v in zip(by, task, strict=True):
            out[k] = v
        return out[[*by, "replicate", *(f"s_{s}" for s in streams)]]

    sums = dealt.select(*keys, "_x", "_y", "c").groupBy(*keys).cogroup(draws.groupBy(*keys)).applyInPandas(run, f"{kinds_of(rows, by)}, replicate int, " + ", ".join(f"s_{s} double" for s in streams))
    sums = sums.groupBy(*by, "replicate").agg(*(F.sum(f"s_{s}").alias(f"s_{s}") for s in streams))
    mean = {s: F.col(f"s_{s}") / F.col("n") for s in streams}
    gap = F.col("p_real") - F.col("p_synth")
    of = {"real": (mean.get("real"), F.col("p_real")), "synth": (mean.get("synth"), F.col("p_synth")), "paired_gap": (mean.get("paired"), gap)}
    if "gap" in levels:
        of["gap"] = (mean["real"] - mean["synth"], gap)
    return sums.join(sizes, by).select(*by, "replicate", *(of[t][0].alias(f"d_{t}") for t in levels), *(of[t][1].alias(f"p_{t}") for t in levels))


def resampled_ranks(n: int, q: float, b: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """Ranks of the two order statistics between which the q-quantile of ``b`` resamples of n rows lies, and the place between."""
    at = q * (n - 1)
    k = min(n, math.floor(at) + 1)
    u = rng.beta(k, n - k + 1, b)
    after = u + (1 - u) * rng.beta(1, n - k, b) if k < n else u
    return *(np.clip(np.ceil(n * x), 1, n).astype(np.int64) for x in (u, after)), at - math.floor(at)


def quantile_replicates(rows: DataFrame, by: list[str], real: str, synth: str, q: float, b: int) -> DataFrame:
    """by, replicate, d_<target>, p_<target> for the q-quantile of either side and their gap."""
    if not 0 < q < 1:
        raise ValueError(f"q must lie in (0, 1): {q}")
    names, by = by, [f"_by{i}" for i in range(len(by))]  # a key may have any name
    rows = rows.select(*(F.col(c).alias(k) for c, k in zip(names, by, strict=True)), F.col(real).alias("_x"), F.col(synth).alias("_y"))
    keys = [*by, "side"]
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("v")) for s, c in (("real", "_x"), ("synth", "_y"))))
    long = rows.select(*by, F.explode(sides).alias("_side")).select(*by, "_side.side", "_side.v")
    sizes = written(long.groupBy(*keys).agg(F.count("*").alias("n")), "side-sizes")

    def asked(key: tuple, n: int) -> tuple[np.ndarray, np.ndarray, float, int, int]:
        low, high, part = resampled_ranks(n, q, b, rng_of(*key))
        own = math.floor(q * (n - 1)) + 1
        return low, high, part, own, min(n, own + 1)

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                low, high, _, own, after = asked(tuple(row[: len(keys)]), int(row.n))
                out += [(*row[: len(keys)], k) for k in sorted({min(int(low.min()), own), max(int(high.max()), after)})]
            yield pd.DataFrame(out, columns=[*keys, "k"])

    wanted = written(sizes.mapInPandas(outer, f"{kinds_of(rows, by)}, side string, k long"), "outer-ranks")
    ends_of = select_ranks(long, "v", wanted, keys).groupBy(*keys).agg(F.min("value").alias("_a"), F.max("value").alias("_z"))
    ends_of = written(ends_of.join(sizes, keys), "rank-ends")
    near = long.join(ends_of, keys).where("v <= _z").groupBy(*keys, F.when(F.col("v") >= F.col("_a"), F.col("v")).alias("v")).agg(F.count("*").alias("c"), F.max("n").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, pdf = tuple(pdf[k].iloc[0] for k in keys), pdf.sort_values("v", na_position="first")  # what lies below comes first
        upto, values = np.cumsum(pdf["c"].to_numpy()), pdf["v"].to_numpy()
        low, high, part, own, after = asked(key, int(pdf["n"].iloc[0]))
        of = lambda ranks: values[np.searchsorted(upto, ranks)]
        point = of(np.array([own, after]))
        out = pd.DataFrame({"replicate": np.arange(b, dtype=np.int32), "d": of(low) + part * (of(high) - of(low)), "p": point[0] + part * (point[1] - point[0])})
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out[[*keys, "replicate", "d", "p"]]

    drawn = near.groupBy(*keys).applyInPandas(run, f"{kinds_of(rows, by)}, side string, replicate int, d double, p double")
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    both = drawn.groupBy(*by, "replicate").agg(*(pick(c, s) for c in ("d", "p") for s in ("real", "synth")))
    both = both.withColumns({f"{c}_gap": F.col(f"{c}_real") - F.col(f"{c}_synth") for c in ("d", "p")})
    return both.withColumnsRenamed(dict(zip(by, names, strict=True)))


def grouped_intervals(rows: DataFrame, by: list[str], real: str, synth: str, levels: dict[str, float], b: int, estimator: Estimator, times: Column) -> DataFrame:
    """The same for any estimator, with a task's distinct pairs in one group."""
    counted = rows.groupBy(*by, real, synth).agg(times.alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = tuple(pdf[k].iloc[0] for k in by)
        side = {}
        for name in (real, synth):
            g = pdf.groupby(name)["c"].sum().sort_index()
            side[name] = (g.index.to_numpy(float), g.to_numpy())
        point = {k: float(estimator(v, c[None, :])[0]) for k, (v, c) in side.items()}
        draws = {k: replicates(v, c, b, rng_of(*key, k), estimator) for k, (v, c) in side.items()}
        pairs = pdf.sort_values([real, synth])
        marginals = [np.unique(pairs[name].to_numpy(float), return_inverse=True) for name in (real, synth)]
        paired = []
        for joint in drawn(pairs["c"].to_numpy(), b, rng_of(*key, "paired")):  # the same draws for both sides
            x, y = (estimator(values, np.stack([np.bincount(at, weights=j, minlength=len(values)) for j in joint]).astype(np.int64)) for values, at in marginals)
            paired.append(x - y)
        gap = point[real] - point[synth]
        targets = {"real": (point[real], draws[real]), "synth": (point[synth], draws[synth]), "gap": (gap, draws[real] - draws[synth]), "paired_gap": (gap, np.concatenate(paired))}
        out = [(*key, t, kind, p, *interval(kind, p, d, levels[t]), float(np.std(d, ddof=1))) for t, (p, d) in targets.items() if t in levels for kind in KINDS]
        return pd.DataFrame(out, columns=[*by, "target", "kind", "point", "ci_lo", "ci_hi", "se"])

    return counted.groupBy(*by).applyInPandas(run, f"{kinds_of(rows, by)}, target string, kind string, point double, ci_lo double, ci_hi double, se double")


def poisson_means(rows: DataFrame, by: list[str], unit: str, value: str, b: int = 100) -> DataFrame:
    """Replicate means by Poisson(1) weights from a hash of the unit and the replicate: by, replicate, mean.

    The Poisson variant of the bootstrap, for tasks of any size: partial sums per task and replicate, no row is exploded.
    """
    def run(batches):
        for pdf in batches:
            code, names = pd.factorize(pd.MultiIndex.from_frame(pdf[by]) if len(by) > 1 else pdf[by[0]])
            x = pdf["_v"].to_numpy(float)
            out = []
            for r in range(b):
                u = _unit_hash(pdf["_u"].to_numpy(np.int64), r)
                w = np.searchsorted(_POISSON, u).astype(float)
                out.append(pd.DataFrame({"g": range(len(names)), "replicate": r, "sw": np.bincount(code, w, len(names)), "swx": np.bincount(code, w * x, len(names))}))
            part = pd.concat(out)
            for i, k in enumerate(by):
                part[k] = [names[g][i] if len(by) > 1 else names[g] for g in part["g"]]
            yield part[[*by, "replicate", "sw", "swx"]]

    sums = rows.na.drop(subset=[*by, value]).select(*by, F.xxhash64(unit).alias("_u"), F.col(value).cast("double").alias("_v")).mapInPandas(run, f"{kinds_of(rows, by)}, replicate int, sw double, swx double")
    return sums.groupBy(*by, "replicate").agg((F.sum("swx") / F.sum("sw")).alias("mean"))


_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


def _unit_hash(units: np.ndarray, r: int) -> np.ndarray:
    x = units.astype(np.uint64) + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
