"""SQL for the registered queries, written the plain way: leave-one-out by a join of every task with all others."""

from __future__ import annotations

import math

from synthcal.functions.levels import ALLOCATIONS, z

ALPHA = 0.1


def d(x: float | str) -> str:
    """A literal in double precision; an expression stays as it is."""
    return x if isinstance(x, str) else f"({x!r})::DOUBLE"


def r(x: str, digits: int = 6) -> str:
    return f"CASE WHEN isfinite({x}) THEN round({x}, {digits}) + 0.0::DOUBLE ELSE {x} END"


PAIRS = """pairs AS (SELECT p_brand || '|' || p_type AS task_id, p_brand, p_type, l_orderkey, l_discount AS x, l_tax AS y, l_quantity AS w, l_extendedprice AS price, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

STAT = """count(*) AS n_real, count(*) AS n_synth, avg(x) AS theta, avg(y) AS synth, coalesce(stddev_samp(y), 0) / sqrt(count(*)) AS synth_se,
  avg(x - y) AS gap, coalesce(stddev_samp(x - y), 0) / sqrt(count(*)) AS gap_se, coalesce(stddev_samp(x), 0) / sqrt(count(*)) AS theta_se"""

TASKS = f"{PAIRS}, tasks AS (SELECT task_id, task_id AS label, {STAT} FROM pairs GROUP BY task_id)"

TEMPORAL = f"""{PAIRS}, tasks AS (SELECT year(o_orderdate) || ':' || p_brand AS task_id, p_brand || ' / ' || year(o_orderdate) AS label, year(o_orderdate) AS year,
  CASE WHEN year(o_orderdate) = 2000 THEN 'predict' ELSE 'calib' END AS role, {STAT}
  FROM pairs JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) <= 2000 GROUP BY year(o_orderdate), p_brand)"""

CELLS = """rows AS (SELECT year(o_orderdate) AS wave, l_returnflag AS party, r_name AS region, l_discount * 10 AS x, l_tax * 10 AS y, l_quantity AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
means AS (SELECT wave, party, region, count(*) AS n, sum(w * x) / sum(w) AS theta, sum(w * (x - y)) / sum(w) AS gap, sum(w * y) / sum(w) AS synth, sum(w) AS sw, sum(w) * sum(w) / sum(w * w) AS n_eff FROM rows GROUP BY ALL),
cells AS (SELECT m.wave, m.party, m.region, any_value(n) AS n, any_value(theta) AS theta, any_value(gap) AS gap, sqrt(sum(w * w * (x - y - gap) * (x - y - gap))) / any_value(sw) AS gap_se,
  any_value(synth) AS synth, sqrt(sum(w * w * (y - synth) * (y - synth))) / any_value(sw) AS synth_se, any_value(n_eff) AS n_eff
  FROM rows JOIN means m USING (wave, party, region) GROUP BY m.wave, m.party, m.region)"""

BATTLES = """line AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, s_nationkey AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
battles AS (SELECT a.nation AS a, b.nation AS b, CASE WHEN a.l_extendedprice > b.l_extendedprice THEN 1.0 WHEN a.l_extendedprice < b.l_extendedprice THEN 0.0 ELSE 0.5 END::DOUBLE AS y,
  CASE WHEN a.l_quantity > b.l_quantity THEN 1.0 WHEN a.l_quantity < b.l_quantity THEN 0.0 ELSE 0.5 END::DOUBLE AS y_auto
  FROM line a JOIN line b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.nation <> b.nation),
pairs AS MATERIALIZED (SELECT a, b, y, y_auto, count(*) AS n FROM battles GROUP BY ALL),
sides AS MATERIALIZED (SELECT player, opponent, y, y_auto, sum(n)::BIGINT AS n FROM (SELECT a AS player, b AS opponent, y, y_auto, n FROM pairs UNION ALL SELECT b, a, 1 - y, 1 - y_auto, n FROM pairs) GROUP BY ALL)"""


def band(lo: str, hi: str, mid: str, a3: str, history: str, by: str) -> str:
    """by, t, delta_lo, delta_hi, mid_lo, mid_hi by sorting each endpoint of a relation of (by, task, history row)."""
    k, m = f"floor((t + 1) * {a3} / 2.0::DOUBLE)", f"ceil((t + 1) * (1.0::DOUBLE - {a3} / 2.0::DOUBLE))"
    return f"""ranked AS (SELECT {by}, {lo} AS lo, {hi} AS hi, {mid} AS mid, row_number() OVER (PARTITION BY {by} ORDER BY {lo}) AS r_lo, row_number() OVER (PARTITION BY {by} ORDER BY {hi}) AS r_hi,
  row_number() OVER (PARTITION BY {by} ORDER BY {mid}) AS r_mid, count(*) OVER (PARTITION BY {by}) AS t FROM {history}),
bands AS (SELECT {by}, any_value(t) AS t_hist, coalesce(max(lo) FILTER (WHERE r_lo = {k}), '-infinity'::DOUBLE) AS delta_lo, coalesce(max(hi) FILTER (WHERE r_hi = {m}), 'infinity'::DOUBLE) AS delta_hi,
  coalesce(max(mid) FILTER (WHERE r_mid = {k}), '-infinity'::DOUBLE) AS mid_lo, coalesce(max(mid) FILTER (WHERE r_mid = {m}), 'infinity'::DOUBLE) AS mid_hi FROM ranked GROUP BY {by})"""


def record(algo: str, alpha: float, a: tuple[float, float, float], alloc: str, source: str, clip: tuple[float, float] | None, infinite: bool = False) -> str:
    bounded = "isfinite(delta_lo) AND isfinite(delta_hi)"
    both = "isfinite(ci_lo) AND isfinite(ci_hi)"
    inner = f"least({d(clip[1])}, ci_hi) - greatest({d(clip[0])}, ci_lo)" if clip else "ci_hi - ci_lo"
    covered = "ci_lo <= theta AND theta <= ci_hi" + ("" if infinite else f" AND {both}")
    w2 = "0.0::DOUBLE" if algo in ("alg3", "synth_only") else r("delta_hi - delta_lo - (mid_hi - mid_lo)")
    return f"""SELECT task_id, label, {r('theta')} AS theta, '{algo}' AS algo, {d(alpha)} AS alpha, {d(a[0])} AS alpha1, {d(a[1])} AS alpha2, {d(a[2])} AS alpha3, '{alloc}' AS alloc, n_real, n_synth,
  {r('ci_lo')} AS ci_lo, {r('ci_hi')} AS ci_hi, {covered} AS covered, CASE WHEN {both} THEN {r('ci_hi - ci_lo')} ELSE 'infinity'::DOUBLE END AS width, CASE WHEN {both} THEN {r(inner)} END AS width_clip,
  {r('synth_lo')} AS synth_lo, {r('synth_hi')} AS synth_hi, {r('delta_lo')} AS delta_lo, {r('delta_hi')} AS delta_hi, {r('synth_hi - synth_lo')} AS w1,
  CASE WHEN {bounded} THEN {w2} END AS w2, CASE WHEN {bounded} THEN {r('mid_hi - mid_lo')} END AS w3
  FROM (SELECT *, synth_lo + delta_lo AS ci_lo, synth_hi + delta_hi AS ci_hi FROM {source})"""


def method(prefix: str, algo: str, alpha: float = ALPHA, alloc: str = "prop_127", mode: str = "split", clip: tuple[float, float] | None = None, infinite: bool = False, hoeffding: bool = False) -> str:
    """The records of one method. ``prefix`` defines the relation tasks."""
    a, by_level = (0.0, 0.0, 0.0) if alloc == "floored_127" else ALLOCATIONS[alloc](0, alpha), z
    if algo == "synth_only":
        rows = f"held AS (SELECT *, synth - {d(z(alpha))} * synth_se AS synth_lo, synth + {d(z(alpha))} * synth_se AS synth_hi, 0.0::DOUBLE AS delta_lo, 0.0::DOUBLE AS delta_hi, 0.0::DOUBLE AS mid_lo, 0.0::DOUBLE AS mid_hi FROM tasks {'WHERE role = ' + repr('predict') if mode == 'split' else ''})"
        return f"WITH {prefix}, {rows} {record(algo, alpha, (alpha, 0.0, 0.0), alloc, 'held', clip, infinite)}"
    if mode == "split":
        hist = "hist AS (SELECT p.task_id AS held, h.* FROM tasks p, tasks h WHERE p.role = 'predict' AND h.role = 'calib')"
        t = "(SELECT count(*) FROM tasks WHERE role = 'calib')"
    else:
        hist = "hist AS (SELECT p.task_id AS held, h.* FROM tasks p, tasks h WHERE p.task_id <> h.task_id)"
        t = "(SELECT count(*) - 1 FROM tasks)"
    if alloc == "floored_127":  # levels by the size of the history, from a table
        field = lambda c: f"(SELECT {c} FROM floored WHERE floored.t = {t})"
        prefix, a = f"{floored_table(alpha)}, {prefix}", (field("a1"), field("a2"), field("a3"))
        by_level = dict(zip(a, (field("z1"), field("z2"), ""), strict=True)).__getitem__
    if algo == "alg3":
        lo = hi = "gap"
        a = (0.0, 0.0, alpha)
        ends = "synth AS synth_lo, synth AS synth_hi"
    else:
        z2 = Z2_BY_T.replace("{t}", t).replace("{a2}", d(a[1])) if algo == "alg2" else d(by_level(a[1]))
        lo, hi = f"gap - {z2} * gap_se", f"gap + {z2} * gap_se"
        ends = f"synth - {d(by_level(a[0]))} * synth_se AS synth_lo, synth + {d(by_level(a[0]))} * synth_se AS synth_hi"
        if hoeffding:
            lo, hi = (f"gap {s} sqrt(2 * (0.1::DOUBLE * 0.1::DOUBLE) * (1.0::DOUBLE / n_real + 1.0::DOUBLE / n_synth) / 4 * {d(math.log(2 / a[1]))})" for s in "-+")
            ends = ", ".join(f"synth {s} 0.1::DOUBLE * sqrt({d(math.log(2 / a[0]))} / (2 * n_synth)) AS synth_{n}" for s, n in (("-", "lo"), ("+", "hi")))
    held = f"held AS (SELECT t.*, {ends}, delta_lo, delta_hi, mid_lo, mid_hi FROM tasks t JOIN bands ON held = task_id)"
    return f"WITH {prefix}, {hist}, {band(lo, hi, 'gap', d(a[2]), 'hist', 'held')}, {held} {record(algo, alpha, a, alloc, 'held', clip, infinite)}"


#: SQL has no normal quantile: the points at level a2 / t come from a table of t.
Z2_BY_T = "(SELECT v FROM zs WHERE zs.t = {t})"


def floored_table(alpha: float, most: int = 400) -> str:
    rows = []
    for t in range(1, most):
        try:
            a = ALLOCATIONS["floored_127"](t, alpha)
        except ValueError:
            continue
        rows.append(f"({t}, {', '.join(d(x) for x in (*a, z(a[0]), z(a[1])))})")
    return f"floored AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v(t, a1, a2, a3, z1, z2))"


def z_table(a2: float, most: int = 400) -> str:
    return "zs AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {d(z(a2 / t))})" for t in range(1, most)) + ") AS v(t, v))"
