import json
import math

import pytest
from pyspark.sql import functions as F

from synthcal.functions import expressions as ex
from synthcal.operators import allocation, deident
from synthcal.operators.conformal import split_bands  # noqa: F401
from synthcal.functions.levels import z
from synthcal.plans import methods, summaries
from synthcal.sources import io
from test_methods import STATS, made


def records(spark, algo="alg1"):
    return methods.run(spark.createDataFrame(made(40), STATS), algo, 0.2, mode="loo", clip=(0.0, 1.0))


def test_records_survive_csv(spark, tmp_path):
    rows = records(spark).unionByName(methods.run(spark.createDataFrame(made(6), STATS), "alg1", 0.1, mode="loo"))
    io.write_records(rows, str(tmp_path / "r"), "app", "def")
    extra = rows.select("w3", F.lit(7).alias("extra"), F.lit(None).cast("string").alias("void"), *[c for c in rows.columns if c != "w3"])
    io.write_records(extra, str(tmp_path / "x"), "app", "def")
    fixed = [c for c in io.COLUMNS if c in rows.columns and c not in ("algo", "alloc")]
    sets = {r["alpha_tag"]: list(r["columns"]) for r in io.read_manifest(spark, str(tmp_path / "x")).collect()}
    unbounded = [c for c in fixed if c not in ("width_clip", "w2", "w3")]  # six tasks: the band is infinite
    assert sets == {"020": [*fixed, "extra"], "010": [*unbounded, "extra"]}
    back = io.read_records(spark, str(tmp_path / "r"))
    key = lambda r: (r["task_id"], r["alpha"])
    a, b = ({key(r): r for r in d.collect()} for d in (rows, back))
    assert set(a) == set(b)
    for k in a:
        for c in ("ci_lo", "ci_hi", "covered", "width", "w3", "width_clip"):
            assert a[k][c] == b[k][c]


def test_coercion(spark):
    rows = spark.createDataFrame([("t", " Yes ", "0.5"), ("u", "no", ""), ("v", "1", "x")], "task_id string, covered string, theta string")
    assert [tuple(r) for r in io.coerced(rows).orderBy("task_id").collect()] == [("t", True, 0.5), ("u", False, None), ("v", True, None)]


def test_summary_ignores_infinite_and_counts_null_as_missed(spark):
    rows = spark.createDataFrame([("a", 0.1, True, 1.0), ("a", 0.1, None, math.inf), ("a", 0.1, False, 3.0)], "algo string, alpha double, covered boolean, width double").withColumns({c: F.col("width") for c in ("width_clip", "w1", "w2", "w3")})
    r = summaries.summary(rows).first()
    assert (r["n_tasks"], r["mean_width"]) == (3, 2.0) and r["coverage_pct"] == pytest.approx(100 / 3)
    text = summaries.report(summaries.summary(rows.where("width > 5"))).first()
    assert text["mean_width"] == "—" and text["coverage"] == "0%" and text["alpha"] == "0.10"


def test_selections(spark):
    rows = records(spark).withColumn("label", F.concat(F.lit("g / "), "task_id"))
    near = summaries.borderline(rows, 5).collect()
    margins = sorted(min(r["theta"] - r["ci_lo"], r["ci_hi"] - r["theta"]) for r in rows.collect())
    assert sorted(r["margin"] for r in near) == pytest.approx(margins[:5]) and [r["theta"] for r in near] == sorted(r["theta"] for r in near)
    assert summaries.borderline(rows, 5, ["g"]).count() == 0
    assert summaries.select_spread(rows, 4, 40).count() == 4 and summaries.select_spread(rows, 90, 40).count() == 40
    pick = lambda d: {r["task_id"] for r in summaries.select_random(d, 7).collect()}
    assert pick(rows) == pick(rows.repartition(5)) and len(pick(rows)) == 7


def test_differences(spark):
    a, b = summaries.manifest(records(spark)), summaries.manifest(records(spark, "alg3"))
    assert summaries.differences(a, a).count() == 0
    assert summaries.differences(a, b).count() == 2


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    assert not one(ex.finite(inf)) and not one(ex.finite(nan)) and not one(ex.finite(F.lit(None).cast("double"))) and one(ex.finite(F.lit(1.0)))
    assert one(ex.clipped_width(F.lit(1.2), F.lit(1.5), (0.0, 1.0))) == pytest.approx(-0.2)
    assert one(ex.clipped_width(F.lit(0.2), inf, (0.0, 1.0))) is None and one(ex.width(F.lit(0.2), inf)) == math.inf
    assert one(ex.softplus(F.lit(800.0))) == 800.0 and one(ex.logistic(F.lit(0.0))) == 0.5
    assert one(ex.level_tag(F.lit(0.1))) == "010"
    names = {"gpt-20260102-x": "2026-01-02", "m-0315": "2026-03-15", "m-2507-b": "2025-07-15", "m-1399": None, "m-03151": None, "plain": None}
    for name, date in names.items():
        assert one(ex.date_in_name(F.lit(name))) == date, name


def test_packed_tasks(spark):
    rows = spark.createDataFrame([("a" * 50, [1.0, 2.0], [0.0, 1.0])], "k string, r array<double>, s array<double>")
    got = io.unpacked_tasks(rows, "k", "r", "s").collect()
    assert [(r["label"], r["unit"], r["x"], r["y"]) for r in got] == [("a" * 40, 0, 1.0, 0.0), ("a" * 40, 1, 2.0, 1.0)]
    with pytest.raises(Exception, match="differ"):
        io.unpacked_tasks(spark.createDataFrame([("a", [1.0], [1.0, 2.0])], rows.schema), "k", "r", "s").collect()


def test_packing_in_chunks(spark):
    rows = spark.createDataFrame([("t", i, float(i), -float(i)) for i in range(1000)] + [("u", 0, 1.0, 2.0)], "k string, i int, x double, y double")
    packed = io.packed_tasks(rows, "k", "x", "y", F.col("i"), 50)
    assert packed.where("k = 't'").count() == 20 and packed.agg(F.max(F.size("s_real"))).first()[0] < 100
    got = io.unpacked_tasks(packed, "k", "s_real", "s_synth").select("task_id", "x", "y").collect()
    assert sorted(map(tuple, got)) == sorted((k, x, y) for k, _, x, y in rows.collect())


def test_reduced_cells_pass_through(spark):
    raw = spark.createDataFrame([("a", 1.0, 0.5, 1.0), ("a", 0.0, 0.5, 3.0), ("b", 1.0, 1.0, 1.0)], "k string, x double, y double, w double")
    done = io.reduced_cells(raw.where("k = 'b'"), None, ["k"])
    both = {r["k"]: r for r in io.reduced_cells(raw.where("k = 'a'"), done, ["k"]).collect()}
    assert both["b"]["theta"] == 1.0 and both["a"]["theta"] == 0.25 and io.reduced_cells(None, done, ["k"]).count() == 1


def test_respondents_battles_and_release_files(spark, tmp_path):
    rows = spark.createDataFrame([("2016001", "D", "g", 1.0, 2.0), ("2016002", "D", None, 1.0, 2.0), ("2020001", "R", "g", None, 2.0)], "id string, pid string, grp string, x double, y double")
    assert [(r["year"], r["task_id"]) for r in io.respondent_tasks(rows, "id", ["pid", "grp"], "x", "y").collect()] == [(2016, "2016:g / D")]
    path = str(tmp_path / "b.csv")
    open(path, "w").write("a,b,y,y_auto\nm,n,1,0.5\n")
    assert io.read_battles(spark, path, "m").count() == 1
    with pytest.raises(ValueError):
        io.read_battles(spark, path, "q")
    path = str(tmp_path / "o.json")
    json.dump({"ordering": ["m", "n"], "dates": {"m": {"date": "2026-01-01", "source": "s", "confidence": "c"}}, "_note": "x"}, open(path, "w"), indent=1)
    assert [tuple(r) for r in io.read_ordering(spark, path).orderBy("pos").collect()] == [("m", 0, "2026-01-01"), ("n", 1, None)]


def test_parity(spark):
    a = spark.createDataFrame([("k", 1.0), ("l", 2.0)], "key string, v double")
    assert io.parity(a, a, ["key"], ["v"]).first()["within"]
    assert io.parity(a, a.where("key = 'k'"), ["key"], ["v"]).first()["largest"] == math.inf
    assert not io.parity(a, a.withColumn("v", F.col("v") + 1e-6), ["key"], ["v"]).first()["within"]


def test_pseudonyms(spark):
    names = spark.createDataFrame([("abc",), ("abc-2",), ("x",)], "name string")
    targets = names.where("name <> 'x'")
    m = deident.mapping(names, targets)
    found = {r["name"]: r["alias"] for r in m.collect()}
    assert set(found) == {"abc", "abc-2"} and len(set(found.values())) == 2
    with pytest.raises(ValueError):
        deident.mapping(names, spark.createDataFrame([("nobody",)], "name string"))
    rows = spark.createDataFrame([("abc", "x", "d"), ("x", "abc-2", "e"), (None, "x", "f")], "a string, b string, day string")
    got = {tuple(r) for r in deident.rename_keys(rows, ["a", "b"], m, {"day": "a"}).collect()}
    assert got == {(found["abc"], "x", None), ("x", found["abc-2"], "e"), (None, "x", "f")}
    assert {r["column"]: r["n"] for r in deident.substitutions(rows, ["a", "b"], m).collect()} == {"a": 1, "b": 1}
    texts = spark.createDataFrame([(1, "abc and abc-2, abcabc"), (2, None), (3, "")], "id int, t string")
    swapped = {r["id"]: r["t"] for r in deident.replace_in_text(texts, "t", {"abc": "N1", "abc-2": "N2"}).collect()}
    assert swapped == {1: "N1 and N2, N1N1", 2: None, 3: ""}
    assert {(r["id"], r["name"]): r["n"] for r in deident.leaks(texts, "id", "t", ["abc", "abc-2"]).collect()} == {(1, "abc"): 4, (1, "abc-2"): 1}


def test_grid_allocation_equals_brute_force(spark):
    tasks = [(r[0], 20, r[4], r[5], r[6], r[7], r[8]) for r in made(30, 4)]
    got = {r["task_id"]: r for r in allocation.grid_intervals(spark.createDataFrame(tasks, "task_id string, n long, theta double, synth double, synth_se double, gap double, gap_se double"), 0.3, n_grid=6).collect()}
    assert len(got) == 30
    for t in tasks[:6]:
        hist = [h for h in tasks if h[0] != t[0]]
        best = None
        for _, _, a1, a2, a3, z1, z2, low, high in allocation.grid_points(0.3, 29, 6):
            dl = sorted(h[5] - z2 * h[6] for h in hist)[low - 1]
            du = sorted(h[5] + z2 * h[6] for h in hist)[high - 1]
            w = 2 * z(a1) * t[4] + du - dl
            if best is None or w < best[0] - 1e-15:
                best = (w, a1, a3)
        r = got[t[0]]
        assert r["w_synth"] + r["w_band"] == pytest.approx(best[0]) and (r["alpha1"], r["alpha3"]) == pytest.approx(best[1:])
    assert allocation.grid_intervals(spark.createDataFrame(tasks[:3], "task_id string, n long, theta double, synth double, synth_se double, gap double, gap_se double"), 0.1).count() == 0
