"""Policies, bootstraps, audits and parsing: fixtures with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauplane.functions import scores as S
from tauplane.functions import text as X
from tauplane.functions.bounds import cp_feasible, cp_upper, cp_uppers
from tauplane.operators import ablation, audit, distance, evaluate, fitting, importance, policy, ranking, relational, resample
from tauplane.plans import catalog, catalog_support  # noqa: F401
from tauplane.sources import tables
from tauplane.sources.freeze import mutations, payload_hash


def frame(spark, risks, errors, groups=None):
    n = len(risks)
    return spark.createDataFrame([("x", f"s{k:05d}", float(risks[k]), int(errors[k]), (groups or ["a"] * n)[k]) for k in range(n)], "cell string, sample_id string, risk_score double, base_error int, g string")


def test_group_controlled_threshold(spark):
    none, bounds = policy.group_controlled(frame(spark, [0.1, 0.2, 0.3, 0.4], [1, 1, 1, 1], ["clean", "clean", "blur", "blur"]), ["cell"], "g", 0.05, 0.05)
    assert tuple(none.first()[1:]) == (None, 0.0, 1.0) and bounds.count() == 0
    found, bounds = policy.group_controlled(frame(spark, [0.01, 0.02, 0.9] * 2, [0, 0, 1] * 2, ["clean"] * 3 + ["blur"] * 3), ["cell"], "g", 0.9, 0.05)
    row = found.first()
    assert row["tau"] == 0.02 and math.isclose(row["coverage"], 4 / 6) and math.isclose(row["worst_cp_upper"], 1 - 0.025**0.5)
    assert {(r["g"], r["accepted_count"], r["accepted_errors"], r["empirical_risk"]) for r in bounds.collect()} == {("clean", 2, 0, 0.0), ("blur", 2, 0, 0.0)}
    plain, _ = policy.group_controlled(frame(spark, [0.01, 0.02, 0.9] * 2, [0, 0, 1] * 2, ["clean"] * 3 + ["blur"] * 3), ["cell"], "g", 0.8, 0.05, bonferroni=False)
    assert plain.first()["tau"] == 0.02


def test_group_controlled_threshold_against_a_scan(spark):
    draw = np.random.default_rng(4)
    risks = np.round(draw.random(600), 2)
    errors = (draw.random(600) < risks * 0.15).astype(int)
    groups = [str(x) for x in draw.integers(0, 3, 600)]
    best = None
    for tau in sorted(set(risks)):
        worst = max(cp_upper(int(errors[m].sum()), int(m.sum()), 0.05 / 3) if (m := (risks <= tau) & (np.array(groups) == g)).any() else 1.0 for g in "012")
        best = (tau, worst) if worst <= 0.2 else best
    row = policy.group_controlled(frame(spark, risks, errors, groups), ["cell"], "g", 0.2, 0.05)[0].first()
    assert best and math.isclose(row["tau"], best[0]) and math.isclose(row["worst_cp_upper"], best[1], rel_tol=1e-9)


def test_feasible_is_the_bound_held_against_alpha(spark):
    rows = [(k, n) for n in (0, 1, 2, 10, 60, 500) for k in range(0, n + 1, max(1, n // 12))]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("f", cp_feasible("k", "n", F.lit(0.05), F.lit(0.1)))
    assert all(r["f"] == (r["n"] > 0 and cp_upper(r["k"], r["n"], 0.05) <= 0.1) for r in df.collect())


def test_bounds_of_a_batch_are_those_of_each():
    k, n = np.array([0, 1, 3, 5, 77, 0]), np.array([9, 2, 40, 5, 90_000, 0])
    assert np.allclose(cp_uppers(k, n, np.full(6, 0.01)), [cp_upper(int(a), int(b), 0.01) for a, b in zip(k, n, strict=True)], rtol=1e-12)


def test_selection_without_samples(spark):
    curve = policy.threshold_curve(frame(spark, [0.1] * 200, [0] * 200), ["cell"], 0.05)
    cells = spark.createDataFrame([("x",), ("empty",)], "cell string")
    got = {r["cell"]: r["status"] for r in policy.select_threshold(curve, ["cell"], 0.05, cells=cells).collect()}
    assert got == {"x": "selected", "empty": "no_samples"}


def test_best_failed_prefers_coverage_before_threshold(spark):
    rows = [("x", "c1", 0.3, 0.05, 10, False, 0.1), ("x", "c2", 0.2, 0.05, 20, False, 0.1), ("x", "c3", 0.1, 0.05, 99, False, 0.2)]
    df = spark.createDataFrame(rows, "cell string, candidate_id string, tau double, alpha double, accepted_count long, certified boolean, margin double")
    assert policy.best_failed(df, ["cell"]).first()["candidate_id"] == "c2"


def test_best_failed_takes_margins_equal_to_12_digits_as_ties(spark):
    rows = [("x", "c1", 0.3, 0.05, 10, False, 0.1), ("x", "c2", 0.2, 0.05, 20, False, 0.1 + 1e-14)]
    df = spark.createDataFrame(rows, "cell string, candidate_id string, tau double, alpha double, accepted_count long, certified boolean, margin double")
    assert policy.best_failed(df, ["cell"]).first()["candidate_id"] == "c2"


def test_running_over_many_ranges_and_cells(spark):
    draw = np.random.default_rng(8)
    rows = [(f"c{draw.integers(0, 7)}" if draw.random() > 0.05 else None, int(draw.integers(0, 30)), k, int(draw.integers(0, 5))) for k in range(3000)]
    df = spark.createDataFrame(rows, "cell string, a int, b int, v int")
    got = {r["b"]: (r["s"], r["n"]) for r in ranking.running(df, ["cell"], ["a", "b"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    total = {}
    for cell, _, b, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        s, n = total.get(cell, (0, 0))
        total[cell] = s + v, n + 1
        assert got[b] == total[cell]


def test_harmonic_optimum(spark):
    cases = [(1, 0), (1, 1), (40, 3), (5000, 4999), (100_000, 20)]
    df = spark.createDataFrame(cases, "n long, e long").withColumn("o", ranking.optimal_aurc(F.col("n"), F.col("e")))
    assert all(math.isclose(r["o"], sum(j / (r["n"] - r["e"] + j) for j in range(1, r["e"] + 1)) / r["n"], abs_tol=1e-12) for r in df.collect())


def test_draws_within_strata(spark):
    df = spark.createDataFrame([(f"u{k}", "a" if k < 30 else "b") for k in range(40)], "u string, s string")
    drawn = resample.drawn_units(df, "u", ["s"], 50, 3).join(df, "u")
    assert {(r["s"], r["w"]) for r in drawn.groupBy("replicate", "s").agg(F.sum("weight").alias("w")).collect()} == {("a", 30), ("b", 10)}
    lone = resample.stratified_poisson(spark.createDataFrame([("x", "a"), ("y", "b")], "u string, s string"), "u", ["s"], 200, 1).collect()
    assert all(r["weight"] >= 1 for r in lone)  # a stratum of one never vanishes


def test_repeated_aurc_is_that_of_the_repeated_rows(spark):
    draw = np.random.default_rng(2)
    risks, errors, weights = draw.integers(0, 6, 80) / 9, draw.integers(0, 2, 80), draw.integers(0, 4, 80)
    df = frame(spark, risks, errors).join(spark.createDataFrame([(f"s{k:05d}", int(w)) for k, w in enumerate(weights)], "sample_id string, weight long"), "sample_id").withColumn("replicate", F.lit(0))
    order = sorted(range(80), key=lambda k: (risks[k], k))
    e = np.repeat(errors[order], weights[order])
    got = resample.repeated_aurc(df, ["cell"]).first()
    assert math.isclose(got["draw"], np.mean(np.cumsum(e) / np.arange(1, len(e) + 1)))
    best = np.sort(e)
    assert math.isclose(got["excess"], got["draw"] - np.mean(np.cumsum(best) / np.arange(1, len(e) + 1)), abs_tol=1e-12)


def test_multinomial_counts_keep_totals_and_do_not_depend_on_chunks(spark):
    counts = spark.createDataFrame([("x", "s1", "rejected", 30), ("x", "s1", "accepted_real_error", 10), ("x", "s2", "accepted_fake_correct", 25), ("x", "s2", "accepted_fake_error", 5)], "cell string, stratum string, category string, n long")
    a = resample.multinomial_counts(counts, ["cell"], "stratum", "category", 300, 1)
    assert {r[0] for r in a.groupBy("replicate").agg(F.sum("many")).select("sum(many)").collect()} == {70}
    assert a.exceptAll(resample.multinomial_counts(counts, ["cell"], "stratum", "category", 300, 1, chunk=7)).count() == 0
    means = {r["category"]: r["m"] for r in a.groupBy("category").agg(F.avg("many").alias("m")).collect()}
    assert abs(means["accepted_real_error"] - 10) < 0.7 and abs(means["accepted_fake_error"] - 5) < 0.5
    m = {r["metric"]: r["m"] for r in resample.category_metrics(a, ["cell"]).groupBy("metric").agg(F.avg("draw").alias("m")).collect()}
    assert abs(m["coverage"] - 40 / 70) < 0.02 and m["accepted_FPR"] == 1.0


def test_paired_metrics(spark):
    counts = spark.createDataFrame([(0, "real_all|0|0|0|1|1", 8), (0, "real_all|0|1|1|1|0", 2), (0, "gan|1|1|0|0|1", 6), (0, "gan|1|0|1|1|1", 4)], "replicate int, category string, many long")
    got = {r["metric"]: r["draw"] for r in resample.paired_metrics(counts, []).collect()}
    assert math.isclose(got["coverage"], 14 / 20 - 18 / 20) and math.isclose(got["selective_risk"], 6 / 14 - 4 / 18)
    assert math.isclose(got["balanced_selective_risk"], (0.2 + 1) / 2 - (0 + 0.4) / 2) and math.isclose(got["worst_group_selective_risk"], 1 - 0.4) and math.isclose(got["minimum_group_coverage"], 0.4 - 0.8)


def test_choice_of_k_prefers_the_smaller_on_ties(spark):
    near = spark.createDataFrame([(q, b, float(q % 2), b + 1) for q in range(8) for b in range(3)], "query_id long, bank_id long, distance double, place int")
    errors = spark.createDataFrame([(q, q // 4, q % 2) for q in range(8)], "query_id long, fold int, base_error int")
    k, rows = distance.select_k(near, errors, [1, 2, 3])
    assert k == 1 and {r["auroc"] for r in rows.collect()} == {1.0}
    k, rows = distance.select_k(near, errors.withColumn("base_error", F.lit(0)), [2, 3])
    assert k == 2 and {r["status"] for r in rows.collect()} == {"undefined_due_to_single_error_class"}


def test_archives_and_urls(spark):
    names = ["gan/a/x.zip", "gan/a/x.z01", "gan/a/x.Z02", "gan/x.ZIP", "gan/a/x.tar.gz", "gan/a/.hidden", "gan/a/plain"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(X.archive_family(F.col("p")).alias("f"), X.archive_part(F.col("p")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("gan/x", "zip"), ("gan/x", "z01"), ("gan/x", "z02"), ("gan/x", "zip"), ("gan/x.tar", ""), ("gan/.hidden", ""), ("gan/plain", "")]
    urls = ["https://h/uc?export=d&id=A1", "https://h/file/d/B2/view?usp=s", "https://h/d/C3?id=D4"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(X.url_id(F.col("u"))).collect()] == ["A1", "B2", "D4"]
    with pytest.raises(Exception, match="no id in"):
        spark.createDataFrame([("https://h/x?to=/d/E5",)], "u string").select(X.url_id(F.col("u"))).collect()


def test_threshold_map_names_the_unmatched(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "cell string, r double")
    known = spark.createDataFrame([("a", 0.5), ("b", None)], "cell string, threshold double")
    assert [r["threshold"] for r in relational.with_thresholds(df, known, ["cell"]).orderBy("cell").collect()] == [0.5, None]
    with pytest.raises(Exception, match="no threshold for b"):
        relational.with_thresholds(df, known.where("cell = 'a'"), ["cell"]).collect()


def test_differences_count_rows_of_one_side(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(2, 2.0), (3, 3.0)], "k int, v double")
    assert tuple(relational.value_differences(a, b, ["k"], ["v"]).first()) == ("v", 3, 2)


def test_two_level_split():
    whole = relational.two_level_split({"g": {"a": 5, "b": 4}, "h": {"c": 3}}, (9, 4))
    assert whole == {("g", "a"): 0, ("g", "b"): 0, ("h", "c"): 1}
    parts = relational.two_level_split({"g": {"a": 5, "b": 4}}, (5, 4))
    assert parts == {("g", "a"): 0, ("g", "b"): 1} and relational.two_level_split({"g": {"a": 9}}, (5, 5)) is None


def test_mutations(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, "c", 2.0)], "k int, v string, w double")
    now = spark.createDataFrame([(1, "a", None), (2, "b", 1.5), (4, "d", 0.0)], "k int, v string, w double")
    assert {r["k"]: r["status"] for r in mutations(payload_hash(df, ["k"]), now, ["k"]).collect()} == {1: "unchanged", 2: "mutated", 3: "removed", 4: "added"}


def test_filled_quota(spark):
    df = spark.createDataFrame([(k, f"u{k}", "a" if k < 3 else "b" if k < 50 else "c") for k in range(80)], "sample int, unit string, stratum string")
    got = audit.filled_quota_sample(df, "unit", "sample", "stratum", 31, 1).collect()
    assert len(got) == 31 == len({r["sample"] for r in got}) and sum(r["stratum"] == "a" for r in got) == 3 and sum(r["picked"] == "fill" for r in got) == 8


def test_models_that_do_not_converge_are_an_error(spark):
    df = spark.createDataFrame([(float(k), int(k > 10)) for k in range(20)], "x double, y int")
    with pytest.raises(ValueError, match="did not converge"):
        fitting.fit_grid(df, ["x"], "y", [1.0], [None], steps=1)
    assert fitting.choose([{"c": 1.0, "nll": 0.5, "brier": 0.2, "aurc": 0.1}, {"c": 0.1, "nll": 0.5, "brier": 0.2, "aurc": 0.2}])["c"] == 1.0


def test_scales_do_not_cancel(spark):
    df = spark.createDataFrame([(1e9 + k % 5, int(k % 3 == 0), k % 2) for k in range(200)], "x double, y int, cv_fold int")
    x = np.array([k % 5 for k in range(200) if k % 2 == 1], float)
    model = fitting.fit_grid(df, ["x"], "y", [1.0], [0])[0, 1.0]
    assert math.isclose(model.scales[0], x.std(), rel_tol=1e-6)


def test_margins_and_categories(spark):
    row = spark.createDataFrame([([-2.0, 1.0, -3.0],)], "z array<double>").select(S.boundary_margins(F.col("z"), 0.0).alias("m"), S.checked_erosions(F.col("z"), 0.0, 3).alias("e")).first()
    assert row["m"] == [2.0, -1.0, 3.0] and row["e"] == [3.0, -1.0]
    df = spark.createDataFrame([(True, 0, 1, 1), (True, 1, 1, 0), (False, 0, 0, 0), (True, 2, 1, 1)], "a boolean, y int, p int, e int")
    assert [r[0] for r in df.select(S.bootstrap_category(F.col("a"), F.col("y"), F.col("p"), F.col("e"))).collect()] == ["accepted_real_error", "accepted_fake_correct", "rejected", "accepted_other_error"]


def test_json_latex_and_shards(spark, tmp_path):
    tables.write_json(spark, {"b": float("nan"), "a": 1}, str(tmp_path / "j"))
    read = tables.json_document(spark, str(tmp_path / "j"))
    assert read["a"] == 1 and math.isnan(read["b"])
    text = tables.latex(spark.createDataFrame([("a_b", 1)], "x string, n int"), "A & B")
    assert r"a\_b & 1 \\" in text and r"\caption{A \& B}" in text
    for k in range(2):
        spark.range(k, k + 2).write.parquet(str(tmp_path / f"s{k}"))
    with pytest.raises(ValueError, match="unique"):
        tables.shards(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")], ["id"])
    with pytest.raises(ValueError, match="2 rows"):
        tables.shards(spark, [str(tmp_path / "s0")], ["id"], 3)
    assert tables.provenance(spark, "numpy", "no-such-package")["no-such-package"] == "missing"


def test_mahalanobis_is_over_z_scores(spark):
    draw = np.random.default_rng(5)
    x = np.c_[draw.normal(0, 100, 80), draw.normal(5, 0.01, 80), np.full(80, 3.0)]
    y = draw.integers(0, 2, 80)
    df = spark.createDataFrame([(k, [float(v) for v in row], int(c)) for k, (row, c) in enumerate(zip(x, y, strict=True))], "id long, embedding array<double>, label int")
    scale = np.where(x.std(0) < 1e-8, 1, x.std(0))
    z = (x - x.mean(0)) / scale
    want = []
    for c in (0, 1):
        own = z[y == c] - z[y == c].mean(0)
        cov, _ = distance.ledoit_wolf(own.T @ own / len(own), len(own), float(((own**2).sum(1) ** 2).mean()))
        off = z - z[y == c].mean(0)
        want.append(np.einsum("ij,jk,ik->i", off, np.linalg.pinv(cov), off))
    got = {r["id"]: r["risk"] for r in distance.mahalanobis_risk(df, distance.fit_mahalanobis(df, "label")).collect()}
    assert np.allclose([got[k] for k in range(80)], np.min(want, 0), rtol=1e-6)


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fold_audit_sends_no_units_to_every_task(spark):
    rows = spark.createDataFrame([("u", 0, 1), ("u", 1, 0), ("v", 1, 0), ("v", 1, None), (None, 0, 1)], "unit string, cv_fold int, base_error int")
    audited = policy.fold_audit(rows, "unit", ["cv_fold"])
    assert "Join" not in planned(audited)
    assert {tuple(r) for r in audited.collect()} == {(0, 1, 1, 1, 0, 1), (1, 3, 2, 0, 2, 1)}
    assert "strategy=merge" in planned(catalog._folded(spark, "/root/testdata/sf0.001"))


def test_sums_by_units_are_those_of_joined_weights(spark):
    draw = np.random.default_rng(8)
    rows = [("x" if k % 3 else None, float(draw.integers(0, 4)) / 8, f"u{draw.integers(0, 60)}" if k % 50 else None, int(draw.integers(0, 2))) for k in range(600)]
    df = spark.createDataFrame(rows, "cell string, risk_score double, unit string, base_error int").repartition(3)
    keys, w = ["cell", "risk_score"], F.col("weight")
    want = resample.weighted_units(df, "unit", 6, 7).groupBy(*keys, "replicate").agg(F.sum(w).alias("w"), F.sum(w * F.col("base_error")).alias("e"))
    got = resample.unit_sums(df, keys, {"w": F.lit(1), "e": F.col("base_error")}, "unit", 6, 7)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(got.columns).collect()}


@pytest.mark.parametrize("name", ["poisson_weight_aurc_draws", "weighted_auroc_draws", "weighted_threshold_metrics", "percentile_ci", "stratified_category_ci"])
def test_units_are_not_joined_to_weights(spark, name):
    assert "Join" not in planned(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_paired_interval_does_not_join_units(spark):
    assert planned(catalog.QUERIES["paired_aurc_ci"](spark, "/root/testdata/sf0.001")).count("Join ") == 1  # the two methods' draws


def test_columns_are_shuffled_as_each_is_alone(spark):
    df = spark.createDataFrame([(f"s{k}", k, k * k) for k in range(40)], "sample_id string, a int, b int")
    got = resample.shuffled_columns(df, [], ["a", "b"], "sample_id", 5, 3)
    for c in "ab":
        want = resample.shuffled(df, [], c, "sample_id", 5, 3)
        assert {tuple(r) for r in got.select("replicate", "sample_id", f"_s_{c}").collect()} == {tuple(r) for r in want.select("replicate", "sample_id", c).collect()}


def test_units_of_grouping_sets_are_counted_without_repeating_rows(spark):
    draw = np.random.default_rng(8)
    rows = [("xyz"[draw.integers(0, 3)] if k % 9 else None, int(draw.integers(0, 40)), f"u{draw.integers(0, 90)}" if k % 7 else None) for k in range(700)]
    df = spark.createDataFrame([*rows, ("lone", 1, None)], "a string, b int, unit string").repartition(3)
    sets, n = [["a"], ["a", "b"], ["b"], []], {"n": F.count("*")}
    got = evaluate.grouping_sets(df, sets, n, {"units": F.col("unit")})
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in evaluate.grouping_sets(df, sets, n | {"units": F.count_distinct("unit")}).collect()}
    expands = [x for x in planned(catalog.QUERIES["metrics_grouping_sets"](spark, "/root/testdata/sf0.001")).splitlines() if "Expand" in x]
    assert expands and not any("sha256" in x for x in expands)


def test_stratified_means_are_those_of_joined_weights(spark):
    draw = np.random.default_rng(8)
    rows = [("xy"[k % 2], "lone" if k < 4 else "abc"[draw.integers(0, 3)], "u0" if k < 4 else f"u{draw.integers(0, 50)}" if k % 50 else None, float(draw.random())) for k in range(600)]
    df = spark.createDataFrame(rows, "cell string, g string, unit string, v double").repartition(3)
    weights = resample.stratified_poisson(df, "unit", ["g"], 8, 9).groupBy("replicate", "unit").agg(F.sum("weight").alias("weight"))
    want = {(r["cell"], r["replicate"]): r["draw"] for r in resample.weighted_mean(resample.by_weights(df, weights, "unit"), ["cell"], F.col("v")).collect()}
    means = resample.stratified_poisson_means(df, ["cell"], F.col("v"), "unit", ["g"], 8, 9)
    got = {(r["cell"], r["replicate"]): r["draw"] for r in means.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    assert "replicate" not in "".join(x for x in planned(means).splitlines() if "Join" in x)


def test_areas_of_all_replicates_from_one_order(spark):
    draw = np.random.default_rng(8)
    rows = [("xy"[k % 2] if k % 11 else None, f"s{k:05d}", float(draw.integers(0, 9)) / 8, int(draw.integers(0, 2)), draw.integers(0, 4, 3).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "cell string, sample_id string, risk_score double, base_error int, weights array<int>").repartition(3)
    long = df.select("*", F.posexplode("weights").alias("replicate", "weight")).drop("weights")
    want = {(r["cell"], r["replicate"]): r for r in resample.repeated_aurc(long, ["cell"]).collect()}
    got = {(r["cell"], r["replicate"]): r for r in resample.repeated_aurcs(df, ["cell"], 3).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k][c], want[k][c], rel_tol=1e-9, abs_tol=1e-12) for k in want for c in ("draw", "excess"))


def test_ablations_from_groups_are_those_of_rows(spark, monkeypatch):
    draw = np.random.default_rng(8)
    # The error isn't a function of the first two features, so without the third blocks are mixed.
    rows = [(f"s{k:05d}", int(draw.integers(0, 3)), float(draw.integers(0, 5)), float(draw.integers(0, 3)), int(draw.integers(0, 4))) for k in range(900)]
    df = spark.createDataFrame(rows, "sample_id string, cv_fold int, a double, b double, c int").repartition(3)
    scored = lambda d: d.withColumns({"e": (F.col("c") == 1).cast("int"), "w": (F.col("c") > 1).cast("double"), "f": (F.col("a") + F.col("c") > 4).cast("int")})
    models = {"m": (["a", "b", "w"], "e"), "n": (["b", "w", "a"], "f")}
    args = (["a", "b", "c"], scored, models, {"all": [0, 1, 2], "two": [0, 1], "last": [2]}, 1.0, [0, 1, 2])
    monkeypatch.setattr(ablation, "CHUNK", 50)
    got = {(r["detector"], r["variant"]): r for r in ablation.ablations(df, *args).collect()}
    monkeypatch.setattr(ablation, "GROUPS", 10)
    want = {(r["detector"], r["variant"]): r for r in ablation.ablations(df, *args).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k in want:
        assert all(a == b if isinstance(a, (str, int)) else math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[k], want[k], strict=True)), k


def test_feature_sets_are_not_fitted_on_rows(spark, monkeypatch):
    monkeypatch.setattr(fitting, "fit_grid", None)
    monkeypatch.setattr(fitting, "out_of_fold", None)
    assert catalog.QUERIES["feature_ablations"](spark, "/root/testdata/sf0.001").count() == 15


def test_importances_from_groups_are_those_of_rows(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(f"s{k:05d}", float(draw.integers(0, 5)), None if k % 9 == 0 else float(draw.integers(0, 3)), int(draw.integers(0, 4))) for k in range(900)]
    df = spark.createDataFrame(rows, "sample_id string, a double, b double, c int").repartition(3)
    scored = lambda d: d.withColumns({"v": F.coalesce("b", F.lit(1.5)), "e": (F.col("a") + F.col("c") > 4).cast("int"), "w": (F.col("c") > 1).cast("double"), "f": (F.col("c") == 1).cast("int")})
    args = ("sample_id", ["a", "b", "c"], scored, {"m": (["a", "v", "w"], "e"), "n": (["v", "w", "a"], "f")}, ["x", "y", "z"], 1.0, 5, 3)
    name = lambda r: (r["detector"], r["feature"], r["replicate"], r["metric"])
    monkeypatch.setattr(importance, "CHUNK", 64)
    monkeypatch.setattr(importance, "HELD", 50)
    got = {name(r): r for r in importance.importances(df, *args).collect()}
    monkeypatch.setattr(importance, "GROUPS", 10)
    want = {name(r): r for r in importance.importances(df, *args).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 3 * 3 * 2
    for k in want:
        assert all(math.isclose(got[k][c], want[k][c], rel_tol=1e-9, abs_tol=1e-12) for c in ("baseline_value", "draw")), k


def test_rows_are_not_shuffled_whole_for_permutation_importance(spark, monkeypatch):
    monkeypatch.setattr(resample, "shuffled_columns", None)
    monkeypatch.setattr(fitting, "fit_grid", None)
    assert catalog.QUERIES["permutation_importance"](spark, "/root/testdata/sf0.001").count() == 18
