"""Fixtures with known answers, for operators and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauplane.functions import scores as S
from tauplane.functions.bounds import cp_upper, incomplete_beta, with_cp_upper
from tauplane.functions import text as X
from tauplane.operators import distance, evaluate, fitting, policy, ranking, relational, resample
from tauplane.sources import tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "cell string, sample_id string, risk_score double, base_error int, g string, label int")


def rows_of(risks, errors, ids=None, groups=None):
    n = len(risks)
    return [("x", (ids or [f"s{k}" for k in range(n)])[k], float(risks[k]), errors[k], (groups or ["a"] * n)[k], 0) for k in range(n)]


def test_aurc_orders_ties_by_sample(spark):
    row = ranking.aurc(frame(spark, rows_of([0.3, 0.1, 0.2], [1, 0, 1], ["c", "a", "b"])), ["cell"]).first()
    assert math.isclose(row["aurc"], (0 + 1 / 2 + 2 / 3) / 3)
    assert math.isclose(row["optimal_aurc"], (0 + 1 / 2 + 2 / 3) / 3)


def test_aurc_brute_force_with_heavy_ties(spark):
    draw = np.random.default_rng(3)
    risks, errors = draw.integers(0, 5, 400) / 7, draw.integers(0, 2, 400).tolist()
    ids = [str(x) for x in draw.permutation(400)]
    order = sorted(range(400), key=lambda k: (risks[k], ids[k]))
    want = np.mean(np.cumsum([errors[k] for k in order]) / np.arange(1, 401))
    assert math.isclose(ranking.aurc(frame(spark, rows_of(risks, errors, ids)), ["cell"]).first()["aurc"], want)


def test_blocks_accept_all_equal_risks(spark):
    curve = ranking.prefix_blocks(frame(spark, rows_of([0.1, 0.1, 0.2, 0.3], [0, 1, 0, 0])), ["cell"]).orderBy("threshold").collect()
    assert [r["accepted_count"] for r in curve] == [2, 3, 4]
    assert curve[0]["accepted_errors"] == 1


@pytest.mark.parametrize("k,n,delta", [(1, 10, 0.05), (7, 1000, 1e-4), (3, 50, 0.05 / 60), (200, 3000, 0.01)])
def test_bound_has_the_binomial_tail(k, n, delta):
    p = cp_upper(k, n, delta)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert math.isclose(tail, delta, rel_tol=1e-8)


def test_bound_edges(spark):
    assert cp_upper(0, 0, 0.05) == 1 and cp_upper(5, 5, 0.05) == 1
    assert math.isclose(cp_upper(0, 10, 0.05), 1 - 0.05**0.1)
    assert incomplete_beta(2, 3, 0) == 0 and incomplete_beta(2, 3, 1) == 1
    for bad in ((-1, 5, 0.05), (6, 5, 0.05), (1, 5, 0), (1, 5, 1)):
        with pytest.raises(ValueError):
            cp_upper(*bad)
    got = with_cp_upper(spark.createDataFrame([(0, 0), (5, 5), (0, 10), (1, 10)], "k long, n long"), "k", "n", F.lit(0.05)).orderBy("n", "k").collect()
    assert [round(r["cp_upper"], 9) for r in got] == [round(x, 9) for x in (1, 1, cp_upper(0, 10, 0.05), cp_upper(1, 10, 0.05))]


def test_certification_fails_closed(spark):
    df = frame(spark, rows_of([0.1] * 8, [1] * 8))
    scan = policy.group_scan(df, ["cell"], "g", 0.05)
    trace = policy.certify(df, policy.candidates(scan, ["cell"]), ["cell"], "g", 0.05, 0.05)
    chosen = policy.certified_policy(trace, ["cell"]).first()
    assert chosen["status"] == "NO_CERTIFIED_THRESHOLD" and chosen["tau"] is None and chosen["accepted_count"] == 0


def test_group_scan_needs_every_group(spark):
    df = frame(spark, rows_of([0.1, 0.2, 0.3, 0.4], [0, 0, 0, 1], groups=["a", "a", "b", "b"]))
    assert [r["feasible"] for r in policy.group_scan(df, ["cell"], "g", 0.4).orderBy("threshold").collect()] == [False, False, True, False]


def test_certified_candidate_needs_all_groups(spark):
    df = frame(spark, rows_of([0.1] * 400, [0] * 200 + [1] * 200, groups=["a"] * 200 + ["b"] * 200))
    cand = policy.candidates(policy.group_scan(df, ["cell"], "g", 0.05), ["cell"])
    trace = policy.certify(df, cand, ["cell"], "g", 0.05, 0.05).collect()
    assert {r["g"]: r["group_certified"] for r in trace} == {"a": True, "b": False}
    assert not any(r["candidate_certified"] for r in trace)


def test_accept_without_threshold(spark):
    df = frame(spark, rows_of([0.1], [0])).withColumn("accepted", S.accepted(F.col("risk_score"), F.lit(None).cast("double")))
    row = evaluate.accepted_metrics(df, ["cell"]).first()
    assert row["accepted_count"] == 0 and row["selective_risk"] is None and row["status"] == "undefined_zero_denominator" and row["coverage"] == 0


def test_scores_of_known_values(spark):
    got = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").select(S.msp_risk(F.col("p")).alias("m"), S.entropy_bits(F.col("p")).alias("h")).collect()
    assert [r["m"] for r in got] == [0, 0.5, 0] and math.isclose(got[1]["h"], 1)
    far = spark.createDataFrame([(800.0,), (-800.0,)], "z double").select(S.sigmoid(F.col("z")).alias("p")).collect()
    assert [r["p"] for r in far] == [1.0, 0.0]


def test_near_threshold_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.001, 0.005, 0.01, 0.05, 0.051)], "d double")
    got = [r[0] for r in df.select(S.near_threshold_bin(F.col("d"), F.lit(0.0))).collect()]
    assert got == ["0-0.001", "0-0.001", "0.001-0.005", "0.005-0.01", "0.01-0.05", "greater_than_0.05"]


def test_erosions(spark):
    row = spark.createDataFrame([([2.0, 1.0, -0.5, 3.0, 2.5],)], "z array<double>").select(S.orientation(F.col("z")[0], 0.0).alias("c"), S.erosions(F.col("z"), 0.0).alias("e")).first()
    assert row["c"] == 1 and row["e"] == [1.0, 2.5, -1.0, -0.5]


def test_orthogonal_views_drift_by_one(spark):
    eye = [[float(i == j) for j in range(5)] for i in range(5)]
    assert spark.createDataFrame([(eye,)], "v array<array<double>>").select(S.embedding_drift(F.col("v"))).first()[0] == 1.0


def test_worst_group_with_an_undefined_one(spark):
    df = spark.createDataFrame([("x", "a", None, 0.0), ("x", "b", 0.2, 0.5), ("x", "c", 0.5, 0.25)], "cell string, g string, selective_risk double, coverage double")
    row = evaluate.worst_group(df, ["cell"]).first()
    assert (row["worst_group"], row["worst_risk"], row["worst_group_coverage"], row["min_coverage"]) == ("c", 0.5, 0.25, 0.0)


def test_folds_keep_units_together(spark):
    df = spark.createDataFrame([(f"s{k}", f"u{k // 2}", k % 2, "x") for k in range(80)], "sample_id string, sha256 string, base_error int, stratum0 string")
    f = policy.folds(df, "sha256", [F.col("stratum0")], 7)
    assert f.count() == 40 and sorted(r["count"] for r in f.groupBy("cv_fold").count().collect()) == [8] * 5
    audit = policy.fold_audit(df.join(f.select("sha256", "cv_fold"), "sha256"), "sha256", ["cv_fold"]).collect()
    assert sum(r["n_rows"] for r in audit) == 80 and all(r["leaked_units"] == 0 for r in audit)


def test_knn_leaves_itself_out_and_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(k, [1.0, float(k % 2)]) for k in range(6)], "id long, embedding array<float>")
    got = distance.knn(df, df, 2, block=2).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["bank_id"]) for r in got] == [(0, 2), (0, 4), (1, 3), (1, 5), (2, 0), (2, 4), (3, 1), (3, 5), (4, 0), (4, 2), (5, 1), (5, 3)]


def test_logistic_matches_a_direct_solve(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 2))
    y = (x @ [1.0, -0.5] + draw.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    model = fitting.fit_grid(df, ["a", "b"], "y", [0.1], [None])[None, 0.1]
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(300)]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag([10.0, 10.0, 0]), z.T @ (p - y) + np.array([10.0, 10.0, 0]) * w)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-8)
    assert fitting.Scorer.from_json(model.to_json()) == model


def test_choice_prefers_the_smaller_c_on_ties():
    rows = [{"c": 1.0, "nll": 0.5, "brier": 0.2}, {"c": 0.1, "nll": 0.5 + 1e-14, "brier": 0.2}, {"c": 10.0, "nll": 0.6, "brier": 0.1}]
    assert fitting.choose(rows)["c"] == 0.1


def test_poisson_weights_have_mean_one(spark):
    df = spark.createDataFrame([(str(k),) for k in range(2000)], "u string")
    row = resample.weighted_units(df, "u", 5, 11).agg(F.avg("weight"), F.var_pop("weight")).first()
    assert abs(row[0] - 1) < 0.05 and abs(row[1] - 1) < 0.1


def test_upsert_and_checked_joins(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    twice = new.unionByName(new)
    with pytest.raises(ValueError):
        relational.checked_join(old, twice, ["k"])
    with pytest.raises(ValueError):
        relational.checked_join(old, new, ["k"], complete=True)


def test_two_bins():
    got = relational.two_bin_split({"a": 5, "b": 4, "c": 3}, (7, 6))
    assert got is not None and sum(s for n, s in {"a": 5, "b": 4, "c": 3}.items() if got[n] == 0) <= 7
    assert relational.two_bin_split({"a": 9}, (5, 5)) is None


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write(spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, v double"), path)
    assert tables.nan_to_null(tables.parquet(spark, path)).where("v IS NULL").count() == 1
    tables.write_upserted(spark, path, spark.createDataFrame([(2, 5.0)], "k int, v double"), ["k"], str(tmp_path / "t2"))
    assert tables.shard_is_whole(spark, str(tmp_path / "t2"), 2)
    now = tables.files(spark, path, r"^_|crc$")
    changed = now.withColumn("size_bytes", F.col("size_bytes") + 1)
    assert {r["status"] for r in tables.verify_frozen(spark, changed, path).where("relative_path LIKE 'part%'").collect()} == {"changed"}
    (tmp_path / "x.log").write_text("noise\nmore\n[{\"a\": 1}, {\"a\": 2}]")
    assert [r["a"] for r in tables.json_after_log(spark, str(tmp_path / "x.log"), "struct<a:int>").collect()] == [1, 2]
    (tmp_path / "inv.csv").write_text("p/a,3,i,m\n")
    assert tables.inventory(spark, str(tmp_path / "inv.csv")).first()["size_bytes"] == 3
    (tmp_path / "m.csv").write_text("sample_id\n1\n")
    with pytest.raises(ValueError):
        tables.manifest(spark, str(tmp_path / "m.csv"))
    assert tables.canonical_json({"b": 1, "a": {"d": 2, "c": 3}, "hash": 0}, ("hash",)) == '{"a":{"c":3,"d":2},"b":1}'
    assert "| 1 |" in tables.markdown(spark.createDataFrame([(1,)], "k int"))


def test_text_functions(spark):
    df = spark.createDataFrame([("a_b&c", "x/y.txt")], "t string, p string")
    row = df.select(X.latex_escaped(F.col("t")).alias("l"), X.glob_matches(F.col("p"), "x/*.txt").alias("g"), X.number_or_undefined(F.lit("undefined_zero_denominator")).alias("n")).first()
    assert row["l"] == r"a\_b\&c" and row["g"] and row["n"] is None


def test_empty_frames(spark):
    df = frame(spark, [])
    for out in (ranking.aurc(df, ["cell"]), ranking.auroc_average_precision(df, ["cell"]), policy.group_scan(df, ["cell"], "g", 0.1), evaluate.reliability_bins(df.withColumn("p", F.col("risk_score")), ["cell"])):
        assert out.count() == 0


def test_bound_of_few_errors_in_a_million_has_the_binomial_tail():
    for k, n in ((162, 1_004_664), (306, 1_020_696)):
        p = cp_upper(k, n, 0.05)
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert math.isclose(tail, 0.05, rel_tol=1e-7)


def test_bound_of_a_trace_of_millions_has_the_binomial_tail():
    for k, n in ((2486, 1_938_517), (194, 1_644_529)):
        delta = 0.05 / 30
        p = cp_upper(k, n, delta)
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert math.isclose(tail, delta, rel_tol=1e-6)
