"""Queries of policies by several groupings, group-controlled thresholds, metric summaries, bootstraps and the choice of k."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauplane.functions import scores as S
from tauplane.operators import distance, evaluate, policy, ranking, relational, resample
from tauplane.plans.catalog import ACC, ALPHA, BINS, BLOCKS, CTX, DELTA, DISTANCES, PREFIX, ROC, SCAN, SEED, TAU, _accepted, _bank, _fits, _subset, _units, bound_sql, policy_sql, query, rounded, tail_sql, trace_sql
from tauplane.plans.frames import SCORES, scores
from tauplane.sources.freeze import freeze

LOOSE = 0.2

# Group-controlled thresholds.

CONTROLLED = f"""
    fe AS (SELECT detector, split, threshold, g, n, e, CASE WHEN n = 0 OR e = n OR e > {LOOSE} * n THEN false ELSE {tail_sql('CAST(e AS BIGINT)', 'CAST(n AS BIGINT)', f'CAST({LOOSE} AS DOUBLE)')} <= CAST({DELTA} AS DOUBLE) / count(*) OVER (PARTITION BY detector, split, threshold) END AS fits FROM cg),
    al AS (SELECT detector, split, threshold, bool_and(fits) AS fits, sum(n) AS a FROM fe GROUP BY ALL),
    tt AS (SELECT detector, split, max(CASE WHEN fits THEN threshold END) AS tau, max(a) AS total, max(CASE WHEN fits THEN a END) AS taken FROM al GROUP BY ALL),
    gb AS (SELECT fe.detector, fe.split, tau, g, CAST(n AS BIGINT) AS accepted_count, CAST(e AS BIGINT) AS accepted_errors, CAST({DELTA} AS DOUBLE) / count(*) OVER (PARTITION BY fe.detector, fe.split) AS d FROM fe JOIN tt ON fe.detector = tt.detector AND fe.split = tt.split AND fe.threshold = tau),
    k0 AS (SELECT DISTINCT accepted_errors AS k, accepted_count AS n, d FROM gb), {bound_sql('k0')},
    bo AS (SELECT gb.*, cp AS cp_upper FROM gb JOIN cp ON k = accepted_errors AND n = accepted_count AND cp.d = gb.d)"""


@query("group_controlled_threshold", f"""
    WITH {SCORES}, {SCAN}, {CONTROLLED}, wo AS (SELECT detector, split, max(cp_upper) AS w FROM bo GROUP BY ALL)
    SELECT tt.detector, tt.split, round(tau, 9) AS tau, round(coalesce(CAST(taken AS DOUBLE) / total, 0), 9) AS coverage, round(coalesce(w, 1), 9) AS worst_cp_upper FROM tt LEFT JOIN wo ON tt.detector = wo.detector AND tt.split = wo.split""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.group_controlled(scores(spark, sf_dir), CTX, "generator", LOOSE, DELTA)[0], 9)


@query("group_bounds_at_threshold", f"""
    WITH {SCORES}, {SCAN}, {CONTROLLED}, gt AS (SELECT detector, split, generator AS g, count(*) AS total FROM f GROUP BY ALL)
    SELECT bo.detector, bo.split, round(tau, 9) AS tau, bo.g, accepted_count, accepted_errors, round(coalesce(CAST(accepted_errors AS DOUBLE) / nullif(accepted_count, 0), 1), 9) AS empirical_risk, round(CAST(accepted_count AS DOUBLE) / total, 9) AS coverage, round(cp_upper, 9) AS cp_upper
    FROM bo JOIN gt ON bo.detector = gt.detector AND bo.split = gt.split AND bo.g = gt.g""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.group_controlled(scores(spark, sf_dir), CTX, "generator", LOOSE, DELTA)[1], 9)


# The three policies as a column.

KEYS = "detector, split, policy"
WITH_POLICIES = """
    f3 AS (SELECT f.*, policy, CASE policy WHEN 'global_cp' THEN 'global_all' WHEN 'source_group_cp' THEN CASE WHEN label = 0 THEN 'real_all' ELSE lower(generator) END ELSE CASE WHEN base_prediction = 0 THEN 'base_prediction_real' ELSE 'base_prediction_fake' END END AS pg
           FROM f, (VALUES ('global_cp'), ('source_group_cp'), ('predicted_class_cp')) v(policy))"""


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of all policies: each row is in one group of each."""
    f = scores(spark, sf_dir)
    kinds = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), S.policy_group(p, F.col("generator"), F.col("label"), F.col("base_prediction")).alias("pg")) for p in S.POLICIES]))
    halves = policy.half_split(_units(spark, sf_dir), "sha256", [F.col("split"), F.col("generator")], SEED).select("sha256", "subset")
    ctx = [*CTX, "policy"]
    rows = f.join(halves, "sha256").withColumn("_p", kinds).select("*", "_p.policy", "_p.pg")
    blocks = freeze(policy.group_blocks(rows, ["subset", *ctx], "pg"))
    cand = freeze(policy.candidates(policy.scan_blocks(_subset(blocks, "select"), ctx, _fits()), ctx))
    return freeze(policy.certify(_subset(blocks, "certify"), cand, ctx, None, ALPHA, DELTA))


TRACE3 = f"{WITH_POLICIES}, {trace_sql(KEYS, 'pg', 'f3')}, {policy_sql(KEYS)}"


@query("certified_policies", f"WITH {SCORES}, {TRACE3} SELECT detector, split, policy, candidate_id, round(tau, 9) AS tau, accepted_count, round(max_cp_upper, 9) AS max_cp_upper, status FROM po")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.certified_policy(_policies(spark, sf_dir), [*CTX, "policy"]), 9)


@query("policy_comparison_wide", f"""
    WITH {SCORES}, {TRACE3} SELECT detector, split, max(CASE WHEN policy = 'global_cp' THEN accepted_count END) AS global_cp_accepted_count, max(CASE WHEN policy = 'global_cp' THEN status END) AS global_cp_status,
        max(CASE WHEN policy = 'source_group_cp' THEN accepted_count END) AS source_group_cp_accepted_count, max(CASE WHEN policy = 'source_group_cp' THEN status END) AS source_group_cp_status,
        max(CASE WHEN policy = 'predicted_class_cp' THEN accepted_count END) AS predicted_class_cp_accepted_count, max(CASE WHEN policy = 'predicted_class_cp' THEN status END) AS predicted_class_cp_status,
        max(CASE WHEN policy = 'source_group_cp' THEN accepted_count END) - max(CASE WHEN policy = 'global_cp' THEN accepted_count END) AS source_minus_global, max(CASE WHEN policy = 'source_group_cp' THEN accepted_count END) - max(CASE WHEN policy = 'predicted_class_cp' THEN accepted_count END) AS source_minus_predicted,
        CASE WHEN bool_or(policy = 'source_group_cp' AND status = 'CERTIFIED') THEN 'source_group_cp' WHEN bool_or(policy = 'global_cp' AND status = 'CERTIFIED') THEN 'global_cp_only' WHEN bool_or(policy = 'predicted_class_cp' AND status = 'CERTIFIED') THEN 'predicted_class_cp_only' ELSE 'none' END AS takeaway FROM po GROUP BY detector, split""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = policy.certified_policy(_policies(spark, sf_dir), [*CTX, "policy"])
    wide = chosen.groupBy(*CTX).pivot("policy", list(S.POLICIES)).agg(F.max("accepted_count").alias("accepted_count"), F.max("status").alias("status"))
    own = lambda p: F.col(f"{p}_status") == "CERTIFIED"
    takeaway = F.when(own("source_group_cp"), "source_group_cp").when(own("global_cp"), "global_cp_only").when(own("predicted_class_cp"), "predicted_class_cp_only").otherwise("none")
    a = "source_group_cp_accepted_count"
    return wide.withColumns({"source_minus_global": F.col(a) - F.col("global_cp_accepted_count"), "source_minus_predicted": F.col(a) - F.col("predicted_class_cp_accepted_count"), "takeaway": takeaway})


# Summaries.

AREAS = """
    ar AS (SELECT detector, split, CASE WHEN max(least(pt, nt)) > 0 THEN sum(CAST(neg AS DOUBLE) * (tp - pos) + CAST(neg AS DOUBLE) * pos / 2) / max(CAST(pt AS DOUBLE) * nt) END AS auroc, sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / nullif(max(pt), 0) AS ap, CASE WHEN max(least(pt, nt)) = 0 THEN 'single_class' ELSE 'ok' END AS status FROM cu GROUP BY detector, split)"""
OPTIMAL = "coalesce(list_sum([CAST(j AS DOUBLE) / (n - errors + j) FOR j IN range(1, errors + 1)]), 0) / n"
SUMMARY = ["error_detection_AUROC", "error_detection_AUPR", "AURC", "E_AURC", *[f"risk_at_{c * 100:.0f}pct_coverage" for c in ranking.COVERAGES], *[f"coverage_{kind}_risk_le_{a * 100:.0f}pct" for kind in ("empirical", "cp") for a in ranking.RISKS]]


@query("metric_summary_long", f"""
    WITH {SCORES}, {PREFIX}, {ROC.format(s='risk_score', y='base_error')}, {AREAS},
    s AS (SELECT detector, split, avg(e / k) AS "AURC", count(*) AS n, CAST(sum(base_error) AS BIGINT) AS errors, {', '.join(f'max(CASE WHEN k = greatest(1, CAST(ceil(CAST({c} AS DOUBLE) * n) AS BIGINT)) THEN e / k END) AS risk_at_{c * 100:.0f}pct_coverage' for c in ranking.COVERAGES)},
          {', '.join(f'coalesce(max(CASE WHEN e / k <= CAST({a} AS DOUBLE) THEN k END), 0) / CAST(count(*) AS DOUBLE) AS coverage_empirical_risk_le_{a * 100:.0f}pct' for a in ranking.RISKS)},
          {', '.join(f"coalesce(max(CASE WHEN e < k AND e <= CAST({a} AS DOUBLE) * k AND {tail_sql('CAST(e AS BIGINT)', 'k', f'CAST({a} AS DOUBLE)')} <= 0.05 THEN k END), 0) / CAST(count(*) AS DOUBLE) AS coverage_cp_risk_le_{a * 100:.0f}pct" for a in ranking.RISKS)}
          FROM r GROUP BY detector, split),
    w AS (SELECT s.*, "AURC" - {OPTIMAL} AS "E_AURC", auroc AS "error_detection_AUROC", ap AS "error_detection_AUPR", status AS st FROM s JOIN ar ON s.detector = ar.detector AND s.split = ar.split)
    {' UNION ALL '.join(f'''SELECT detector, split, '{m}' AS metric, round("{m}", 6) AS value, {"st" if m.startswith("error") else "'ok'"} AS status FROM w''' for m in SUMMARY)}""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.metric_summary(scores(spark, sf_dir), CTX))


@query("calibrator_bundle", f"""
    WITH {SCORES.replace('AS base_error FROM f2)', 'AS base_error FROM f2)')}, {PREFIX}, {ROC.format(s='risk_score', y='base_error')}, {AREAS}, {BINS.replace('p * 15', 'risk_score * 15').replace('avg(p)', 'avg(risk_score)').replace('avg(label)', 'avg(base_error)')},
    ca AS (SELECT detector, split, sum(n * coalesce(gap, 0)) / sum(n) AS ece, max(gap) AS mce FROM h GROUP BY detector, split),
    nb AS (SELECT detector, split, avg(-(base_error * ln(q) + (1 - base_error) * ln(1 - q))) AS nll, avg((risk_score - base_error) * (risk_score - base_error)) AS brier, avg(risk_score) AS mean_risk FROM (SELECT *, least(greatest(risk_score, 1e-15), 1 - 1e-15) AS q FROM f) GROUP BY detector, split),
    s AS (SELECT detector, split, avg(e / k) AS aurc, count(*) AS n, CAST(sum(base_error) AS BIGINT) AS errors FROM r GROUP BY detector, split)
    SELECT s.detector, s.split, n AS row_count, errors AS error_count, round(CAST(errors AS DOUBLE) / n, 6) AS error_prevalence, round(mean_risk, 6) AS mean_predicted_risk, round(CAST(errors AS DOUBLE) / n, 6) AS observed_error_prevalence, round(nll, 6) AS binary_nll, round(brier, 6) AS brier_score,
           round(ece, 6) AS ece, round(mce, 6) AS maximum_calibration_error, round(auroc, 6) AS "error_detection_AUROC", round(CASE WHEN status = 'ok' THEN ap END, 6) AS "error_detection_AUPR", CASE WHEN status = 'ok' THEN 'ok' ELSE 'undefined_single_error_class' END AS ranking_status, round(aurc, 6) AS "AURC", round(aurc - {OPTIMAL}, 6) AS "E_AURC"
    FROM s JOIN ca USING (detector, split) JOIN nb USING (detector, split) JOIN ar USING (detector, split)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibrator_bundle(scores(spark, sf_dir), CTX))


@query("threshold_map_metrics", f"""
    WITH {SCORES}, m(detector, threshold) AS (VALUES ('a', CAST(0.2 AS DOUBLE)), ('b', 0.3), ('c', NULL)), j AS (SELECT f.*, coalesce(risk_score <= threshold, false) AS a FROM f JOIN m USING (detector))
    SELECT detector, split, count(*) AS n, count(CASE WHEN a THEN 1 END) AS accepted_count, CAST(sum(CASE WHEN a THEN base_error ELSE 0 END) AS BIGINT) AS accepted_errors FROM j GROUP BY detector, split""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = scores(spark, sf_dir).select(*CTX).distinct()
    known = cells.withColumn("threshold", F.when(F.col("detector") == "a", 0.2).when(F.col("detector") == "b", 0.3))
    rows = relational.with_thresholds(scores(spark, sf_dir), known, CTX)
    return evaluate.accepted_metrics(rows.withColumn("accepted", S.accepted(F.col("risk_score"), F.col("threshold"))), CTX).select(*CTX, "n", "accepted_count", "accepted_errors")


@query("bootstrap_categories", f"""
    WITH {SCORES}, {ACC} SELECT detector, split, CASE WHEN NOT a THEN 'rejected' WHEN label = 0 AND base_prediction = 1 THEN 'accepted_real_error' WHEN label = 0 THEN 'accepted_real_correct' WHEN label = 1 AND base_prediction = 0 THEN 'accepted_fake_error' ELSE 'accepted_fake_correct' END AS category, count(*) AS n FROM ac GROUP BY ALL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir).groupBy(*CTX, "category").agg(F.count("*").alias("n"))


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir).withColumn("category", S.bootstrap_category(F.col("accepted"), F.col("label"), F.col("base_prediction"), F.col("base_error")))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of detector a with both methods' acceptance: its own threshold, and that of detector b's risk."""
    f = _accepted(spark, sf_dir)
    other = f.where("detector = 'b'").select("sample_id", F.col("accepted").alias("second"))
    both = f.where("detector = 'a'").join(other, "sample_id")
    return both.withColumn("category", S.paired_category(F.col("generator"), F.col("label"), F.col("base_prediction"), F.col("base_error"), F.col("accepted"), F.col("second")))


@query("paired_categories", f"""
    WITH {SCORES}, {ACC}, j AS (SELECT x.*, y.a AS b FROM ac x JOIN ac y ON x.sample_id = y.sample_id AND x.detector = 'a' AND y.detector = 'b')
    SELECT split, concat_ws('|', CASE WHEN label = 0 THEN 'real_all' ELSE generator END, label, base_prediction, base_error, CAST(a AS INT), CAST(b AS INT)) AS category, count(*) AS n FROM j GROUP BY ALL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).groupBy("split", "category").agg(F.count("*").alias("n"))


# Bootstraps. Replicates are a parameter; the queries draw REPLICATES, categories as many as reports do.

REPLICATES, MANY = 10, 2000
DRAWN = f"""
    us AS (SELECT DISTINCT generator, sha256 FROM f), un AS (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY sha256) AS k, count(*) OVER (PARTITION BY generator) AS n FROM us),
    dr AS (SELECT replicate, generator, least(CAST(floor((CAST('0x' || substr(sha256('5|' || replicate || '|' || sha256), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE * n) AS BIGINT) + 1, n) AS k FROM un, (SELECT CAST(i AS INT) AS replicate FROM range(0, {REPLICATES}) t(i))),
    wu AS (SELECT replicate, sha256, count(*) AS weight FROM dr JOIN un USING (generator, k) GROUP BY ALL)"""
EXPANDED = """
    xp AS (SELECT detector, replicate, risk_score, sample_id, base_error, unnest(range(0, weight)) AS copy FROM {source} JOIN {weights}),
    xr AS (SELECT detector, replicate, row_number() OVER w AS k, sum(base_error) OVER w AS e, base_error FROM xp WINDOW w AS (PARTITION BY detector, replicate ORDER BY risk_score, sample_id, copy ROWS UNBOUNDED PRECEDING)),
    xs AS (SELECT detector, replicate, avg(e / k) AS draw, count(*) AS n, CAST(sum(base_error) AS BIGINT) AS errors FROM xr GROUP BY ALL)"""


@query("stratified_unit_aurc_draws", f"WITH {SCORES}, {DRAWN}, {EXPANDED.format(source='(SELECT detector, generator, sha256, sample_id, risk_score, base_error FROM f) q', weights='wu USING (sha256)')} SELECT detector, replicate, round(draw, 6) AS draw, round(draw - {OPTIMAL}, 6) AS excess FROM xs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scores(spark, sf_dir)
    one = f.select("generator", "sha256", "sample_id").distinct()
    return rounded(resample.repeated_aurcs(resample.by_weights(f, _unit_weights(one), "sha256"), ["detector"], REPLICATES))


def _unit_weights(rows: DataFrame) -> DataFrame:
    """Weights of units drawn by generator; a unit that is in several strata is drawn in each, and its weights add up."""
    return resample.wide_weights(resample.drawn_units(rows, "sha256", ["generator"], REPLICATES, 5), "sha256", REPLICATES)


@query("row_paired_aurc_draws", f"""
    WITH {SCORES}, us AS (SELECT DISTINCT sample_id FROM f), un AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS k, count(*) OVER () AS n FROM us),
    dr AS (SELECT replicate, least(CAST(floor((CAST('0x' || substr(sha256('5|' || replicate || '|' || sample_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE * n) AS BIGINT) + 1, n) AS k FROM un, (SELECT CAST(i AS INT) AS replicate FROM range(0, 4) t(i))),
    wu AS (SELECT replicate, sample_id, count(*) AS weight FROM dr JOIN un USING (k) GROUP BY ALL), {EXPANDED.format(source="(SELECT * FROM f WHERE detector <> 'c') q", weights='wu USING (sample_id)')}
    SELECT x.replicate, round(x.draw - y.draw, 6) AS draw FROM xs x JOIN xs y ON x.replicate = y.replicate AND x.detector = 'a' AND y.detector = 'b'""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scores(spark, sf_dir).where("detector <> 'c'")
    weights = resample.wide_weights(resample.drawn_units(f, "sample_id", [], 4, 5), "sample_id", 4)
    draws = resample.repeated_aurcs(resample.by_weights(f, weights, "sample_id"), ["detector"], 4)
    return rounded(resample.paired_difference(draws.withColumn("pair", F.lit(1)), ["pair"], "detector", "a", "b").drop("pair"))


@query("stratified_poisson_nll_draws", f"""
    WITH {SCORES}, rep AS (SELECT CAST(i AS INT) AS replicate FROM range(0, {REPLICATES}) t(i)),
    uq AS (SELECT generator, sha256, replicate, (CAST('0x' || substr(sha256('9|' || replicate || '|' || sha256), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM (SELECT DISTINCT generator, sha256 FROM f), rep),
    w0 AS (SELECT *, len(list_filter({'[' + ', '.join(f'{c!r}::DOUBLE' for c in resample.POISSON) + ']'}, lambda c: c < u)) AS w FROM uq), w1 AS (SELECT *, sum(w) OVER (PARTITION BY generator, replicate) AS t, row_number() OVER (PARTITION BY generator, replicate ORDER BY u DESC, sha256 DESC) AS k FROM w0),
    we AS (SELECT replicate, sha256, sum(CASE WHEN t = 0 AND k = 1 THEN 1 ELSE w END) AS weight FROM w1 GROUP BY ALL), nl AS (SELECT detector, sha256, -(label * ln(q) + (1 - label) * ln(1 - q)) AS nll FROM (SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM f))
    SELECT detector, replicate, round(sum(weight * nll) / nullif(sum(weight), 0), 6) AS draw FROM nl JOIN we USING (sha256) GROUP BY ALL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.stratified_poisson_means(scores(spark, sf_dir), ["detector"], S.nll(F.col("p"), F.col("label")), "sha256", ["generator"], REPLICATES, 9))


def _strata(rows: DataFrame, ctx: list[str]) -> DataFrame:
    return rows.groupBy(*ctx, F.concat_ws("/", "label", "generator").alias("stratum"), "category").agg(F.count("*").alias("n"))


@query("category_bootstrap_ci")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of five ratio metrics from MANY multinomial draws; only counts are drawn."""
    counts = resample.multinomial_counts(_strata(_categories(spark, sf_dir), CTX), CTX, "stratum", "category", MANY, SEED)
    return rounded(resample.percentile_ci(resample.category_metrics(counts, CTX), [*CTX, "metric"]))


@query("paired_category_bootstrap_ci")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the difference of two methods in five metrics, and whether they leave out 0."""
    counts = resample.multinomial_counts(_strata(_paired(spark, sf_dir), ["split"]), ["split"], "stratum", "category", MANY, SEED)
    return rounded(resample.resolved(resample.percentile_ci(resample.paired_metrics(counts, ["split"]), ["split", "metric"])))


# The choice of k.

KS = (1, 5, 10, 20)
BY_K = f"""
    {DISTANCES.format(on='q.id <> b.id AND q.fold <> b.fold')}, ak AS (SELECT query_id, place AS k, avg(distance) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS risk FROM n WHERE place <= 20),
    kr AS (SELECT query_id, CAST(k AS INT) AS k, risk, CAST(fold AS INT) AS fold, CAST(label % 2 AS INT) AS y FROM ak JOIN e ON e.id = query_id JOIN (SELECT vec_id, label FROM embeddings) l ON l.vec_id = query_id WHERE k IN {KS}),
    kb AS (SELECT fold, k, risk, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM kr GROUP BY ALL), kc AS (SELECT *, sum(pos) OVER (PARTITION BY fold, k ORDER BY risk DESC ROWS UNBOUNDED PRECEDING) AS tp FROM kb),
    ka AS (SELECT fold, k, sum(neg * (tp - pos) + neg * pos / 2) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM kc GROUP BY fold, k), kp AS (SELECT k, round(avg(auroc), 12) AS m FROM ka WHERE auroc IS NOT NULL GROUP BY k ORDER BY m DESC, k LIMIT 1)"""


def _errors(bank: DataFrame) -> DataFrame:
    return bank.select(F.col("id").alias("query_id"), "fold", F.pmod("label", F.lit(2)).cast("int").alias("base_error"))


@query("knn_select_k", f"WITH {BY_K} SELECT fold, ka.k, round(auroc, 6) AS auroc, CASE WHEN auroc IS NULL THEN 'undefined_due_to_single_error_class' ELSE 'ok' END AS status, kp.k AS selected_k FROM ka, kp")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir)
    found = freeze(distance.knn(bank, bank, max(KS), exclude=["id", "fold"]))
    return rounded(distance.select_k(found, _errors(bank), list(KS))[1])


@query("knn_bank_sensitivity", """
    WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.id AS query_id, b.id AS bank_id, round(1 - list_cosine_similarity(q.v, b.v), 12) AS distance FROM e q JOIN e b ON q.id <> b.id),
    a AS (SELECT query_id, avg(distance) AS a FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) AS place FROM d) WHERE place <= 10 GROUP BY query_id),
    b AS (SELECT query_id, avg(distance) AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) AS place FROM d WHERE bank_id % 2 = 0) WHERE place <= 10 GROUP BY query_id),
    j AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM a JOIN b USING (query_id))
    SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mean_abs_difference, round(max(abs(a - b)), 6) AS max_abs_difference, round(corr(ra, rb), 6) AS spearman, true AS selected_k_equal, corr(ra, rb) < 0.999 AS material FROM j""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir)
    risk = lambda own: distance.knn_risk(distance.knn(bank, own, 10), 10).select("query_id", "risk")
    return rounded(distance.bank_sensitivity(risk(bank), risk(bank.where("id % 2 = 0")), (10, 10)))


