"""Queries of audits, manifests, identities, perturbed policies, checked joins and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauplane.functions import scores as S
from tauplane.functions import text as X
from tauplane.operators import audit, distance, evaluate, ranking, relational
from tauplane.plans.catalog import ACC, BLOCKS, COEFFICIENTS, CTX, FEATURES, INTERCEPT, NAMES, PREFIX, ROC, TRANSFORMED, _accepted, _bank, _features, query, rounded
from tauplane.plans.frames import GAMMA, ORBIT, SCORES, TEXTS, orbit, scores, table, texts
from tauplane.sources import tables
from tauplane.sources.freeze import mutations, payload_hash, shared_folder

# Features and scores.


@query("boundary_margins", f"""
    WITH {ORBIT}, {FEATURES} SELECT parent, i AS view_index, round(c * z[i + 1], 6) + 0.0::DOUBLE AS margin, round(c * (z0 - z[i + 1]), 6) + 0.0::DOUBLE AS erosion FROM s, (SELECT CAST(i AS INT) AS i FROM range(0, 5) t(i))""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = orbit(spark, sf_dir).groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("view_index", "logit"))), lambda s: s["logit"]).alias("z")).where("size(z) = 5")
    both = z.select("parent", S.boundary_margins(F.col("z"), GAMMA).alias("m"), F.concat(F.array(F.lit(0.0)), S.checked_erosions(F.col("z"), GAMMA)).alias("e"))
    rows = both.select("parent", F.posexplode(F.arrays_zip("m", "e")).alias("view_index", "x"))
    plain = lambda c: F.round(c, 6) + F.lit(0.0)  # noqa: E731  (no negative zero)
    return rows.select("parent", "view_index", plain(F.col("x.m")).alias("margin"), plain(F.col("x.e")).alias("erosion"))


@query("recovered_thresholds", f"WITH {ORBIT}, {FEATURES} SELECT parent, round(CASE WHEN z0 >= 0 THEN z0 - margin_distance ELSE z0 + margin_distance END, 6) AS gamma, round(ln(least(greatest(1 / (1 + exp(-z0)), 1e-6), 1 - 1e-6) / (1 - least(greatest(1 / (1 + exp(-z0)), 1e-6), 1 - 1e-6))), 6) AS logit FROM x")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return rounded(f.select("parent", S.recovered_gamma((F.col("z0") >= GAMMA).cast("int"), F.col("z0"), F.col("margin_distance")).alias("gamma"), S.logit(S.sigmoid(F.col("z0")), 1e-6).alias("logit")))


@query("legacy_feature_bundle", f"""
    WITH {ORBIT}, {FEATURES}, ev AS (SELECT vec_id // 5 AS parent, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), g AS (SELECT parent, min_by(v, vec_id) AS f, min(vec_id) AS m FROM ev GROUP BY parent HAVING count(*) = 5),
    dr AS (SELECT parent, avg(1 - least(greatest(list_cosine_similarity(v, f), -1), 1)) AS drift FROM ev JOIN g USING (parent) WHERE vec_id <> m GROUP BY parent),
    nn AS (SELECT q.vec_id AS id, min(round(1 - list_cosine_similarity(q.v, b.v), 12)) AS d FROM ev q JOIN ev b ON q.vec_id <> b.vec_id GROUP BY q.vec_id), su AS (SELECT id // 5 AS parent, max(d) AS support FROM nn GROUP BY ALL)
    SELECT parent, round(margin_distance, 6) AS margin_distance, round(orbit_logit_variance, 6) AS orbit_logit_variance, round(drift, 6) AS embedding_drift_mean, round(support, 6) AS orbit_support_distance_max FROM x JOIN dr USING (parent) JOIN su USING (parent)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.floor(F.col("vec_id") / 5)
    e = table(spark, sf_dir, "embeddings").select(parent.alias("parent"), "vec_id", S.unit(F.col("embedding")).alias("v"))
    drift = e.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("views")).where("size(views) = 5").select("parent", S.embedding_drift(F.col("views")).alias("embedding_drift_mean"))
    bank = _bank(spark, sf_dir)
    support = distance.knn(bank, bank, 1).groupBy(F.floor(F.col("query_id") / 5).alias("parent")).agg(F.max("distance").alias("orbit_support_distance_max"))
    return rounded(_features(spark, sf_dir).select("parent", "margin_distance", "orbit_logit_variance").join(drift, "parent").join(support, "parent"))


RISK = "1 / (1 + exp(-(-0.5::DOUBLE + 0.8::DOUBLE * {a} + 0.4::DOUBLE * {b} + 0.6::DOUBLE * {c} + 0.2::DOUBLE * {d})))"


@query("leave_one_view_rescoring", f"""
    WITH {ORBIT}, {FEATURES}, {TRANSFORMED}, lv AS (SELECT p.parent, p.view_index AS omitted, var_pop(q.logit) AS v FROM o p JOIN o q ON p.parent = q.parent AND p.view_index <> q.view_index GROUP BY ALL),
    j AS (SELECT omitted, {RISK.format(a='a', b='b', c='c', d='d')} AS r0, {RISK.format(a='a', b='ln(1 + v)', c='c', d='d')} AS r1, CAST(parent % 3 = 0 AS INT) AS e FROM t JOIN lv USING (parent))
    SELECT omitted, count(*) AS row_count, round(avg(r1 - r0), 6) AS mean_risk_score_change, round(median(abs(r1 - r0)), 6) AS median_absolute_risk_score_change, count(CASE WHEN (r0 <= 0.4) <> (r1 <= 0.4) THEN 1 END) AS acceptance_status_change_count,
           round(avg(CAST((r0 <= 0.4) <> (r1 <= 0.4) AS INT)), 6) AS acceptance_status_change_rate, count(CASE WHEN r0 <= 0.4 AND r1 > 0.4 AND e = 0 THEN 1 END) AS correct_to_rejected_flips, count(CASE WHEN r0 > 0.4 AND r1 <= 0.4 AND e = 1 THEN 1 END) AS error_to_accepted_flips FROM j GROUP BY omitted""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    rest = evaluate.leave_one_view(orbit(spark, sf_dir), "parent", "view_index", "logit")
    both = f.join(rest, "parent")
    risk = lambda df: S.logistic_risk([S.transformed(n) for n in NAMES], COEFFICIENTS, INTERCEPT)
    scored = both.withColumn("original", risk(both)).withColumn("orbit_logit_variance", F.col("variance")).withColumn("changed", risk(both))
    rows = scored.withColumn("base_error", (F.pmod("parent", F.lit(3)) == 0).cast("int"))
    return rounded(evaluate.perturbed_policy(rows, ["omitted"], "original", "changed", F.lit(0.4)))


# Identities and text.


@query("view_identities", "SELECT doc_id, sha256('v1' || coalesce(lang, '-') || '{}') AS chain, sha256(CAST(doc_id AS VARCHAR) || sha256(text) || sha256('v1' || coalesce(lang, '-') || '{}')) AS view_id, CAST(('0x' || substr(sha256(text), 1, 8)) AS BIGINT) % 1000000 AS seed_offset FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"), X.seed_offset(F.col("text")).alias("seed_offset"), X.chain_id(F.lit("v1"), F.coalesce("lang", F.lit("-")), F.lit("{}")).alias("chain"))
    return rows.select("doc_id", "chain", X.view_id(F.col("doc_id"), F.col("d"), F.col("chain")).alias("view_id"), "seed_offset")


@query("log_counters", "SELECT o_orderkey, o_orderkey % 7 AS failed, o_orderkey % 300 AS passed FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    log = F.concat(F.lit("== "), F.when(k % 7 > 0, F.concat((k % 7).cast("string"), F.lit(" failed, "))).otherwise(""), (k % 300).cast("string"), F.lit(" passed in 2.31s =="))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.log_count(log, "failed").alias("failed"), X.log_count(log, "passed").alias("passed"))


@query("other_context_mentions", "SELECT doc_id, doc_id % 4 IN (0, 1, 2) AS mentions FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    path = F.when(k == 0, "a/SPLIT_B/x.csv").when(k == 1, "a/run_split_b_1.json;b").when(k == 2, "a/split_b.parquet").otherwise("a/split_bb.txt;split_a/x.csv")
    return table(spark, sf_dir, "documents").select("doc_id", X.other_context(path, "split_b").alias("mentions"))


@query("rendered_values_equal", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN false ELSE true END AS same FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    a = F.when(k == 0, "0.5").when(k == 1, "undefined_zero_denominator").when(k == 2, "certified").otherwise("0.5")
    b = F.when(k == 0, "0.50000000000001").when(k == 1, "undefined").when(k == 2, "certified").otherwise("undefined")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.same_value(a, b).alias("same"))


# Audits.


@query("manifest_audit", """
    WITH d AS (SELECT *, CASE WHEN doc_id % 10 < 6 THEN 'risk_fit' WHEN doc_id % 10 < 8 THEN 'calibration' ELSE 'test' END AS split FROM documents), k AS (SELECT source, bool_or(split = 'calibration') AND bool_or(split = 'test') AS in_each FROM d GROUP BY source)
    SELECT "check", violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT 'missing_columns' AS "check", CAST(1 AS BIGINT) AS violations UNION ALL SELECT 'external_rows_in_training_splits', count(CASE WHEN lang = 'de' AND split = 'risk_fit' THEN 1 END) FROM d UNION ALL SELECT 'shared_transformations', count(CASE WHEN in_each THEN 1 END) FROM k)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 10
    d = table(spark, sf_dir, "documents").withColumn("split", F.when(k < 6, "risk_fit").when(k < 8, "calibration").otherwise("test"))
    return audit.manifest_audit(d, ["doc_id", "text", "phash"], F.col("lang") == "de", "split", ["risk_fit"], "calibration", ["test"], F.col("source"))


@query("score_artifact_audit", f"""
    WITH {SCORES}, s AS (SELECT *, CASE WHEN sample_id LIKE '%7' AND detector = 'b' THEN 1.5 ELSE p END AS q FROM f WHERE NOT (detector = 'c' AND sample_id LIKE '%77')), du AS (SELECT detector, sum(m - 1) AS duplicate_rows FROM (SELECT detector, sample_id, count(*) AS m FROM s GROUP BY ALL) GROUP BY detector),
    ex AS (SELECT detector, count(*) AS expected_rows FROM f GROUP BY detector), a AS (SELECT detector, count(*) AS actual_rows, CAST(0 AS BIGINT) AS nonfinite_logit_count, count(CASE WHEN q IS NULL THEN 1 END) AS nonfinite_probability_count, count(CASE WHEN q < 0 THEN 1 END) AS probability_below_zero_count, count(CASE WHEN q > 1 THEN 1 END) AS probability_above_one_count,
        max(abs(CASE WHEN score >= 0 THEN 1 / (1 + exp(-score)) ELSE exp(score) / (1 + exp(score)) END - q)) AS gap FROM s GROUP BY detector)
    SELECT ex.detector, expected_rows, actual_rows, expected_rows - actual_rows AS missing_rows, CAST(duplicate_rows AS BIGINT) AS duplicate_rows, nonfinite_logit_count, nonfinite_probability_count, probability_below_zero_count, probability_above_one_count, round(gap, 4) AS max_sigmoid_probability_gap,
           CASE WHEN expected_rows = actual_rows AND duplicate_rows = 0 AND probability_above_one_count = 0 AND probability_below_zero_count = 0 AND nonfinite_probability_count = 0 AND gap <= 1e-6 THEN 'pass' ELSE 'fail' END AS status FROM ex JOIN a USING (detector) JOIN du USING (detector)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scores(spark, sf_dir).select("detector", "sample_id", "score", "p")
    found = f.where("NOT (detector = 'c' AND sample_id LIKE '%77')").withColumn("p", F.when(F.col("sample_id").endswith("7") & (F.col("detector") == "b"), 1.5).otherwise(F.col("p")))
    return rounded(audit.score_audit(found, f, ["sample_id"], "score", "p", ["detector"], 1e-6), 4)


@query("formula_audit", f"""
    WITH {SCORES}, w AS (SELECT detector, count(*) AS n, max(abs(risk_score - (1 - greatest(p, 1 - p)))) AS a, max(abs(p - CASE WHEN score >= 0 THEN 1 / (1 + exp(-score)) ELSE exp(score) / (1 + exp(score)) END)) AS b, max(abs(risk_score - abs(p - 0.4))) AS c FROM f GROUP BY detector)
    SELECT detector, n, method, round(d, 6) AS max_abs_difference, CASE WHEN d <= 1e-6 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT detector, n, 'msp' AS method, a AS d FROM w UNION ALL SELECT detector, n, 'sigmoid', b FROM w UNION ALL SELECT detector, n, 'wrong', c FROM w)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    formulas = {"msp": (F.col("risk_score"), S.msp_risk(F.col("p"))), "sigmoid": (F.col("p"), S.sigmoid(F.col("score"))), "wrong": (F.col("risk_score"), F.abs(F.col("p") - 0.4))}
    return rounded(audit.formula_audit(scores(spark, sf_dir), ["detector"], formulas))


@query("curve_audit", f"""
    WITH {SCORES}, {BLOCKS}, v AS (SELECT detector, split, accepted_count, CAST(accepted_count AS DOUBLE) / n AS c, CASE WHEN accepted_count % 10 = 3 THEN NULL ELSE CAST(accepted_errors AS DOUBLE) / accepted_count END AS r FROM c)
    SELECT detector, split, count(*) AS plotted_points, round(min(c), 6) AS coverage_min, round(max(c), 6) AS coverage_max, round(min(r), 6) AS risk_min, round(max(r), 6) AS risk_max, count(c) - count(DISTINCT c) AS duplicate_coverage_count, CASE WHEN count(CASE WHEN r IS NULL THEN 1 END) > 0 THEN 'empirical_risk' ELSE '' END AS missing_value_columns,
           coalesce(bool_or(c NOT BETWEEN 0 AND 1 OR r NOT BETWEEN 0 AND 0.3), false) AS axis_clipping, count(CASE WHEN c <= 0.01 THEN 1 END) AS low_coverage_points, coalesce(max(CASE WHEN c <= 0.01 THEN accepted_count END), 0) AS low_coverage_accepted_max, round(max(CASE WHEN c <= 0.01 THEN r END), 6) AS low_coverage_risk_max, count(CASE WHEN r IS NULL THEN 1 END) > 0 AS missing_values
    FROM v GROUP BY detector, split""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = ranking.prefix_blocks(scores(spark, sf_dir), CTX).withColumn("empirical_risk", F.when(F.col("accepted_count") % 10 == 3, None).otherwise(F.col("empirical_risk")))
    return rounded(audit.curve_audit(curves, CTX, (0.0, 1.0), (0.0, 0.3)))


@query("identity_restoration", f"WITH {TEXTS} SELECT lang, count(*) AS row_count, count(DISTINCT sha256) AS unique_sha256, count(DISTINCT doc_id) AS unique_sample_id, count(DISTINCT source) AS unique_source_id, count(CASE WHEN coalesce(source, '') IN ('', 'nan', 'None') THEN 1 END) AS unresolved_source_id_count, CASE WHEN count(*) = 20 AND count(DISTINCT sha256) = 20 AND count(CASE WHEN coalesce(source, '') IN ('', 'nan', 'None') THEN 1 END) = 0 THEN 'pass' ELSE 'fail' END AS status FROM t GROUP BY lang")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.identity_audit(texts(spark, sf_dir), ["lang"], "doc_id", "sha256", "source", 20)


CLAIMS = [
    ("c1", "LOCKED_SUPPORTED", "coverage holds", "", "a.csv, b.csv::table"), ("c2", "LOCKED_QUALIFIED", "it is   State of the Art", "", "a.csv"), ("c3", "LOCKED_SUPPORTED", "risk is bounded", "", " ; "),
    ("c4", "LOCKED_SUPPORTED", "risk falls", "", "gone.csv"), ("c5", "PROHIBITED", "state of the art", "", ""), ("c6", "OPEN", "not yet", "", ""),
]


@query("claim_audit", "VALUES ('c2', 'prohibited wording'), ('c3', 'missing evidence'), ('c4', 'missing artifact gone.csv') t(claim_id, failure)".replace("VALUES", "SELECT * FROM (VALUES").replace(" t(", ") t("))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.createDataFrame(CLAIMS, "claim_id string, status string, final_claim_text string, allowed_wording string, supporting_artifacts string")
    return audit.claim_audit(claims, spark.createDataFrame([("a.csv",), ("b.csv",)], "path string"), ["state of the art"])


@query("listing_audit", "SELECT * FROM (VALUES ('T2', 'not listed'), ('T1', 'missing latex_source'), ('T3', 'missing source hash')) t(item, failure)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = spark.createDataFrame([("T1", "a.csv", "gone.tex", "x"), ("T3", "a.csv", "b.tex", "")], "table_id string, csv_source string, latex_source string, hashes string")
    return audit.listing_audit(listing, "table_id", F.col("table_id"), ["T1", "T2", "T3"], ["csv_source", "latex_source"], F.col("hashes"), spark.createDataFrame([("a.csv",), ("b.tex",)], "path string"))


@query("frozen_payload_mutations", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'mutated' WHEN c_custkey % 10 = 1 THEN 'removed' ELSE 'unchanged' END AS status FROM customer UNION ALL SELECT -1, 'added'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    now = c.where("c_custkey % 10 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    new = c.limit(1).select(F.lit(-1).cast(c.schema["c_custkey"].dataType).alias("c_custkey"), "c_name", "c_acctbal")
    return mutations(payload_hash(c, ["c_custkey"]), now.unionByName(new), ["c_custkey"])


@query("detector_metrics", f"""
    WITH {SCORES}, {ROC.format(s='p', y='label').replace('detector, split', 'detector')}, ar AS (SELECT detector, sum(CAST(neg AS DOUBLE) * (tp - pos) + CAST(neg AS DOUBLE) * pos / 2) / max(CAST(pt AS DOUBLE) * nt) AS auroc, sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / max(pt) AS aupr FROM cu GROUP BY detector),
    g AS (SELECT detector, count(*) AS n, CAST(count(CASE WHEN base_error = 1 AND label = 0 THEN 1 END) AS DOUBLE) / count(CASE WHEN label = 0 THEN 1 END) AS far, CAST(count(CASE WHEN base_error = 1 AND label = 1 THEN 1 END) AS DOUBLE) / count(CASE WHEN label = 1 THEN 1 END) AS fnr, avg(1 - base_error) AS acc FROM f GROUP BY detector)
    SELECT detector, n, round(acc, 6) AS accuracy, round(far, 6) AS false_alarm_rate, round(fnr, 6) AS miss_rate, round(1 - (far + fnr) / 2, 6) AS balanced_accuracy, round(auroc, 6) AS auroc, round(aupr, 6) AS aupr FROM g JOIN ar USING (detector)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.detector_metrics(scores(spark, sf_dir), ["detector"]))


@query("domain_transfer_summary", f"""
    WITH {SCORES}, {ACC}, {PREFIX.replace('detector, split', 'detector, split, generator')}, m AS (SELECT detector, split, generator, CAST(count(CASE WHEN a THEN 1 END) AS DOUBLE) / count(*) AS coverage, CAST(count(CASE WHEN a AND er THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN a THEN 1 END), 0) AS risk, avg(base_error) AS err FROM ac GROUP BY ALL),
    w AS (SELECT detector, split, generator, avg(e / k) AS aurc FROM r GROUP BY ALL), y AS (SELECT detector, split, generator, max(x) AS worst FROM (SELECT detector, split, generator, label, CAST(count(CASE WHEN a AND er THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN a THEN 1 END), 0) AS x FROM ac GROUP BY ALL) GROUP BY ALL)
    SELECT detector, generator, round(avg(coverage), 6) AS mean_coverage, round(avg(risk), 6) AS mean_selective_risk, round(avg(err), 6) AS mean_base_error, round(avg(aurc), 6) AS mean_aurc, round(max(worst), 6) AS worst_group_selective_risk FROM m JOIN w USING (detector, split, generator) JOIN y USING (detector, split, generator) GROUP BY detector, generator""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = [*CTX, "generator"]
    f = _accepted(spark, sf_dir)
    own = evaluate.accepted_metrics(f, ctx).select(*ctx, "coverage", "selective_risk")
    worst = evaluate.worst_group(evaluate.group_metrics(f, ctx, [F.col("label").cast("string")]), ctx).select(*ctx, "worst_risk")
    errors = f.groupBy(*ctx).agg(F.avg(F.col("base_error").cast("double")).alias("base_error_rate"))
    rows = own.join(worst, ctx).join(errors, ctx).join(ranking.aurc(f, ctx).select(*ctx, "aurc"), ctx)
    return rounded(audit.transfer_summary(rows, ["detector", "generator"]))


@query("filled_quota_sample")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.sha2("text", 256).alias("sha256"))
    return audit.filled_quota_sample(d, "sha256", "doc_id", "lang", 100, 7)


# Joins.


@query("checked_lookup", "SELECT o_orderkey, o_custkey, c_nationkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    with_customer = relational.checked_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], "inner", complete=True)
    return relational.checked_join(with_customer, n, ["c_nationkey"], complete=True).select("o_orderkey", "o_custkey", "c_nationkey", "n_name")


@query("one_to_one_scores", f"WITH {SCORES}, m AS (SELECT detector, sample_id, max(risk_score) AS r FROM f GROUP BY ALL) SELECT x.sample_id, round(x.r, 6) AS risk_a, round(y.r, 6) AS risk_b FROM m x JOIN m y ON x.sample_id = y.sample_id AND x.detector = 'a' AND y.detector = 'b'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scores(spark, sf_dir)
    own = lambda d: f.where(F.col("detector") == d).groupBy("sample_id").agg(F.max("risk_score").alias(f"risk_{d}"))
    return rounded(relational.checked_join(own("a"), own("b"), ["sample_id"], validate="one_to_one", complete=True))


@query("ordered_lookup", "SELECT CAST(c_custkey AS BIGINT) AS position, c_custkey, c_name FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return relational.ordered_lookup(c, c.select(F.col("c_custkey").cast("long").alias("position"), "c_custkey"), "c_custkey").select("position", "c_custkey", "c_name")


@query("join_of_other_names", "SELECT x.o_orderkey AS source_id, y.l_orderkey AS sample_id, x.o_orderstatus AS status, y.l_linestatus AS status_view FROM orders x JOIN lineitem y ON x.o_orderkey = y.l_orderkey AND y.l_linenumber = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("status"))
    b = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linestatus").alias("status_view"))
    return a.join(b, F.col("source_id") == F.col("sample_id"))


@query("near_equal_join", "SELECT c.c_custkey, a.alpha FROM customer c JOIN (VALUES (CAST(0.01 AS DOUBLE)), (0.02), (0.05)) a(alpha) ON abs((c.c_custkey % 7 + 1) / CAST(100 AS DOUBLE) - alpha) <= 1e-9")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphas = F.broadcast(spark.createDataFrame([(0.01,), (0.02,), (0.05,)], "alpha double"))  # three rows
    c = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 7 + 1) / F.lit(100.0)).alias("x"))
    return c.join(alphas, relational.is_near(F.col("x"), F.col("alpha"), 1e-9)).select("c_custkey", "alpha")


@query("old_and_new_metrics", f"""
    WITH {SCORES}, m AS (SELECT detector, split, t, CAST(count(CASE WHEN risk_score <= t THEN 1 END) AS DOUBLE) / count(*) AS c FROM f, (VALUES (CAST(0.2 AS DOUBLE)), (0.21)) v(t) GROUP BY ALL)
    SELECT x.detector, x.split, round(x.c, 6) AS old_coverage, round(y.c, 6) AS new_coverage, round(y.c - x.c, 6) AS delta_coverage FROM m x JOIN m y ON x.detector = y.detector AND x.split = y.split AND x.t = CAST(0.2 AS DOUBLE) AND y.t = CAST(0.21 AS DOUBLE)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scores(spark, sf_dir)
    own = lambda t: evaluate.accepted_metrics(f.withColumn("accepted", S.accepted(F.col("risk_score"), F.lit(t))), CTX).select(*CTX, "coverage")
    return rounded(relational.old_and_new(own(0.2), own(0.21), CTX, ["coverage"]))


@query("pivot_by_alpha", f"""
    WITH {SCORES}, m AS (SELECT detector, split, a, count(CASE WHEN risk_score <= a THEN 1 END) AS n, CAST(sum(CASE WHEN risk_score <= a THEN base_error ELSE 0 END) AS BIGINT) AS e FROM f, (VALUES (CAST(0.1 AS DOUBLE)), (0.3)) v(a) GROUP BY ALL)
    SELECT detector, split, max(CASE WHEN a < 0.2 THEN n END) AS "0.1_accepted_count", max(CASE WHEN a < 0.2 THEN e END) AS "0.1_accepted_errors", max(CASE WHEN a > 0.2 THEN n END) AS "0.3_accepted_count", max(CASE WHEN a > 0.2 THEN e END) AS "0.3_accepted_errors" FROM m GROUP BY ALL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumn("a", F.explode(F.array(F.lit(0.1), F.lit(0.3)))).withColumn("in", F.col("risk_score") <= F.col("a"))
    return rows.groupBy(*CTX).pivot("a", [0.1, 0.3]).agg(F.count_if("in").alias("accepted_count"), F.coalesce(F.sum(F.when(F.col("in"), F.col("base_error").cast("long"))), F.lit(0)).alias("accepted_errors"))


# Sources: written to the shared folder and read back.


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/source-{uuid.uuid4().hex}"


@query("typed_csv_source", "SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    tables.write(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path, "csv")
    kind = table(spark, sf_dir, "customer").schema["c_custkey"].dataType
    return tables.typed_csv(spark, path, {"c_custkey": kind, "c_acctbal": T.DoubleType(), "elsewhere": T.LongType()})


@query("manifest_source", "SELECT count(*) AS rows, count(DISTINCT sha256(text)) AS contents, CAST(22 AS INT) AS columns FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    d = texts(spark, sf_dir).select("doc_id", "sha256")
    tables.write(d.select(*[F.col("doc_id").cast("string").alias(c) if c == "sample_id" else F.col("sha256") if c == "sha256" else F.lit("x").alias(c) for c in tables.MANIFEST]), path, "csv")
    read = tables.manifest(spark, path)
    return read.agg(F.count("*").alias("rows"), F.count_distinct("sha256").alias("contents"), F.lit(len(read.columns)).alias("columns"))


@query("inventory_source", "SELECT 'p/' || n_name AS remote_path, CAST(n_nationkey AS BIGINT) AS size_bytes, 'i' AS remote_object_id, 'm' AS remote_md5 FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf_dir, "nation").select(F.concat(F.lit("p/"), "n_name"), "n_nationkey", F.lit("i"), F.lit("m")).write.csv(path)
    return tables.inventory(spark, path)


@query("json_after_log_source", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    body = table(spark, sf_dir, "region").agg(F.concat(F.lit("connecting\nready\n"), F.to_json(F.array_agg(F.struct(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"))))).alias("value"))
    body.coalesce(1).write.text(path)
    return tables.json_after_log(spark, path, "struct<k:bigint,name:string>")


@query("freeze_registry_verification", "SELECT 'unchanged' AS status, CAST(4 AS BIGINT) AS files UNION ALL SELECT 'changed', 1 UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'unregistered', 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    nation = table(spark, sf_dir, "nation")
    for k in range(6):
        nation.where(F.col("n_regionkey") == k % 5).select("n_name").coalesce(1).write.text(f"{path}/{k}")
    now = tables.files(spark, path, r"(^|/)[_.]").withColumn("k", F.substring_index("relative_path", "/", 1).cast("int"))
    registry = now.where("k <> 0").withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("k") == 1, 1).otherwise(0)).drop("k")
    registry = registry.unionByName(registry.limit(1).withColumn("relative_path", F.lit("gone")))
    return tables.verify_frozen(spark, registry, path).where("NOT relative_path RLIKE '(^|/)[_.]'").groupBy("status").agg(F.count("*").alias("files"))


@query("sharded_source", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, nation = _folder(spark), table(spark, sf_dir, "nation")
    for k in range(2):
        nation.where(F.col("n_nationkey") % 2 == k).write.parquet(f"{path}/{k}")
    return tables.shards(spark, [f"{path}/1", f"{path}/0"], ["n_nationkey"], nation.count()).groupBy("n_regionkey").agg(F.count("*").alias("n"))
