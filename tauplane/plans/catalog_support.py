"""More named queries: embeddings and drift, weighted resampling, sampling designs, selection and audit summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tauplane.functions import scores as S
from tauplane.functions.text import stable_rank
from tauplane.operators import audit, distance, evaluate, ranking, relational, resample
from tauplane.plans.catalog import ACC, BLOCKS, CTX, PREFIX, SEED, WEIGHTS, _accepted, _bank, _features, _weighted_blocks, query, rounded
from tauplane.plans.frames import ORBIT, SCORES, TAU_REGISTRY, scores, table


@query("embedding_drift_views", """
    WITH e AS (SELECT vec_id // 5 AS parent, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS v FROM embeddings), g AS (SELECT parent, min_by(v, vec_id) AS f, min(vec_id) AS m FROM e GROUP BY parent HAVING count(*) = 5)
    SELECT parent, round(avg(1 - least(greatest(list_cosine_similarity(v, f), -1), 1)), 6) AS drift FROM e JOIN g USING (parent) WHERE vec_id <> m GROUP BY parent""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("parent"), "vec_id", S.unit(F.col("embedding")).alias("v"))
    views = e.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("views")).where("size(views) = 5")
    return rounded(views.select("parent", S.embedding_drift(F.col("views")).alias("drift")))


@query("support_distance_max", "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.id, min(round(1 - list_cosine_similarity(q.v, b.v), 12)) AS d FROM e q JOIN e b ON q.id <> b.id GROUP BY q.id) SELECT id // 5 AS parent, round(max(d), 6) AS support_distance_max FROM d GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir)
    nearest = distance.knn(bank, bank, 1)
    return rounded(nearest.groupBy(F.floor(F.col("query_id") / 5).alias("parent")).agg(F.max("distance").alias("support_distance_max")))


@query("displacement_mahalanobis")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).cast("int").alias("view_index"), F.floor(F.col("vec_id") / 5).alias("parent"), S.unit(F.col("embedding")).alias("embedding"))
    return rounded(distance.displacement_risk(e, "parent", "view_index"))


@query("robust_local_drift")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distance.robust_local_drift(_features(spark, sf_dir), "parent", "margin_distance", "orbit_logit_variance", "mean_directional_erosion", 20))


@query("weighted_threshold_metrics", f"""
    WITH {SCORES}, {WEIGHTS}, {ACC} SELECT detector, replicate, round(CAST(sum(CASE WHEN a THEN weight ELSE 0 END) AS DOUBLE) / nullif(sum(weight), 0), 6) AS coverage,
        round(CAST(sum(CASE WHEN a AND er THEN weight ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN a THEN weight ELSE 0 END), 0), 6) AS selective_risk FROM ac JOIN we USING (sha256) GROUP BY detector, replicate""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("accepted")
    drawn = resample.unit_sums(_accepted(spark, sf_dir), ["detector"], {"n": F.lit(1), "a": a, "e": a & (F.col("base_error") == 1)}, "sha256", 20, 7)
    return rounded(drawn.select("detector", "replicate", F.try_divide("a", F.nullif("n", F.lit(0))).alias("coverage"), F.try_divide("e", F.nullif("a", F.lit(0))).alias("selective_risk")))


@query("weighted_auroc_draws", f"""
    WITH {SCORES}, {WEIGHTS}, b AS (SELECT detector, replicate, risk_score, CAST(sum(weight * base_error) AS DOUBLE) AS pos, CAST(sum(weight * (1 - base_error)) AS DOUBLE) AS neg FROM f JOIN we USING (sha256) GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER (PARTITION BY detector, replicate ORDER BY risk_score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM b)
    SELECT detector, replicate, round(sum(neg * (tp - pos) + neg * pos / 2) / nullif(sum(pos) * sum(neg), 0), 6) AS draw FROM c GROUP BY detector, replicate""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.blocks_auroc(_weighted_blocks(spark, sf_dir), ["detector"]))


@query("unit_delta_ci", f"""
    WITH {SCORES}, {WEIGHTS}, u AS (SELECT x.sha256, sum(x.base_error - y.base_error) AS d, count(*) AS n FROM f x JOIN f y ON x.sample_id = y.sample_id AND x.detector = 'a' AND y.detector = 'b' GROUP BY ALL),
    dr AS (SELECT replicate, CAST(sum(weight * d) AS DOUBLE) / nullif(sum(weight * n), 0) AS draw FROM u JOIN we USING (sha256) GROUP BY replicate) SELECT 'a-b' AS pair, round(quantile_cont(draw, 0.025), 6) AS ci_low, round(quantile_cont(draw, 0.975), 6) AS ci_high, count(draw) AS valid_draws FROM dr""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scores(spark, sf_dir)
    own = lambda d: f.where(F.col("detector") == d).select("sample_id", "sha256", F.col("base_error").alias(d))
    units = own("a").join(own("b").drop("sha256"), "sample_id").groupBy("sha256").agg(F.sum(F.col("a") - F.col("b")).alias("d"), F.count("*").alias("n"))
    drawn = resample.weighted_units(units, "sha256", 20, 7).groupBy("replicate").agg(F.try_divide(F.sum(F.col("weight") * F.col("d")), F.nullif(F.sum(F.col("weight") * F.col("n")), F.lit(0))).alias("draw"))
    return rounded(resample.percentile_ci(drawn.withColumn("pair", F.lit("a-b")), ["pair"]))


@query("balanced_role_halves", f"""
    WITH {SCORES}, r AS (SELECT sample_id, generator, row_number() OVER (PARTITION BY generator ORDER BY sha256('{SEED}|role|' || sample_id), sample_id) AS k, count(*) OVER (PARTITION BY generator) AS n FROM f WHERE detector = 'a' AND label = 0)
    SELECT sample_id, generator, CASE WHEN k <= n // 2 THEN 'seen' ELSE 'held_out' END AS role FROM r""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).where("detector = 'a' AND label = 0").select("sample_id", "generator")
    w = W.partitionBy("generator")
    k, n = F.row_number().over(w.orderBy(stable_rank(SEED, "role", F.col("sample_id")), "sample_id")), F.count("*").over(w)
    return rows.withColumns({"k": k, "n": n}).select("sample_id", "generator", F.when(F.col("k") <= F.floor(F.col("n") / 2), "seen").otherwise("held_out").alias("role"))


@query("pilot_quota_sample", """
    WITH d AS (SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, min_by(lang, doc_id) AS lang FROM documents GROUP BY sha256(text)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || sha256), doc_id) AS k FROM d) SELECT doc_id, lang FROM r WHERE k <= 20""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.quota_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256")), "sha256", "doc_id", "lang", 20, 7)


@query("mean_rank_selection", f"""
    WITH {SCORES}, {PREFIX}, a AS (SELECT detector, split, avg(e / k) AS aurc FROM r GROUP BY ALL), q AS (SELECT detector, split, rank() OVER (PARTITION BY split ORDER BY round(aurc, 9)) + (count(*) OVER (PARTITION BY split, round(aurc, 9)) - 1) / 2 AS rk FROM a),
    m AS (SELECT detector, avg(rk) AS mean_rank FROM q GROUP BY detector) SELECT detector, round(mean_rank, 6) AS mean_rank, row_number() OVER (ORDER BY mean_rank, detector) = 1 AS chosen FROM m""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ranking.aurc(scores(spark, sf_dir), CTX).withColumn("aurc", F.round("aurc", 9))
    return rounded(audit.mean_rank(cells, ["split"], "detector", "aurc"))


@query("result_verdicts", f"""
    WITH {SCORES}, {BLOCKS}, {PREFIX}, a AS (SELECT detector, split, avg(e / k) AS aurc FROM r GROUP BY ALL),
    p AS (SELECT detector, split, t, coalesce(max(CASE WHEN threshold <= t THEN accepted_count END), 0) AS ac, coalesce(max(CASE WHEN threshold <= t THEN accepted_errors END), 0) AS ae, max(n) AS n FROM c, (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in TAU_REGISTRY)}) v(t) GROUP BY ALL),
    o AS (SELECT * FROM p WHERE t = CAST({TAU_REGISTRY[0]} AS DOUBLE)), w AS (SELECT * FROM p WHERE t = CAST({TAU_REGISTRY[1]} AS DOUBLE))
    SELECT o.detector, o.split, CASE WHEN (o.ac = 0) <> (w.ac = 0) OR abs(CAST(o.ac AS DOUBLE) / o.n - CAST(w.ac AS DOUBLE) / w.n) > 0.01 OR coalesce(abs(CAST(o.ae AS DOUBLE) / nullif(o.ac, 0) - CAST(w.ae AS DOUBLE) / nullif(w.ac, 0)) > 0.005, false) THEN 'material_change' ELSE 'stable' END AS verdict
    FROM o JOIN w ON o.detector = w.detector AND o.split = w.split""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scores(spark, sf_dir)
    cells = ranking.aurc(f, CTX).select(*CTX, "aurc")
    own = lambda t: evaluate.accepted_metrics(f.withColumn("accepted", S.accepted(F.col("risk_score"), F.lit(t))), CTX).join(cells, CTX)
    return relational.verdict(own(TAU_REGISTRY[0]), own(TAU_REGISTRY[1]), CTX)


@query("raw_detector_metrics", f"""
    WITH {SCORES}, g AS (SELECT detector, count(*) AS n, CAST(count(CASE WHEN base_error = 1 AND label = 0 THEN 1 END) AS DOUBLE) / count(CASE WHEN label = 0 THEN 1 END) AS far, CAST(count(CASE WHEN base_error = 1 AND label = 1 THEN 1 END) AS DOUBLE) / count(CASE WHEN label = 1 THEN 1 END) AS fnr, avg(1 - base_error) AS acc FROM f GROUP BY detector)
    SELECT detector, n, round(acc, 6) AS accuracy, round(far, 6) AS false_alarm_rate, round(fnr, 6) AS miss_rate, round(1 - (far + fnr) / 2, 6) AS balanced_accuracy FROM g""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.raw_metrics(scores(spark, sf_dir), ["detector"]))


@query("readiness_summary", "WITH d AS (SELECT CASE WHEN quality = 1 THEN 'quality' ELSE 'defect' END AS dimension, CASE WHEN toxic = 1 THEN 1 ELSE 5 END AS score FROM labels) SELECT dimension, count(*) AS items, CAST(min(score) AS INT) AS least, round(avg(score), 6) AS mean_score, CASE WHEN min(score) >= 4 THEN 'go' WHEN avg(score) >= 4 THEN 'conditional' ELSE 'no_go' END AS decision FROM d GROUP BY dimension")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "quality").otherwise("defect").alias("dimension"), F.when(F.col("toxic") == 1, 1).otherwise(5).alias("score"))
    return rounded(audit.readiness(d, "dimension", "score"))


@query("determinism_rerun", "SELECT 'orbit_features' AS artifact, CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second, true AS identical")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rerun(_features(spark, sf_dir), _features(spark, sf_dir).repartition(7), "orbit_features")


@query("view_parity", f"WITH {ORBIT}, a AS (SELECT parent, logit FROM o WHERE view_index = 0), b AS (SELECT parent, logit FROM o WHERE view_index = 4) SELECT 'logit' AS column_name, count(*) AS n, count(CASE WHEN abs(a.logit - b.logit) > 0.3::DOUBLE THEN 1 END) AS n_differ FROM a JOIN b USING (parent)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tauplane.plans.frames import orbit

    o = orbit(spark, sf_dir)
    return relational.value_differences(o.where("view_index = 0"), o.where("view_index = 4"), ["parent"], ["logit"], 0.3)
