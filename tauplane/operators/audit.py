"""Sampling designs, selection by mean rank, and audit summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tauplane.functions import scores as S
from tauplane.functions.text import mentions, stable_rank
from tauplane.operators.ranking import auroc_average_precision, average_rank, ranked, small
from tauplane.sources.freeze import freeze


def quota_sample(df: DataFrame, unit: str, sample: str, stratum: str, quota: int, seed: int) -> DataFrame:
    """At most quota samples of every stratum, each unit once in all: its smallest sample stands for it."""
    one = df.groupBy(unit).agg(F.min(sample).alias(sample), F.min_by(stratum, sample).alias(stratum))
    w = W.partitionBy(stratum).orderBy(stable_rank(seed, F.col(unit)), sample)
    return one.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= quota).select(sample, stratum)


def mean_rank(cells: DataFrame, ctx: list[str], variant: str, metric: str) -> DataFrame:
    """Every variant's average rank (smaller metric, smaller rank) over cells, and the chosen one; variants are few."""
    found = average_rank(cells, ctx, metric, "_rank").groupBy(variant).agg(F.avg("_rank").alias("mean_rank"))
    best = found.agg(F.min(F.struct("mean_rank", variant)).alias("best"))
    return found.join(F.broadcast(best), F.lit(True)).select(variant, "mean_rank", (F.struct("mean_rank", variant) == F.col("best")).alias("chosen"))


def raw_metrics(df: DataFrame, ctx: list[str]) -> DataFrame:
    """Accuracy, false alarms, misses and balanced accuracy of the base predictions."""
    e, y = F.col("base_error") == 1, F.col("label")
    out = df.groupBy(*ctx).agg(
        F.count("*").alias("n"), F.avg((~e).cast("double")).alias("accuracy"),
        F.try_divide(F.count_if(e & (y == 0)), F.count_if(y == 0)).alias("false_alarm_rate"), F.try_divide(F.count_if(e & (y == 1)), F.count_if(y == 1)).alias("miss_rate"),
    )
    return out.withColumn("balanced_accuracy", 1 - (F.col("false_alarm_rate") + F.col("miss_rate")) / 2)


def readiness(df: DataFrame, dimension: str, score: str, need: int = 4) -> DataFrame:
    """Of every dimension the least and mean score: go if all reach what is needed, conditional if the mean does."""
    out = df.groupBy(dimension).agg(F.count("*").alias("items"), F.min(score).alias("least"), F.avg(score).alias("mean_score"))
    return out.withColumn("decision", F.when(F.col("least") >= need, "go").when(F.col("mean_score") >= need, "conditional").otherwise("no_go"))


def rerun(first: DataFrame, second: DataFrame, artifact: str) -> DataFrame:
    """How many rows only one of two runs has (rows counted as often as they occur)."""
    c = first.columns
    both = first.select(F.lit(1).alias("_s"), F.xxhash64(*c).alias("_h")).unionByName(second.select(F.lit(-1).alias("_s"), F.xxhash64(*c).alias("_h")))
    left = both.groupBy("_h").agg(F.sum("_s").alias("d"))
    out = left.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_second"))
    return out.select(F.lit(artifact).alias("artifact"), "only_first", "only_second", ((F.col("only_first") == 0) & (F.col("only_second") == 0)).alias("identical"))


def detector_metrics(df: DataFrame, ctx: list[str], p: str = "p", label: str = "label") -> DataFrame:
    """raw_metrics with the detector's own AUROC and average precision for its labels."""
    area = auroc_average_precision(df, ctx, p, label).select(*ctx, "auroc", F.col("average_precision").alias("aupr"))
    return raw_metrics(df, ctx).join(area, ctx)


def manifest_audit(df: DataFrame, required: list[str], external: Column, split: str, train_like: list[str], calibration: str, test_like: list[str], key: Column) -> DataFrame:
    """(check, violations, status) of a manifest: columns that are missing, external rows in splits that train, and transformations that calibration and test splits share."""
    missing = [c for c in required if c not in df.columns]
    rows = df.withColumns({"_key": key, "_bad": F.coalesce(external, F.lit(False)) & F.col(split).isin(train_like)})
    shared = rows.groupBy("_key").agg(F.bool_or(F.col(split) == calibration).alias("c"), F.bool_or(F.col(split).isin(test_like)).alias("t"))
    checks = [
        rows.agg(F.lit("missing_columns").alias("check"), F.lit(len(missing)).cast("long").alias("violations")),
        rows.agg(F.lit("external_rows_in_training_splits").alias("check"), F.count_if("_bad").alias("violations")),
        shared.agg(F.lit("shared_transformations").alias("check"), F.count_if(F.coalesce(F.col("c") & F.col("t"), F.lit(False))).alias("violations")),
    ]
    return reduce(DataFrame.unionByName, checks).withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def score_audit(df: DataFrame, expected: DataFrame, keys: list[str], logit: str, p: str, ctx: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Of every cell's score table: rows against those expected, duplicates, values that aren't finite or in [0, 1], the gap to the logit's sigmoid, and a status."""
    lone = df.groupBy(*ctx, *keys).agg(F.count("*").alias("_m")).groupBy(*ctx).agg(F.sum(F.col("_m") - 1).alias("duplicate_rows"))
    wild = lambda c: F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf"))
    own = df.groupBy(*ctx).agg(
        F.count("*").alias("actual_rows"), F.count_if(wild(logit)).alias("nonfinite_logit_count"), F.count_if(wild(p)).alias("nonfinite_probability_count"),
        F.count_if(F.col(p) < 0).alias("probability_below_zero_count"), F.count_if(F.col(p) > 1).alias("probability_above_one_count"), F.max(F.abs(S.sigmoid(F.col(logit)) - F.col(p))).alias("max_sigmoid_probability_gap"),
    )
    out = expected.groupBy(*ctx).agg(F.count("*").alias("expected_rows")).join(own, ctx, "left").join(lone, ctx, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in out.columns if c not in (*ctx, "expected_rows", "max_sigmoid_probability_gap")}).withColumn("missing_rows", F.col("expected_rows") - F.col("actual_rows"))
    zero = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in ("missing_rows", "duplicate_rows", "nonfinite_logit_count", "nonfinite_probability_count", "probability_below_zero_count", "probability_above_one_count")])
    return out.withColumn("status", F.when(zero & F.coalesce(F.col("max_sigmoid_probability_gap") <= tolerance, F.col("actual_rows") == 0), "pass").otherwise("fail"))


def formula_audit(df: DataFrame, ctx: list[str], formulas: dict[str, tuple[Column, Column]], tolerance: float = 1e-6) -> DataFrame:
    """(ctx, method, n, max_abs_difference, status): stored scores against the formulas they are to follow, in one pass."""
    wide = df.groupBy(*ctx).agg(F.count("*").alias("n"), *[F.max(F.abs(stored - again)).alias(k) for k, (stored, again) in formulas.items()])
    long = wide.unpivot([*ctx, "n"], list(formulas), "method", "max_abs_difference")
    return long.withColumn("status", F.when(F.col("max_abs_difference") <= tolerance, "pass").otherwise("fail"))


def curve_audit(curves: DataFrame, ctx: list[str], coverage: tuple[float, float], risk: tuple[float, float], cutoff: float = 0.01) -> DataFrame:
    """Of every curve: points, extremes, duplicate coverages, missing values, points that the axes cut off, and the extremes at low coverage."""
    c, r = F.col("coverage"), F.col("empirical_risk")
    columns = ["coverage", "empirical_risk", "threshold", "accepted_count"]
    low = c <= cutoff
    out = curves.groupBy(*ctx).agg(
        F.count("*").alias("plotted_points"), F.min(c).alias("coverage_min"), F.max(c).alias("coverage_max"), F.min(r).alias("risk_min"), F.max(r).alias("risk_max"), (F.count(c) - F.count_distinct(c)).alias("duplicate_coverage_count"),
        F.array_join(F.array_compact(F.array(*[F.when(F.count_if(F.col(x).isNull()) > 0, F.lit(x)) for x in columns])), ",").alias("missing_value_columns"),
        F.coalesce(F.bool_or(~c.between(*coverage) | ~r.between(*risk)), F.lit(False)).alias("axis_clipping"),
        F.count_if(low).alias("low_coverage_points"), F.coalesce(F.max(F.when(low, F.col("accepted_count"))), F.lit(0)).alias("low_coverage_accepted_max"), F.max(F.when(low, r)).alias("low_coverage_risk_max"),
    )
    return out.withColumn("missing_values", F.col("missing_value_columns") != "")


def identity_audit(df: DataFrame, ctx: list[str], sample: str, digest: str, source: str, expected: int) -> DataFrame:
    """Of every cell: rows, distinct samples, contents and sources, sources that are unresolved, and whether all are as many as expected."""
    out = df.groupBy(*ctx).agg(
        F.count("*").alias("row_count"), F.count_distinct(digest).alias("unique_sha256"), F.count_distinct(sample).alias("unique_sample_id"), F.count_distinct(source).alias("unique_source_id"),
        F.count_if(F.coalesce(F.col(source).cast("string"), F.lit("")).isin("", "nan", "None")).alias("unresolved_source_id_count"),
    )
    good = (F.col("row_count") == expected) & (F.col("unique_sha256") == expected) & (F.col("unresolved_source_id_count") == 0)
    return out.withColumn("status", F.when(good, "pass").otherwise("fail"))


def claim_audit(claims: DataFrame, files: DataFrame, phrases: list[str]) -> DataFrame:
    """(claim_id, failure) of claims with wording that is prohibited, or locked without evidence or with evidence that isn't there; files: path."""
    wording = claims.where((F.size(mentions(F.concat_ws(" ", "final_claim_text", "allowed_wording"), phrases)) > 0) & (F.col("status") != "PROHIBITED")).select("claim_id", F.lit("prohibited wording").alias("failure"))
    locked = claims.where(F.col("status").isin("LOCKED_SUPPORTED", "LOCKED_QUALIFIED"))
    pieces = locked.select("claim_id", F.filter(F.transform(F.split(F.coalesce("supporting_artifacts", F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "").alias("pieces"))
    bare = pieces.where(F.size("pieces") == 0).select("claim_id", F.lit("missing evidence").alias("failure"))
    named = pieces.select("claim_id", F.explode("pieces").alias("piece")).withColumn("path", F.substring_index("piece", "::", 1))
    lost = named.join(files.select("path").distinct(), "path", "left_anti").select("claim_id", F.concat(F.lit("missing artifact "), "path").alias("failure"))
    return wording.unionByName(bare).unionByName(lost)


def listing_audit(listing: DataFrame, name: str, required: Column, must_have: list[str], paths: list[str], digest: str, files: DataFrame) -> DataFrame:
    """(item, failure) of a list of tables or figures: what must be listed and isn't, files that aren't there, and entries without a source hash."""
    spark = listing.sparkSession
    wanted = spark.createDataFrame([(x,) for x in must_have], "item string")
    absent = wanted.join(listing.select(required.alias("item")).distinct(), "item", "left_anti").select("item", F.lit("not listed").alias("failure"))
    at = listing.select(F.col(name).alias("item"), F.explode(F.array(*[F.struct(F.lit(p).alias("field"), F.col(p).alias("path")) for p in paths])).alias("x")).select("item", "x.field", "x.path")
    lost = at.join(files.select("path").distinct(), "path", "left_anti").select("item", F.concat(F.lit("missing "), "field").alias("failure"))
    bare = listing.where(F.coalesce(digest, F.lit("")) == "").select(F.col(name).alias("item"), F.lit("missing source hash").alias("failure"))
    return absent.unionByName(lost).unionByName(bare)


def transfer_summary(df: DataFrame, ctx: list[str]) -> DataFrame:
    """Means of coverage, selective risk, base error and AURC over the rows of a domain, and the worst group's risk."""
    return df.groupBy(*ctx).agg(F.avg("coverage").alias("mean_coverage"), F.avg("selective_risk").alias("mean_selective_risk"), F.avg("base_error_rate").alias("mean_base_error"), F.avg("aurc").alias("mean_aurc"), F.max("worst_risk").alias("worst_group_selective_risk"))


def filled_quota_sample(df: DataFrame, unit: str, sample: str, stratum: str, total: int, seed: int) -> DataFrame:
    """total samples, each unit once: an equal quota of every stratum, the remainder to the first strata by name, and what a stratum lacks filled from the rest in hash order."""
    one = df.groupBy(unit).agg(F.min(sample).alias(sample), F.min_by(stratum, sample).alias(stratum)).withColumn("_h", stable_rank(seed, F.col(unit)))
    placed = ranked(one, [stratum], ["_h", sample])
    strata = one.select(stratum).distinct().withColumns({"_s": F.row_number().over(W.orderBy(stratum)), "_many": F.count("*").over(W.partitionBy(F.lit(1)))})
    quota = F.floor(F.lit(total) / F.col("_many")) + (F.col("_s") <= F.lit(total) % F.col("_many")).cast("int")
    marked = freeze(placed.join(small(strata), stratum).withColumn("_first", F.col("_k") <= quota))
    lacking = total - marked.where("_first").count()
    fill = marked.where("NOT _first").orderBy("_h", sample).limit(max(lacking, 0))
    return marked.where("_first").select(sample, stratum, F.lit("quota").alias("picked")).unionByName(fill.select(sample, stratum, F.lit("fill").alias("picked")))
