"""Accepted-error metrics, calibration metrics, summaries and taxonomies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauplane.functions import scores as S


def _where(c: Column) -> Column:
    return F.count_if(c)


def accepted_metrics(df: DataFrame, ctx: list[str], status: bool = True) -> DataFrame:
    """Metrics of rows with label, base_error and accepted: null, with a status, where nothing is accepted."""
    a, e, y = F.col("accepted"), F.col("base_error") == 1, F.col("label")
    out = df.groupBy(*ctx).agg(
        F.count("*").alias("n"), _where(a).alias("accepted_count"), _where(a & e).alias("accepted_errors"),
        F.try_divide(_where(a), F.count("*")).alias("coverage"), F.try_divide(_where(a & e), _where(a)).alias("selective_risk"),
        F.try_divide(_where(a & e & (y == 0)), _where(a & (y == 0))).alias("false_alarm_rate"), F.try_divide(_where(a & e & (y == 1)), _where(a & (y == 1))).alias("miss_rate"),
        F.try_divide(_where(a & (y == 0)), _where(y == 0)).alias("coverage_0"), F.try_divide(_where(a & (y == 1)), _where(y == 1)).alias("coverage_1"),
    )
    both = (F.col("false_alarm_rate") + F.col("miss_rate")) / 2
    out = out.withColumns({"balanced_risk": F.coalesce(both, "false_alarm_rate", "miss_rate"), "min_class_coverage": F.least("coverage_0", "coverage_1")})
    return out.withColumn("status", F.when(F.col("accepted_count") == 0, "undefined_zero_denominator").otherwise("defined")) if status else out


def group_metrics(df: DataFrame, ctx: list[str], groups: list[Column]) -> DataFrame:
    """accepted_metrics of every group that a row belongs to; groups: one label column for each grouping."""
    return accepted_metrics(df.withColumn("g", F.explode(F.array(*groups))), [*ctx, "g"], status=False)


def worst_group(metrics: DataFrame, ctx: list[str]) -> DataFrame:
    """The largest selective risk over groups, that group's name and coverage, the least coverage, and the gap of risks."""
    key = F.struct("selective_risk", "g")
    defined = F.when(F.col("selective_risk").isNotNull(), key)
    return metrics.groupBy(*ctx).agg(
        F.max("selective_risk").alias("worst_risk"), F.max_by("g", defined).alias("worst_group"), F.max_by("coverage", defined).alias("worst_group_coverage"),
        F.min("coverage").alias("min_coverage"), (F.max("selective_risk") - F.min("selective_risk")).alias("risk_gap"),
    )


def reliability_bins(df: DataFrame, ctx: list[str], p: str = "p", y: str = "label", bins: int = 15) -> DataFrame:
    """Equal-width bins, closed on the left and the last on both sides; empty bins are kept."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    found = df.groupBy(*ctx, at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))
    grid = df.select(*ctx).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(found, [*ctx, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration_errors(bins: DataFrame, ctx: list[str]) -> DataFrame:
    return bins.groupBy(*ctx).agg((F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def nll_brier(df: DataFrame, ctx: list[str], p: str = "p", y: str = "label") -> DataFrame:
    return df.groupBy(*ctx).agg(F.avg(S.nll(F.col(p), F.col(y))).alias("nll"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def distribution(df: DataFrame, ctx: list[str], column: str) -> DataFrame:
    """Count, moments, exact quantiles and non-finite values of a column."""
    finite = F.when(~F.isnan(column) & (F.abs(column) < float("inf")), F.col(column))
    q = F.percentile(finite, F.array(*[F.lit(x) for x in (0.01, 0.25, 0.5, 0.75, 0.99)])).alias("q")
    out = df.groupBy(*ctx).agg(F.count(finite).alias("n"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.count_if(finite.isNull()).alias("non_finite"), q)
    return out.select(*ctx, "n", "mean", "std", "min", "max", "non_finite", *[F.col("q")[k].alias(n) for k, n in enumerate(("p01", "p25", "median", "p75", "p99"))]).withColumn("iqr", F.col("p75") - F.col("p25"))


def long(df: DataFrame, keep: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(keep, columns, name, value)


#: Cells of grouping sets up to which units are counted by bits.
CELLS = 1_000


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """The aggregates by several sets of columns in one pass; columns that a set leaves out are null, grouping_id tells which.

    distinct: units whose distinct values are counted. A unit's cells are the bits of
    some words, so units are sent once, and not for each set; beyond CELLS cells each
    set counts its own.
    """
    columns = sorted({c for s in sets for c in s})

    def by_sets(rows: DataFrame, *made: Column) -> DataFrame:
        return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("grouping_id"), *made)

    out = by_sets(df, *[c.alias(k) for k, c in aggregates.items()])
    if not distinct:
        return out
    cells = df.select(*columns).distinct().limit(CELLS + 1).collect()
    if len(cells) > CELLS:
        return by_sets(df, *[c.alias(k) for k, c in aggregates.items()], *[F.count_distinct(c).alias(k) for k, c in distinct.items()])
    words = [f"_w{k}" for k in range(-(-max(len(cells), 1) // 63))]
    schema = T.StructType([*[f for c in columns for f in df.select(c).schema.fields], *[T.StructField(w, T.LongType()) for w in words]])
    numbered = df.sparkSession.createDataFrame([(*cell, *[1 << i % 63 if i // 63 == k else 0 for k in range(len(words))]) for i, cell in enumerate(cells)], schema)
    of = by_sets(numbered, *[F.bit_or(w).alias(w) for w in words])
    same = lambda a, b, names: reduce(lambda x, y: x & y, [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in names], F.lit(True))
    marked = df.alias("d").join(F.broadcast(numbered).alias("c"), same("d", "c", columns))
    for name, unit in distinct.items():
        masks = marked.select(unit.alias("_unit"), *[F.col(f"c.{w}") for w in words]).where("_unit IS NOT NULL").groupBy("_unit").agg(*[F.bit_or(w).alias(w) for w in words])
        kinds = masks.groupBy(*words).agg(F.count("*").alias("_many"))
        inside = reduce(lambda x, y: x | y, [F.col(f"k.{w}").bitwiseAND(F.col(f"o.{w}")) != 0 for w in words])
        found = kinds.alias("k").join(F.broadcast(of).alias("o"), inside).groupBy(*[F.col(f"o.`{c}`") for c in columns], "o.grouping_id").agg(F.sum("_many").alias("_units"))
        out = out.alias("a").join(found.alias("b"), same("a", "b", [*columns, "grouping_id"]), "left").select("a.*", F.coalesce("b._units", F.lit(0)).alias(name))
    return out


def canonical(df: DataFrame, sha: str, sample: str) -> DataFrame:
    """df with is_canonical and canonical_id: of rows with one content hash, the smallest sample id."""
    least = df.groupBy(sha).agg(F.min(sample).alias("canonical_id"))
    return df.join(least, sha).withColumn("is_canonical", F.col(sample) == F.col("canonical_id"))


def top_counts(df: DataFrame, ctx: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of a cell; ties by name."""
    w = W.partitionBy(*ctx).orderBy(F.desc("many"), value)
    return df.groupBy(*ctx, value).agg(F.count("*").alias("many")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def views_pivot(df: DataFrame, parent: str, index: str, value: str, views: int = 5) -> DataFrame:
    """Wide z_0 ... z_4; parents with another number of views are left out."""
    wide = df.groupBy(parent).pivot(index, list(range(views))).agg(F.first(value))
    whole = df.groupBy(parent).agg(F.count_distinct(index).alias("_views"), F.count("*").alias("_rows")).where(f"_views = {views} AND _rows = {views}")
    return wide.join(whole.select(parent), parent).select(parent, *[F.col(str(k)).alias(f"z_{k}") for k in range(views)])


def orbit_features(df: DataFrame, parent: str, index: str, value: str, gamma: float, views: int = 5) -> DataFrame:
    """The reliability features of every parent with all its views."""
    z = F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda s: s[value]).alias("z")
    arrays = df.groupBy(parent).agg(z, F.count_distinct(index).alias("_views")).where((F.size("z") == views) & (F.col("_views") == views))
    arrays = arrays.withColumn("_e", S.erosions(F.col("z"), gamma, views))
    return arrays.select(
        parent, F.element_at("z", 1).alias("z0"), S.margin_distance(F.element_at("z", 1), gamma).alias("margin_distance"), S.array_var_pop(F.col("z")).alias("orbit_logit_variance"),
        S.array_mean(F.col("_e")).alias("mean_directional_erosion"), F.array_max("_e").alias("worst_view_erosion"),
    )


def view_flips(df: DataFrame, parent: str, index: str, value: str, gamma: float) -> DataFrame:
    """For each view, how often it stands on the other side of gamma than the identity view, and its share of the orbit's variance."""
    w = W.partitionBy(parent)
    rows = df.withColumns({"_z0": F.max(F.when(F.col(index) == 0, F.col(value))).over(w), "_m": F.avg(value).over(w)})
    rows = rows.withColumn("_d", (F.col(value) - F.col("_m")) * (F.col(value) - F.col("_m"))).withColumn("_s", F.sum("_d").over(w))
    return rows.groupBy(index).agg(F.avg(((F.col(value) >= gamma) != (F.col("_z0") >= gamma)).cast("double")).alias("flip_rate"), F.avg(F.coalesce(F.try_divide("_d", F.nullif("_s", F.lit(0.0))), F.lit(0.0))).alias("variance_share"))


def leave_one_view(df: DataFrame, parent: str, index: str, value: str, views: int = 5) -> DataFrame:
    """(parent, omitted, variance): the population variance of the views that remain."""
    all_of = df.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("_z")).where(F.size("_z") == views)
    each = all_of.select(parent, "_z", F.explode("_z").alias("_o"))
    rest = F.transform(F.filter("_z", lambda x: x["i"] != F.col("_o.i")), lambda x: x["v"])
    return each.select(parent, F.col("_o.i").alias("omitted"), S.array_var_pop(rest).alias("variance"))


def perturbed_policy(df: DataFrame, ctx: list[str], original: str, changed: str, threshold: Column) -> DataFrame:
    """How a changed risk moves scores and acceptance at a frozen threshold: mean and median change, flips, and which rows flip."""
    a, b, e = S.accepted(F.col(original), threshold), S.accepted(F.col(changed), threshold), F.col("base_error") == 1
    d = F.col(changed) - F.col(original)
    return df.withColumns({"_a": a, "_b": b, "_d": d}).groupBy(*ctx).agg(
        F.count("*").alias("row_count"), F.avg("_d").alias("mean_risk_score_change"), F.percentile(F.abs("_d"), 0.5).alias("median_absolute_risk_score_change"),
        F.count_if(F.col("_a") != F.col("_b")).alias("acceptance_status_change_count"), F.avg((F.col("_a") != F.col("_b")).cast("double")).alias("acceptance_status_change_rate"),
        F.count_if(F.col("_a") & ~F.col("_b") & ~e).alias("correct_to_rejected_flips"), F.count_if(~F.col("_a") & F.col("_b") & e).alias("error_to_accepted_flips"),
    )


def calibrator_bundle(df: DataFrame, ctx: list[str], p: str = "risk_score", y: str = "base_error", bins: int = 15) -> DataFrame:
    """Of every cell: counts, prevalence, NLL, Brier, calibration errors, ranking metrics, AURC and mean predicted risk of an error probability."""
    from tauplane.operators import ranking

    counts = df.groupBy(*ctx).agg(F.count("*").alias("row_count"), F.sum(F.col(y).cast("long")).alias("error_count"), F.avg(F.col(y).cast("double")).alias("error_prevalence"), F.avg(p).alias("mean_predicted_risk"))
    out = counts.withColumn("observed_error_prevalence", F.col("error_prevalence"))
    scored = df.withColumns({"risk_score": F.col(p), "base_error": F.col(y)})
    area = ranking.auroc_average_precision(scored, ctx)
    status = F.when(F.col("status") == "ok", "ok").otherwise("undefined_single_error_class").alias("ranking_status")
    parts = [
        nll_brier(df, ctx, p, y).select(*ctx, F.col("nll").alias("binary_nll"), F.col("brier").alias("brier_score")),
        calibration_errors(reliability_bins(df, ctx, p, y, bins), ctx).select(*ctx, "ece", F.col("mce").alias("maximum_calibration_error")),
        area.select(*ctx, F.col("auroc").alias("error_detection_AUROC"), F.when(F.col("status") == "ok", F.col("average_precision")).alias("error_detection_AUPR"), status),
        ranking.aurc(scored, ctx).select(*ctx, F.col("aurc").alias("AURC"), F.col("excess_aurc").alias("E_AURC")),
    ]
    for part in parts:
        out = out.join(part, ctx)
    return out


def pick_cases(df: DataFrame, ctx: list[str], n: int, order: list[Column | str], cluster: str, source: str) -> DataFrame:
    """n cases of a cell: one for each cluster, sources in turn (each one's first case, then its second, ...)."""
    one = df.withColumn("_c", F.row_number().over(W.partitionBy(*ctx, cluster).orderBy(*order))).where("_c = 1")
    turn = one.withColumn("_t", F.row_number().over(W.partitionBy(*ctx, source).orderBy(*order)))
    return turn.withColumn("place", F.row_number().over(W.partitionBy(*ctx).orderBy("_t", *order))).where(F.col("place") <= n).drop("_c", "_t")
