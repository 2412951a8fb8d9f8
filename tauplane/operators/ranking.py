"""Ordered metrics: prefix curves by row and by block, rank statistics, ROC.

A row prefix ends at any row, in the order (risk, sample_id); a block prefix
holds all rows of a risk. Row prefixes are summed by ranges of that order, so no
task holds a whole cell, nor all rows of one risk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tauplane.functions.bounds import cp_feasible
from tauplane.sources.freeze import freeze

#: Rows up to which the small side of a join is broadcast.
BROADCAST = 200_000


def running(df: DataFrame, ctx: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with the running sums (of longs) of the columns over ctx by order.

    One shuffle by range: a task sums its own rows, whatever cell they are of, and
    what stands before it in its first cell is added from the totals of the tasks,
    which are as many as tasks and cells. The sorted rows are written once, so
    that both readings see the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(sums)
    rows = df.withColumns({f"_v_{k}": v.cast("long") for k, v in sums.items()})
    placed = rows.repartitionByRange(parts, *ctx, *order).sortWithinPartitions(*ctx, *order).withColumn("_part", F.spark_partition_id())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in ctx:
                codes = pa.compute.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first = [batch.column(c)[0].as_py() for c in ctx]
            new[0] = first != last
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ctx]
            heads = np.flatnonzero(new)
            cell = np.cumsum(new) - 1
            columns = []
            for name in batch.schema.names:
                if name.startswith("_v_") and name[3:] in before:
                    total = np.cumsum(batch.column(name).to_numpy())
                    start = np.r_[0, total][heads]  # what the cells that begin here leave out
                    own = np.where(cell >= 0, total - (start[np.maximum(cell, 0)] if len(heads) else 0), total + before[name[3:]])
                    before[name[3:]] = int(own[-1])
                    columns.append(pa.array(own.astype(np.int64)))
                else:
                    columns.append(batch.column(name))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    local = freeze(placed.mapInArrow(add_up, placed.schema))
    ends = local.groupBy("_part", *ctx).agg(*[F.max(F.col(f"_v_{k}")).alias(f"_t_{k}") for k in names])
    w = W.partitionBy(*ctx).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.select("_part", *ctx, *[F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)).alias(f"_o_{k}") for k in names])
    same = [F.col("l._part") == F.col("o._part"), *[F.col(f"l.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in ctx]]
    out = local.alias("l").join(small(offsets).alias("o"), same)
    return out.select("l.*", *[(F.col(f"_v_{k}") + F.col(f"_o_{k}")).alias(k) for k in names]).drop("_part", *[f"_v_{k}" for k in names])


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has BROADCAST rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def ranked(df: DataFrame, ctx: list[str], order: list[str], name: str = "_k") -> DataFrame:
    """df with each row's place in its cell, from 1; no window holds a cell."""
    return running(df, ctx, order, {name: F.lit(1)})


def prefix_rows(df: DataFrame, ctx: list[str]) -> DataFrame:
    """ctx, risk_score, sample_id, base_error with accepted_count and accepted_errors of the prefix that ends at each row."""
    rows = df.select(*ctx, "risk_score", "sample_id", "base_error")
    return running(rows, ctx, ["risk_score", "sample_id"], {"accepted_count": F.lit(1), "accepted_errors": F.col("base_error")})


def prefix_blocks(df: DataFrame, ctx: list[str]) -> DataFrame:
    """One row for each distinct risk: threshold, accepted_count, accepted_errors, n, coverage, empirical_risk."""
    blocks = df.groupBy(*ctx, F.col("risk_score").alias("threshold")).agg(F.count("*").alias("_n"), F.sum(F.col("base_error").cast("long")).alias("_e"))
    w = W.partitionBy(*ctx).orderBy("threshold").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_n").over(W.partitionBy(*ctx))
    out = blocks.select(*ctx, "threshold", F.sum("_n").over(w).alias("accepted_count"), F.sum("_e").over(w).alias("accepted_errors"), total.alias("n"))
    return out.withColumns({"coverage": F.col("accepted_count") / F.col("n"), "empirical_risk": F.col("accepted_errors") / F.col("accepted_count")})


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed up to 32, beyond that by its expansion."""
    x = F.greatest(m, F.lit(1)).cast("double")
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    whole = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.least(m, F.lit(32)), F.lit(1)).cast("long")), F.lit(0.0), lambda s, j: s + 1.0 / j)
    return F.when(m <= 0, 0.0).when(m <= 32, whole).otherwise(series)


def optimal_aurc(n: Column, errors: Column) -> Column:
    """The AURC of n rows whose errors all come last: the sum of j / (n - errors + j) over j up to errors, over n."""
    right = n - errors
    return F.when(errors > 0, (errors - right * (harmonic(n) - harmonic(right))) / n).otherwise(0.0)


def aurc(df: DataFrame, ctx: list[str]) -> DataFrame:
    """aurc, optimal_aurc and excess_aurc of every cell; the optimum is the same errors all at the end."""
    found = prefix_rows(df, ctx).groupBy(*ctx).agg(F.avg(F.col("accepted_errors") / F.col("accepted_count")).alias("aurc"), F.count("*").alias("n"), F.sum(F.col("base_error").cast("long")).alias("errors"))
    best = found.withColumn("optimal_aurc", optimal_aurc(F.col("n"), F.col("errors")))
    return best.withColumn("excess_aurc", F.col("aurc") - F.col("optimal_aurc"))


def risk_at_coverage(df: DataFrame, ctx: list[str], coverages: list[float]) -> DataFrame:
    """The error rate of the first max(1, ceil(c * n)) rows, for every c."""
    sized = prefix_rows(df, ctx).join(df.groupBy(*ctx).agg(F.count("*").alias("n")), ctx)
    grid = F.explode(F.array(*[F.lit(float(c)) for c in coverages]))
    return sized.withColumn("coverage", grid).where(F.col("accepted_count") == F.greatest(F.lit(1), F.ceil(F.col("coverage") * F.col("n")))).select(*ctx, "coverage", (F.col("accepted_errors") / F.col("accepted_count")).alias("risk"))


def coverage_at_cp_risk(df: DataFrame, ctx: list[str], alphas: list[float], delta: float) -> DataFrame:
    """The share of the longest prefix whose Clopper-Pearson bound is alpha at most."""
    rows = prefix_rows(df, ctx).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    fits = cp_feasible("accepted_errors", "accepted_count", F.lit(float(delta)), F.col("alpha"))
    return rows.withColumn("_fits", fits).groupBy(*ctx, "alpha").agg((F.coalesce(F.max(F.when(F.col("_fits"), F.col("accepted_count"))), F.lit(0)) / F.max("accepted_count")).alias("coverage"))


COVERAGES, RISKS = (0.5, 0.7, 0.8, 0.9, 0.95), (0.01, 0.05)


def metric_summary(df: DataFrame, ctx: list[str], delta: float = 0.05) -> DataFrame:
    """(ctx, metric, value, status): the thirteen selective metrics of every cell, from one ordered pass and one over scores."""
    n = df.groupBy(*ctx).agg(F.count("*").alias("n"))
    rows = prefix_rows(df, ctx).join(small(n), ctx)
    for a in RISKS:
        rows = rows.withColumn(f"_cp{a * 100:.0f}", cp_feasible("accepted_errors", "accepted_count", F.lit(float(delta)), F.lit(a)))
    k, risk = F.col("accepted_count"), F.col("accepted_errors") / F.col("accepted_count")
    share = lambda fits: F.coalesce(F.max(F.when(fits, k)), F.lit(0)) / F.max("n")
    wide = rows.groupBy(*ctx).agg(
        F.avg(risk).alias("AURC"), F.max("n").alias("_n"), F.sum(F.col("base_error").cast("long")).alias("_e"),
        *[F.max(F.when(k == F.greatest(F.lit(1), F.ceil(F.lit(c) * F.col("n"))), risk)).alias(f"risk_at_{c * 100:.0f}pct_coverage") for c in COVERAGES],
        *[share(risk <= a).alias(f"coverage_empirical_risk_le_{a * 100:.0f}pct") for a in RISKS], *[share(F.col(f"_cp{a * 100:.0f}")).alias(f"coverage_cp_risk_le_{a * 100:.0f}pct") for a in RISKS],
    )
    wide = wide.withColumn("E_AURC", F.col("AURC") - optimal_aurc(F.col("_n"), F.col("_e"))).drop("_n", "_e")
    area = auroc_average_precision(df, ctx).withColumnsRenamed({"auroc": "error_detection_AUROC", "average_precision": "error_detection_AUPR"})
    out = wide.join(area, ctx)
    names = [c for c in out.columns if c not in (*ctx, "status")]
    long = out.unpivot([*ctx, "status"], names, "metric", "value")
    return long.withColumn("status", F.when(F.col("metric").startswith("error_detection"), F.col("status")).otherwise("ok"))


def coverage_at_risk(df: DataFrame, ctx: list[str], alphas: list[float]) -> DataFrame:
    """The share of the longest prefix whose error rate is alpha at most."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    rows = prefix_rows(df, ctx).withColumn("alpha", grid)
    fits = F.col("accepted_errors") / F.col("accepted_count") <= F.col("alpha")
    return rows.groupBy(*ctx, "alpha").agg((F.coalesce(F.max(F.when(fits, F.col("accepted_count"))), F.lit(0)) / F.max("accepted_count")).alias("coverage"))


def operating_point(curve: DataFrame, ctx: list[str], at: DataFrame) -> DataFrame:
    """The last point of a block curve at or below each threshold of at (ctx..., tau): an as-of look-up."""
    return curve.join(small(at), ctx).where(F.col("threshold") <= F.col("tau")).groupBy(*ctx, "tau").agg(F.max_by(F.struct("threshold", "accepted_count", "accepted_errors", "coverage"), "threshold").alias("p")).select(*ctx, "tau", "p.*")


def _by_score(df: DataFrame, ctx: list[str], score: str, positive: str) -> DataFrame:
    """Positives and negatives at each score, and those with a higher score."""
    at = df.groupBy(*ctx, F.col(score).alias("score")).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.sum(1 - F.col(positive).cast("long")).alias("neg"))
    above = W.partitionBy(*ctx).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    return at.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "p": F.sum("pos").over(W.partitionBy(*ctx)), "n": F.sum("neg").over(W.partitionBy(*ctx))})


def auroc_average_precision(df: DataFrame, ctx: list[str], score: str = "risk_score", positive: str = "base_error") -> DataFrame:
    """AUROC (ties count half) and average precision; null where a cell has one class."""
    at = _by_score(df, ctx, score, positive)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2)
    return at.groupBy(*ctx).agg(
        F.try_divide(area, F.max(F.col("p").cast("double") * F.col("n"))).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.nullif(F.max("p"), F.lit(0))).alias("average_precision"),
        F.when(F.max(F.least("p", "n")) == 0, "single_class").otherwise("ok").alias("status"),
    )


def best_balanced_threshold(df: DataFrame, ctx: list[str], score: str, positive: str) -> DataFrame:
    """The threshold in (0, 1) with the best balanced accuracy; ties (to 1e-15) go to the highest."""
    at = _by_score(df, ctx, score, positive).where("score > 0 AND score < 1")
    rated = at.withColumn("balanced_accuracy", (F.try_divide("tp", "p") + 1 - F.try_divide("fp", "n")) / 2)
    top = rated.withColumn("_best", F.max("balanced_accuracy").over(W.partitionBy(*ctx))).where("balanced_accuracy >= _best - 1e-15")
    return top.groupBy(*ctx).agg(F.max("score").alias("q"), F.max("balanced_accuracy").alias("balanced_accuracy"))


def average_rank(df: DataFrame, ctx: list[str], column: str, name: str) -> DataFrame:
    """df with the average rank of column: ranks of ties are shared. Ranked over distinct values only."""
    at = df.groupBy(*ctx, column).agg(F.count("*").alias("_m"))
    below = F.coalesce(F.sum("_m").over(W.partitionBy(*ctx).orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(at.select(*ctx, column, (below + (F.col("_m") + 1) / 2).alias(name)), [*ctx, column])


def correlations(df: DataFrame, ctx: list[str], columns: list[str], ranks: bool = False) -> DataFrame:
    """(ctx, a, b, r) for every pair of columns: Pearson's, or Spearman's of average ranks."""
    if ranks:
        for c in columns:
            df = average_rank(df, ctx, c, f"_r_{c}")
    own = {c: f"_r_{c}" if ranks else c for c in columns}
    wide = df.groupBy(*ctx).agg(*[F.corr(own[a], own[b]).alias(f"{a}|{b}") for a in columns for b in columns])
    stack = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a in columns for b in columns)
    return wide.select(*ctx, F.expr(f"stack({len(columns) ** 2}, {stack}) AS (a, b, r)"))
