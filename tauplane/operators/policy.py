"""Acceptance thresholds: scans, selection, candidates, certification and its analysis.

All steps first reduce rows to distinct (risk, group) blocks, so windows run
over distinct scores, and cells, candidates and groups are columns, not loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tauplane.functions.bounds import cp_feasible, with_cp_upper
from tauplane.functions.text import stable_rank
from tauplane.operators.ranking import prefix_blocks, ranked, small
from tauplane.sources.freeze import freeze

FRACTIONS = tuple(k / 10 for k in range(10, 0, -1))
#: A cell's candidates are fractions of its largest feasible count, or of all rows where nothing is feasible.
MOST_CANDIDATES = 10


def threshold_curve(df: DataFrame, ctx: list[str], delta: float) -> DataFrame:
    """The block curve with the Clopper-Pearson upper bound at every threshold."""
    return with_cp_upper(prefix_blocks(df, ctx), "accepted_errors", "accepted_count", F.lit(float(delta)))


def select_threshold(curve: DataFrame, ctx: list[str], alpha: float, bound: str = "cp_upper", cells: DataFrame | None = None) -> DataFrame:
    """The feasible threshold that accepts most (then the least bound, empirical risk and threshold); a status where there is none.

    cells: all cells asked for; those without a row of the curve have no_samples.
    """
    w = W.partitionBy(*ctx).orderBy(F.desc("accepted_count"), bound, "empirical_risk", "threshold")
    chosen = curve.where((F.col("accepted_count") > 0) & (F.col(bound) <= alpha)).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    there = curve.select(*ctx).distinct().withColumn("_there", F.lit(True))
    return (
        (there if cells is None else cells.select(*ctx).distinct().join(there, ctx, "left")).join(chosen.select(*ctx, F.col("threshold").alias("tau"), "accepted_count", "accepted_errors", "coverage", bound), ctx, "left")
        .withColumn("status", F.when(F.col("_there").isNull(), "no_samples").when(F.col("tau").isNull(), "no_feasible_nonempty_threshold").otherwise("selected")).drop("_there")
        .withColumns({"accepted_count": F.coalesce("accepted_count", F.lit(0)), "coverage": F.coalesce("coverage", F.lit(0.0))})
    )


def group_blocks(df: DataFrame, ctx: list[str], group: str) -> DataFrame:
    """ctx, threshold, g, n, e: rows and errors of every distinct risk and group."""
    return df.groupBy(*ctx, F.col("risk_score").alias("threshold"), F.col(group).alias("g")).agg(F.count("*").alias("n"), F.sum(F.col("base_error").cast("long")).alias("e"))


def group_scan(df: DataFrame, ctx: list[str], group: str, alpha: float) -> DataFrame:
    """For every distinct risk: the accepted counts, and whether each group of the cell has rows and an error rate of alpha at most."""
    return scan_blocks(group_blocks(df, ctx, group), ctx, F.col("_e") / F.col("_n") <= alpha)


def scan_blocks(blocks: DataFrame, ctx: list[str], fits: Column) -> DataFrame:
    """The scan from blocks; fits: whether a group does with the _n rows and _e errors up to a threshold."""
    # A group's counts only change at its own blocks, so it is infeasible or feasible from one of them to before the next; the cell's count of feasible groups is a running sum of these changes.
    own = W.partitionBy(*ctx, "g").orderBy("threshold").rowsBetween(W.unboundedPreceding, 0)
    state = blocks.withColumns({"_n": F.sum("n").over(own), "_e": F.sum("e").over(own)}).withColumn("_fits", fits.cast("int"))
    change = state.withColumn("_change", F.col("_fits") - F.coalesce(F.lag("_fits").over(W.partitionBy(*ctx, "g").orderBy("threshold")), F.lit(0)))
    at = change.groupBy(*ctx, "threshold").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("_change").alias("_change"))
    w = W.partitionBy(*ctx).orderBy("threshold").rowsBetween(W.unboundedPreceding, 0)
    groups = blocks.groupBy(*ctx).agg(F.count_distinct("g").alias("groups"))
    return at.select(*ctx, "threshold", F.sum("n").over(w).alias("accepted_count"), F.sum("e").over(w).alias("accepted_errors"), F.sum("_change").over(w).alias("groups_fit")).join(groups, ctx).withColumn("feasible", F.col("groups_fit") == F.col("groups"))


def group_controlled(df: DataFrame, ctx: list[str], group: str, alpha: float, delta: float, bonferroni: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of every cell the threshold of largest coverage at which all groups have a bound of alpha at most; and the groups' bounds there.

    Bounds are at delta, over the number of the cell's groups with bonferroni. A
    group of which nothing is accepted has the bound 1. Without a threshold, tau
    is null, coverage 0 and the worst bound 1.
    """
    blocks = freeze(group_blocks(df, ctx, group))
    sized = blocks.join(small(blocks.groupBy(*ctx).agg(F.count_distinct("g").alias("groups"))), ctx)
    level = F.lit(float(delta)) / F.col("groups") if bonferroni else F.lit(float(delta))
    scan = scan_blocks(sized, ctx, cp_feasible("_e", "_n", level, F.lit(float(alpha))))
    cells = scan.groupBy(*ctx).agg(F.max(F.when(F.col("feasible"), F.col("threshold"))).alias("tau"), F.max("accepted_count").alias("_all"), F.max(F.when(F.col("feasible"), F.col("accepted_count"))).alias("_accepted"))
    cells = freeze(cells)
    bounds = group_bounds(blocks, cells.where("tau IS NOT NULL").select(*ctx, "tau"), ctx, delta, bonferroni)
    worst = bounds.groupBy(*ctx).agg(F.max("cp_upper").alias("worst_cp_upper"))
    out = cells.join(worst, ctx, "left").select(*ctx, "tau", F.coalesce(F.col("_accepted") / F.col("_all"), F.lit(0.0)).alias("coverage"), F.coalesce("worst_cp_upper", F.lit(1.0)).alias("worst_cp_upper"))
    return out, bounds


def group_bounds(blocks: DataFrame, at: DataFrame, ctx: list[str], delta: float, bonferroni: bool = False) -> DataFrame:
    """Of every group at the threshold tau of its cell: accepted rows and errors, empirical risk (1 where nothing is accepted), coverage and bound."""
    joined = blocks.join(small(at), ctx)
    inside = F.col("threshold") <= F.col("tau")
    own = joined.groupBy(*ctx, "tau", "g").agg(F.sum("n").alias("_total"), F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("accepted_count"), F.coalesce(F.sum(F.when(inside, F.col("e"))), F.lit(0)).alias("accepted_errors"))
    own = own.withColumns({"empirical_risk": F.coalesce(F.try_divide("accepted_errors", "accepted_count"), F.lit(1.0)), "coverage": F.col("accepted_count") / F.col("_total"), "_groups": F.count("*").over(W.partitionBy(*ctx))})
    level = F.lit(float(delta)) / F.col("_groups") if bonferroni else F.lit(float(delta))
    return with_cp_upper(own, "accepted_errors", "accepted_count", level).drop("_total", "_groups")


def candidates(scan: DataFrame, ctx: list[str]) -> DataFrame:
    """At most MOST_CANDIDATES thresholds of a cell: the largest blocks within fractions of the largest feasible count (else of all rows), by falling threshold."""
    base = scan.groupBy(*ctx).agg(F.max(F.when(F.col("feasible"), F.col("accepted_count"))).alias("_feasible"), F.max("accepted_count").alias("_all"))
    grid = F.explode(F.array(*[F.lit(f) for f in FRACTIONS]))
    targets = base.select(*ctx, F.coalesce("_feasible", "_all").alias("_base"), F.col("_feasible").isNotNull().alias("from_feasible"), grid.alias("fraction"))
    targets = targets.withColumn("target", F.greatest(F.lit(1), F.floor(F.col("fraction") * F.col("_base"))).cast("long"))
    found = scan.join(small(targets), ctx).where("accepted_count <= target").groupBy(*ctx, "fraction", "from_feasible").agg(F.max("threshold").alias("tau"))
    once = found.groupBy(*ctx, "tau").agg(F.max("fraction").alias("fraction"), F.first("from_feasible").alias("from_feasible"))
    ranked = once.withColumn("candidate_rank", F.row_number().over(W.partitionBy(*ctx).orderBy(F.desc("tau")))).where(F.col("candidate_rank") <= MOST_CANDIDATES)
    return ranked.withColumn("candidate_id", stable_rank(*[F.col(c) for c in ctx], F.round("tau", 9).cast("decimal(20,9)")))


def certification_counts(df: DataFrame, cand: DataFrame, ctx: list[str], group: str | None) -> DataFrame:
    """n and k of every candidate and group, also of groups of which nothing is accepted; K candidates and G groups of the cell. Without group, df has blocks."""
    blocks = df if group is None else group_blocks(df, ctx, group)
    groups = blocks.select(*ctx, "g").distinct()
    sized = cand.withColumn("candidates", F.count("*").over(W.partitionBy(*ctx)))
    grid = sized.select(*ctx, "candidate_id", "candidate_rank", "tau", "candidates").join(groups, ctx).join(groups.groupBy(*ctx).agg(F.count("*").alias("groups")), ctx)
    hits = blocks.join(small(sized.select(*ctx, "candidate_id", "tau")), ctx).where("threshold <= tau").groupBy(*ctx, "candidate_id", "g").agg(F.sum("n").alias("accepted_count"), F.sum("e").alias("accepted_errors"))
    zero = {"accepted_count": F.coalesce("accepted_count", F.lit(0)).cast("long"), "accepted_errors": F.coalesce("accepted_errors", F.lit(0)).cast("long")}
    return grid.join(hits, [*ctx, "candidate_id", "g"], "left").withColumns(zero)


def certify(df: DataFrame, cand: DataFrame, ctx: list[str], group: str | None, alpha: float, delta: float) -> DataFrame:
    """The trace: each candidate and group with its bound at delta / (K * G), and whether group and candidate are certified."""
    counts = certification_counts(df, cand, ctx, group)
    trace = with_cp_upper(counts, "accepted_errors", "accepted_count", F.lit(float(delta)) / (F.col("candidates") * F.col("groups")))
    trace = trace.withColumn("group_certified", (F.col("accepted_count") > 0) & (F.col("cp_upper") <= alpha))
    return trace.withColumn("candidate_certified", F.min("group_certified").over(W.partitionBy(*ctx, "candidate_id")))


def certified_policy(trace: DataFrame, ctx: list[str]) -> DataFrame:
    """Of a cell's certified candidates the one of the highest threshold (then coverage, bound, id); NO_CERTIFIED_THRESHOLD where there is none."""
    each = trace.groupBy(*ctx, "candidate_id", "tau").agg(F.min("candidate_certified").alias("ok"), F.sum("accepted_count").alias("accepted_count"), F.max("cp_upper").alias("max_cp_upper"))
    w = W.partitionBy(*ctx).orderBy(F.desc("tau"), F.desc("accepted_count"), "max_cp_upper", "candidate_id")
    chosen = each.where("ok").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "ok")
    return each.select(*ctx).distinct().join(chosen, ctx, "left").withColumns({"status": F.when(F.col("tau").isNull(), "NO_CERTIFIED_THRESHOLD").otherwise("CERTIFIED"), "accepted_count": F.coalesce("accepted_count", F.lit(0))})


def alpha_sensitivity(trace: DataFrame, ctx: list[str], alphas: list[float]) -> DataFrame:
    """Every candidate judged anew at other alphas: its bottleneck group, the groups that fail, and how far it is above the target."""
    rows = trace.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    fits = (F.col("accepted_count") > 0) & (F.col("cp_upper") <= F.col("alpha"))
    return rows.groupBy(*ctx, "candidate_id", "tau", "alpha").agg(
        F.sum("accepted_count").alias("accepted_count"),
        F.min(fits).alias("certified"),
        F.max_by("g", F.struct("cp_upper", F.col("g"))).alias("bottleneck_group"),
        F.array_join(F.array_sort(F.collect_set(F.when(~fits, F.col("g")))), ",").alias("failed_groups"),
        (F.max("cp_upper") - F.first("alpha")).alias("margin"),
    )


def best_failed(sensitivity: DataFrame, ctx: list[str]) -> DataFrame:
    """Of a cell's candidates that failed the nearest: least margin (to 12 digits), then largest coverage, highest threshold, id."""
    w = W.partitionBy(*ctx, "alpha").orderBy(F.round("margin", 12), F.desc("accepted_count"), F.desc("tau"), "candidate_id")
    return sensitivity.where("NOT certified").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def bottleneck(trace: DataFrame, policy: DataFrame, ctx: list[str]) -> DataFrame:
    """The group with the largest bound (then the fewest rows) at each selected threshold."""
    w = W.partitionBy(*ctx).orderBy(F.desc("cp_upper"), "accepted_count", "g")
    return trace.join(small(policy.where("tau IS NOT NULL").select(*ctx, "candidate_id")), [*ctx, "candidate_id"]).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*ctx, "tau", F.col("g").alias("bottleneck_group"), "accepted_count", "cp_upper")


# Splits of units: rows with one content hash stay together.


def units(df: DataFrame, unit: str, strata: list[Column], order: str = "sample_id") -> DataFrame:
    """One row for each unit, with the stratum of its smallest sample."""
    return df.groupBy(unit).agg(F.min_by(F.concat_ws("|", *strata), order).alias("stratum"))


def _ranked(df: DataFrame, unit: str, strata: list[Column], *seed: str | int, named: Column | None = None) -> DataFrame:
    """named: what a unit's hash is drawn from, if not the unit itself. Bytes have the order of their hex digits, and half the length."""
    own = units(df, unit, strata).withColumn("_h", F.unhex(stable_rank(*seed, F.col(unit) if named is None else named)))
    placed = ranked(own, ["stratum"], ["_h", unit]).drop("_h")
    return placed.join(small(placed.groupBy("stratum").agg(F.count("*").alias("_n"))), "stratum")


def half_split(df: DataFrame, unit: str, strata: list[Column], seed: int) -> DataFrame:
    """unit, stratum, subset: the first half of a stratum by hash rank is for selection (a lone unit too), the rest for certification."""
    first = (F.col("_n") == 1) | (F.col("_k") <= F.floor(F.col("_n") / 2))
    return _ranked(df, unit, strata, seed).select(unit, "stratum", F.when(first, "select").otherwise("certify").alias("subset"))


def share_split(df: DataFrame, unit: str, strata: list[Column], seed: int, share: float, name: str) -> DataFrame:
    """unit, stratum, part: a share of every stratum (rounded half to even, 1 at least, all but one at most) is named."""
    take = F.least(F.greatest(F.bround(F.lit(share) * F.col("_n")), F.lit(1)), F.greatest(F.col("_n") - 1, F.lit(1)))
    return _ranked(df, unit, strata, seed, name).select(unit, "stratum", F.when(F.col("_k") <= take, name).otherwise("rest").alias("part"))


def folds(df: DataFrame, unit: str, strata: list[Column], seed: int, many: int = 5, named: Column | None = None) -> DataFrame:
    """unit, stratum, cv_fold: strata are dealt round-robin in hash order, so folds are balanced and no unit is in two."""
    return _ranked(df, unit, strata, seed, named=named).select(unit, "stratum", ((F.col("_k") - 1) % many).cast("int").alias("cv_fold"))


def fold_audit(df: DataFrame, unit: str, ctx: list[str], fold: str = "cv_fold") -> DataFrame:
    """Of every cell (the fold among its columns): rows, units, classes, and units that are in another fold too."""
    # A unit's cells come together in one row, so its folds are known there and nothing is joined.
    own = df.where(F.col(unit).isNotNull()).groupBy(unit, *ctx).agg(F.count("*").alias("_n"), F.sum(F.col("base_error").cast("long")).alias("_e"), F.sum(1 - F.col("base_error").cast("long")).alias("_c"), F.min(fold).alias("_low"), F.max(fold).alias("_high"))
    units = own.groupBy(unit).agg(F.coalesce(F.min("_low") != F.max("_high"), F.lit(False)).alias("_leaked"), F.collect_list(F.struct(*ctx, "_n", "_e", "_c")).alias("_cells"))
    return units.select("_leaked", F.inline("_cells")).groupBy(*ctx).agg(
        F.sum("_n").alias("n_rows"), F.count("*").alias("n_units"), F.sum("_e").alias("n_errors"), F.sum("_c").alias("n_correct"), F.count_if("_leaked").alias("leaked_units"),
    )
