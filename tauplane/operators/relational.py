"""Checked joins, set comparisons, upserts, and audits of tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which the right side of a look-up join is broadcast.
BROADCAST = 200_000


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("many")).where("many > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    found = duplicates(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"{keys} aren't unique: {found[0].asDict()}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "many_to_one", complete: bool = False) -> DataFrame:
    """A join whose key uniqueness is checked (one_to_one: on both sides); complete: every left row must find its partner."""
    assert_unique(right, keys)
    if validate == "one_to_one":
        assert_unique(left, keys)
    if complete and (missing := left.join(right, keys, "left_anti").limit(1).collect()):
        raise ValueError(f"no partner for {missing[0].asDict()}")
    small = how in ("left", "inner") and right.limit(BROADCAST + 1).count() <= BROADCAST
    return left.join(F.broadcast(right) if small else right, keys, how)


def ordered_lookup(df: DataFrame, request: DataFrame, key: str) -> DataFrame:
    """The rows of df for the keys of request (key, position), in the order asked for; an unknown key is an error."""
    return checked_join(request, df, [key], "left", complete=True).orderBy("position")


def side_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a full outer join by where they are: both, left_only, right_only."""
    a, b = left.select(*keys, F.lit(True).alias("_l")), right.select(*keys, F.lit(True).alias("_r"))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("many"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, then new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def overlap_matrix(df: DataFrame, part: str, unit: str) -> DataFrame:
    """(left, right, shared): how many units each pair of parts has in common, 0 included."""
    sets = df.groupBy(unit).agg(F.collect_set(part).alias("ps"))  # a unit's parts: as many as there are parts at most
    pairs = sets.select(F.explode("ps").alias("left"), "ps").select("left", F.explode("ps").alias("right")).groupBy("left", "right").agg(F.count("*").alias("shared"))
    parts = df.select(F.col(part).alias("left")).distinct()
    names = F.lit([r[0] for r in parts.orderBy("left").collect()])
    return parts.select("left", F.explode(names).alias("right")).join(pairs, ["left", "right"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))


def value_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """For each column: rows of either side, and those that differ by more than the tolerance, in being null or in being there."""
    own = lambda df, side: df.select(*keys, F.lit(True).alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    both = own(left, "l").join(own(right, "r"), keys, "full_outer")
    there = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    differs = {c: ~(there & F.coalesce(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= tolerance, F.col(f"l_{c}").isNull() & F.col(f"r_{c}").isNull())) for c in columns}
    wide = both.agg(F.count("*").alias("n"), *[F.count_if(d).alias(c) for c, d in differs.items()])
    return wide.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', n, `{c}`" for c in columns) + ") AS (column_name, n, n_differ)"))


def checklist(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations, status) of every rule, a boolean column that is true where a row breaks it, in one pass."""
    wide = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in checks.items()])
    rows = wide.select(F.expr(f"stack({len(checks)}, " + ", ".join(f"'{k}', `{k}`" for k in checks) + ") AS (check, violations)"))
    return rows.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def resolve_duplicates(df: DataFrame, key: str, digest: str, exists: str) -> DataFrame:
    """Groups of several rows with one key: of the same hash, in conflict, or pending where a file is missing."""
    found = df.groupBy(key).agg(F.count("*").alias("many"), F.count_distinct(digest).alias("hashes"), F.bool_and(exists).alias("all_exist"))
    return found.where("many > 1").withColumn("resolution", F.when(~F.col("all_exist"), "pending").when(F.col("hashes") == 1, "same_hash").otherwise("conflict"))


def near_duplicate_groups(df: DataFrame, phash: str) -> DataFrame:
    """df with near_duplicate_group, which only shared hashes have."""
    shared = duplicates(df.where(F.col(phash).isNotNull()), [phash]).select(phash, F.concat(F.lit("phash:"), phash).alias("near_duplicate_group"))
    return df.join(shared, phash, "left")


def changed_files(registry: DataFrame, now: DataFrame) -> DataFrame:
    """Freeze check: (relative_path, status) of files that are missing, new, or of other size or hash than registered."""
    a = registry.select("relative_path", F.struct("size_bytes", "sha256").alias("was"))
    b = now.select("relative_path", F.struct("size_bytes", "sha256").alias("is"))
    status = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unregistered").when(F.col("was") != F.col("is"), "changed").otherwise("unchanged")
    return a.join(b, "relative_path", "full_outer").select("relative_path", status.alias("status"))


def verdict(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A result's change: material if the status, coverage (.01) or risk (.005) moved, else better or worse by AURC (1e-4), else stable."""
    both = old.select(*keys, F.struct("status", "coverage", "selective_risk", "aurc").alias("o")).join(new.select(*keys, F.struct("status", "coverage", "selective_risk", "aurc").alias("n")), keys)
    moved = (F.col("o.status") != F.col("n.status")) | (F.abs(F.col("o.coverage") - F.col("n.coverage")) > 0.01) | (F.abs(F.col("o.selective_risk") - F.col("n.selective_risk")) > 0.005)
    d = F.col("n.aurc") - F.col("o.aurc")
    kind = F.when(F.coalesce(moved, F.lit(False)), "material_change").when(d < -1e-4, "better").when(d > 1e-4, "worse").otherwise("stable")
    return both.select(*keys, kind.alias("verdict"))


def with_thresholds(df: DataFrame, thresholds: DataFrame, keys: list[str], name: str = "threshold") -> DataFrame:
    """df with the threshold of each row's cell; a row whose cell isn't in the map is an error, one whose threshold is null is not."""
    assert_unique(thresholds, keys)
    known = thresholds.select(*keys, F.struct(F.col(name).alias("value")).alias("_at"))
    small = known.limit(BROADCAST + 1).count() <= BROADCAST
    found = df.join(F.broadcast(known) if small else known, keys, "left")
    unmatched = F.raise_error(F.concat_ws(" ", F.lit("no threshold for"), *[F.col(k).cast("string") for k in keys]))
    return found.withColumn(name, F.when(F.col("_at").isNull(), unmatched.cast("double")).otherwise(F.col("_at.value"))).drop("_at")


def is_near(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """The join condition of keys that are numbers: equal within the tolerance."""
    return F.abs(a - b) <= tolerance


def old_and_new(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, and of every value old_, new_ and delta_ (new - old), for rows of either side."""
    a = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values])
    b = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values])
    return a.join(b, keys, "full_outer").select(*keys, *[x for v in values for x in (F.col(f"old_{v}"), F.col(f"new_{v}"), (F.col(f"new_{v}") - F.col(f"old_{v}")).alias(f"delta_{v}"))])


def running_plan(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """Stages in order with their cumulative size; the table is a plan of some hundred rows, so one window over all is meant."""
    return df.withColumn("cumulative", F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def two_bin_split(sizes: dict[str, int], capacity: tuple[int, int]) -> dict[str, int] | None:
    """Which of two disks gets each item, so that both fit and the fuller one is least full; exact, by reachable sums (None: it can't be)."""
    reach: dict[int, tuple[str, ...]] = {0: ()}
    for name, size in sorted(sizes.items()):
        for total, chosen in list(reach.items()):
            if total + size <= capacity[0] and total + size not in reach:
                reach[total + size] = (*chosen, name)
    whole = sum(sizes.values())
    fits = [t for t in reach if whole - t <= capacity[1]]
    if not fits:
        return None
    best = min(fits, key=lambda t: (max(t / max(capacity[0], 1), (whole - t) / max(capacity[1], 1)), t))
    return {name: 0 if name in reach[best] else 1 for name in sizes}


def two_level_split(sizes: dict[str, dict[str, int]], capacity: tuple[int, int]) -> dict[tuple[str, str], int] | None:
    """two_bin_split of whole generators; where they don't fit, of their families."""
    whole = two_bin_split({g: sum(own.values()) for g, own in sizes.items()}, capacity)
    if whole is not None:
        return {(g, f): whole[g] for g, own in sizes.items() for f in own}
    names = [(g, f) for g, own in sorted(sizes.items()) for f in sorted(own)]
    found = two_bin_split({f"{k:06d}": sizes[g][f] for k, (g, f) in enumerate(names)}, capacity)
    return found and {name: found[f"{k:06d}"] for k, name in enumerate(names)}


def is_close(a: float, b: float, tolerance: float) -> bool:
    return math.isclose(a, b, rel_tol=0, abs_tol=tolerance)
