"""Distances over embeddings: exact cosine kNN in blocks, support distances, Mahalanobis."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tauplane.functions.scores import dot

#: Vectors of the bank in a block, which is what a task holds.
BLOCK = 20_000
SCHEMA = "query_id long, bank_id long, distance double"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    if not np.isfinite(norm).all() or (norm == 0).any():
        raise ValueError("an embedding has a zero or non-finite norm")
    return x / norm


def knn(queries: DataFrame, bank: DataFrame, k: int, exclude: list[str] = ["id"], block: int = BLOCK, metric: str = "cosine") -> DataFrame:
    """(query_id, bank_id, distance, place): the k nearest of the bank by cosine (or euclidean) distance; ties by bank id.

    queries and bank have id, embedding and the columns of exclude: a bank row that
    is equal to the query in one of these doesn't count. The bank is cut into
    blocks of hashed ids; a task holds one block and some queries and keeps k of
    them, so neither a bank nor all pairs are ever in one place.
    """
    columns = ["id", "embedding", *[c for c in exclude if c != "id"]]
    blocks = max(1, -(-bank.count() // block))
    # A task's queries are bounded like its bank, and there is work for all cores.
    parts = max(-(-queries.count() // block), queries.sparkSession.sparkContext.defaultParallelism // blocks, 1)
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_p"), *columns)
    right = bank.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_p"), *columns)

    def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(b):
            b = b.sort_values("id")
            matrix, ids = np.stack(b["embedding"].to_numpy()).astype(np.float64), b["id"].to_numpy()
            matrix = _unit(matrix) if metric == "cosine" else matrix
            for start in range(0, len(q), 512):
                part = q.iloc[start : start + 512]
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                d = 1 - _unit(x) @ matrix.T if metric == "cosine" else np.sqrt(sum((x[:, [j]] - matrix[None, :, j]) ** 2 for j in range(x.shape[1])))
                for c in exclude:
                    d[part[c].to_numpy()[:, None] == b[c].to_numpy()[None, :]] = np.inf
                d = np.round(d, 12)
                order = np.argsort(d, 1, kind="stable")[:, :k]
                found = np.take_along_axis(d, order, 1)
                rows, places = np.nonzero(np.isfinite(found))
                out.append(pd.DataFrame({"query_id": part["id"].to_numpy()[rows], "bank_id": ids[order[rows, places]], "distance": found[rows, places]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "bank_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})

    found = left.groupBy("_b", "_p").cogroup(right.groupBy("_b", "_p")).applyInPandas(nearest, SCHEMA)
    w = W.partitionBy("query_id").orderBy("distance", "bank_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def knn_risk(neighbours: DataFrame, k: int) -> DataFrame:
    """Mean distance to the k nearest, the nearest and its distance; an error where a query has fewer."""
    out = neighbours.groupBy("query_id").agg(F.avg("distance").alias("risk"), F.min("distance").alias("first_distance"), F.min_by("bank_id", "place").alias("first_id"), F.count("*").alias("neighbours"))
    return out.withColumn("risk", F.when(F.col("neighbours") < k, F.raise_error(F.lit("fewer than k eligible neighbours"))).otherwise(F.col("risk")))


def risk_by_k(neighbours: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, risk) for several k from one search at the largest."""
    w = W.partitionBy("query_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return neighbours.withColumn("risk", F.avg("distance").over(w)).where(F.col("place").isin(ks)).select("query_id", F.col("place").alias("k"), "risk")


def select_k(neighbours: DataFrame, errors: DataFrame, ks: list[int]) -> tuple[int, DataFrame]:
    """(k, table of fold, k, auroc, status, selected_k): the k of the largest mean AUROC of risks against errors over folds.

    neighbours: those of each query outside its own fold, max(ks) at least; errors:
    query_id, fold, base_error. Folds of one class don't count; ties go to the
    smaller k, and so it is where no fold counts. The folds' grouping (by rows, or
    by content hash) is the caller's.
    """
    from tauplane.operators.ranking import auroc_average_precision

    rated = risk_by_k(neighbours, ks).join(errors, "query_id")
    found = auroc_average_precision(rated, ["fold", "k"], "risk", "base_error").select("fold", "k", F.when(F.col("status") == "ok", F.col("auroc")).alias("auroc"), F.when(F.col("status") == "ok", "ok").otherwise("undefined_due_to_single_error_class").alias("status"))
    means = found.where("status = 'ok'").groupBy("k").agg(F.round(F.avg("auroc"), 12).alias("mean")).orderBy(F.desc("mean"), "k").first()  # one row for each k
    chosen = means["k"] if means else min(ks)
    return chosen, found.withColumn("selected_k", F.lit(chosen))


def bank_sensitivity(all_rows: DataFrame, one_per_unit: DataFrame, ks: tuple[int, int], tolerance: float = 0.999) -> DataFrame:
    """How far the risks by two banks (query_id, risk) agree: chosen k, Spearman's correlation, mean and largest difference, and a verdict."""
    from tauplane.operators.ranking import correlations

    both = all_rows.select("query_id", F.col("risk").alias("a")).join(one_per_unit.select("query_id", F.col("risk").alias("b")), "query_id").withColumn("cell", F.lit(1))
    rho = correlations(both, ["cell"], ["a", "b"], ranks=True).where("a = 'a' AND b = 'b'").select("cell", F.col("r").alias("spearman"))
    d = F.abs(F.col("a") - F.col("b"))
    out = both.groupBy("cell").agg(F.count("*").alias("n"), F.avg(d).alias("mean_abs_difference"), F.max(d).alias("max_abs_difference")).join(rho, "cell").drop("cell")
    return out.withColumn("selected_k_equal", F.lit(ks[0] == ks[1])).withColumn("material", ~(F.col("selected_k_equal") & (F.col("spearman") >= tolerance)))


def class_moments(df: DataFrame, label: str) -> DataFrame:
    """(label, n, sums, products): what mean and covariance of each class need, summed on the map side."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, own in batch.groupby("y"):
                x = np.stack(own["embedding"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"y": [y], "n": [len(x)], "sums": [x.sum(0)], "products": [(x.T @ x).ravel()], "fourth": [float(((x * x).sum(1) ** 2).sum())]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": group["y"][:1], "n": [group["n"].sum()], "sums": [np.sum(list(group["sums"]), 0)], "products": [np.sum(list(group["products"]), 0)], "fourth": [group["fourth"].sum()]})

    schema = "y int, n long, sums array<double>, products array<double>, fourth double"
    return df.select(F.col(label).cast("int").alias("y"), "embedding").mapInPandas(count, schema).groupBy("y").applyInPandas(add, schema)


def ledoit_wolf(x_cov: np.ndarray, n: int, mean_fourth: float) -> tuple[np.ndarray, float]:
    """The shrunk covariance and its shrinkage (Ledoit and Wolf 2004); mean_fourth: mean of ||x||**4 of the centred rows."""
    d = len(x_cov)
    mu = np.trace(x_cov) / d
    delta = ((x_cov - mu * np.eye(d)) ** 2).sum() / d
    beta = min((mean_fourth - (x_cov**2).sum()) / (n * d), delta)
    shrinkage = float(beta / delta) if delta > 0 else 1.0
    return (1 - shrinkage) * x_cov + shrinkage * mu * np.eye(d), shrinkage


@dataclass
class Mahalanobis:
    """The mean and scale of every dimension, and of each class (in these z-scores) its mean, precision, shrinkage and condition number."""

    mean: np.ndarray
    scale: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, float, float]]


def fit_mahalanobis(df: DataFrame, label: str) -> Mahalanobis:
    """Two passes of aggregates; classes and dimensions bound what comes to the driver. Dimensions that hardly vary keep their scale."""
    found = class_moments(df, label).collect()  # one row for each class
    n = sum(r["n"] for r in found)
    mean = sum(np.array(r["sums"]) for r in found) / n
    d = len(mean)
    spread = np.sqrt(np.maximum(sum(np.diag(np.array(r["products"]).reshape(d, d)) for r in found) / n - mean**2, 0))
    scale = np.where(spread < 1e-8, 1.0, spread)
    means = {r["y"]: (np.array(r["sums"]) / r["n"] - mean) / scale for r in found}
    if small := [r["y"] for r in found if r["n"] < 2]:
        raise ValueError(f"classes {small} have too few samples for a covariance")
    sent = df.sparkSession.sparkContext.broadcast((mean, scale, means))

    @F.pandas_udf("array<double>")
    def centred(v: pd.Series, y: pd.Series) -> pd.Series:
        own_mean, own_scale, of = sent.value
        x = (np.stack(v.to_numpy()).astype(np.float64) - own_mean) / own_scale - np.stack([of[k] for k in y])
        return pd.Series(list(x))

    classes = {}
    for r in class_moments(df.withColumn("embedding", centred("embedding", F.col(label).cast("int"))), label).collect():  # one row for each class
        cov, shrinkage = ledoit_wolf(np.array(r["products"]).reshape(d, d) / r["n"], r["n"], r["fourth"] / r["n"])
        classes[r["y"]] = (means[r["y"]], np.linalg.pinv(cov), shrinkage, float(np.linalg.cond(cov)))
    return Mahalanobis(mean, scale, classes)


def mahalanobis_risk(df: DataFrame, model: Mahalanobis) -> DataFrame:
    """df with risk, the squared distance to the nearest class, and nearest_class."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("risk double, nearest_class int")
    def nearest(v: pd.Series) -> pd.DataFrame:
        own = sent.value
        x, labels = (np.stack(v.to_numpy()).astype(np.float64) - own.mean) / own.scale, sorted(own.classes)
        d = np.stack([np.einsum("ij,jk,ik->i", x - own.classes[y][0], own.classes[y][1], x - own.classes[y][0]) for y in labels], 1)
        return pd.DataFrame({"risk": d.min(1), "nearest_class": np.array(labels)[d.argmin(1)]})

    return df.withColumn("_m", nearest("embedding")).select("*", "_m.risk", "_m.nearest_class").drop("_m")


def cosine_distance_column(a: str, b: str):
    """1 - cosine of two arrays of one length, in SQL functions."""
    return 1 - dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b)))


def cholesky_precision(cov: np.ndarray, jitter: float = 1e-8, tries: int = 6) -> np.ndarray:
    """The inverse by a Cholesky factor, with growing jitter on the diagonal; the pseudo-inverse if none will do."""
    for k in range(tries):
        try:
            factor = np.linalg.inv(np.linalg.cholesky(cov + (jitter * 10**k if k else 0.0) * np.eye(len(cov))))
        except np.linalg.LinAlgError:
            continue
        return factor.T @ factor
    return np.linalg.pinv(cov)


def displacement_risk(df: DataFrame, parent: str, index: str) -> DataFrame:
    """(parent, risk): the mean over views of the Mahalanobis length of its displacement from the identity view (index 0).

    Displacements are summed by view in two aggregates; views and dimensions bound what comes to the driver.
    """
    first = df.where(F.col(index) == 0).select(parent, F.col("embedding").alias("_e0"))
    moved = df.where(F.col(index) > 0).join(first, parent).select(parent, F.col(index).cast("int").alias("y"), F.zip_with("embedding", "_e0", lambda a, b: a.cast("double") - b.cast("double")).alias("embedding"))
    model = {}
    for r in class_moments(moved, "y").collect():
        d = len(r["sums"])
        mean = np.array(r["sums"]) / r["n"]
        model[r["y"]] = mean, cholesky_precision(np.array(r["products"]).reshape(d, d) / r["n"] - np.outer(mean, mean))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def length(v: pd.Series, y: pd.Series) -> pd.Series:
        x, kinds, out = np.stack(v.to_numpy()).astype(np.float64), y.to_numpy(), np.zeros(len(v))
        for k in np.unique(kinds):
            own = x[kinds == k] - sent.value[k][0]
            out[kinds == k] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", own, sent.value[k][1], own), 0))
        return pd.Series(out)

    return moved.withColumn("_d", F.pandas_udf(length, "double")("embedding", "y")).groupBy(parent).agg(F.avg("_d").alias("risk"))


def robust_local_drift(df: DataFrame, key: str, a: str, b: str, value: str, k: int, cells: int = 64) -> DataFrame:
    """(key, drift): how far value is above the median of its cell in the plane of (a, b), in robust deviations (1.4826 MAD), 0 at least.

    Neighbourhoods are cells of a grid over the z-scores of a and b: a row's own cell where it has k rows, else all rows.
    """
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    place = [F.floor((F.col(c) - stats[f"m_{c}"]) / max(stats[f"s_{c}"] or 0, 1e-12) * (cells / 8)).alias(f"_{n}") for c, n in ((a, "x"), (b, "y"))]
    rows = df.select(key, F.col(value).alias("_v"), *place)
    at = rows.groupBy("_x", "_y").agg(F.percentile("_v", 0.5).alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= k)
    whole = rows.agg(F.percentile("_v", 0.5)).first()[0]
    near = rows.join(at, ["_x", "_y"], "left").withColumns({"_c": F.col("_m").isNotNull(), "_d": F.col("_v") - F.coalesce("_m", F.lit(whole))})
    group = [F.when(F.col("_c"), F.col("_x")).alias("_gx"), F.when(F.col("_c"), F.col("_y")).alias("_gy")]
    keyed = near.select(key, "_d", *group)
    mad = keyed.groupBy("_gx", "_gy").agg((F.percentile(F.abs("_d"), 0.5) * 1.4826).alias("_mad")).withColumnsRenamed({"_gx": "_hx", "_gy": "_hy"})
    out = keyed.join(mad, F.col("_gx").eqNullSafe(F.col("_hx")) & F.col("_gy").eqNullSafe(F.col("_hy")))
    return out.select(key, F.greatest(F.col("_d") / F.greatest("_mad", F.lit(1e-6)), F.lit(0.0)).alias("drift"))
