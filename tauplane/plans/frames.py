"""Score frames over the driver's tables, and the same frames in SQL for DuckDB.

A score frame has sample_id, detector, split, generator, sha256, label, p, score
(the logit), base_prediction, base_error and risk_score. Scores are rounded to 6
digits where they are made, so that both engines hold equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauplane.functions import scores as S

#: (detector, weight of the quantity, weight of discount and tax); the last is hardly informative.
DETECTORS = (("a", 0.35, 2.0), ("b", 0.5, 3.0), ("c", 0.0, 0.5))
VIEWS = 5
CTX = ["detector", "split"]
#: Two thresholds whose results are compared.
TAU_REGISTRY = (0.2, 0.21)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _logit(a: Column, b: Column) -> Column:
    return a * (F.col("l_quantity") - F.lit(25.5)) + b * ((F.col("l_discount") - F.lit(0.05)) / F.lit(0.05) + (F.col("l_tax") - F.lit(0.04)) / F.lit(0.04))


def _judged(df: DataFrame, of: str = "") -> DataFrame:
    """df, which has label and score, with p, risk_score, base_prediction and base_error; of: the end of these names, but for label."""
    p = df.withColumn(f"p{of}", F.round(S.sigmoid(F.col(f"score{of}")), 6))
    risk = p.withColumn(f"risk_score{of}", F.round(S.msp_risk(F.col(f"p{of}")), 6)).withColumn(f"base_prediction{of}", S.predicted(F.col(f"p{of}")))
    return risk.withColumn(f"base_error{of}", S.base_error(F.col(f"base_prediction{of}"), F.col("label")))


SAMPLE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in DETECTORS]))
    named = {"_sample": F.concat_ws("-", *SAMPLE), "_unit": F.sha2(F.col("l_orderkey").cast("string"), 256)}
    rows = table(spark, sf_dir, "lineitem").withColumns(named).withColumn("d", kinds)  # a row is hashed once, not for each detector
    framed = rows.select(
        F.col("_sample").alias("sample_id"), "d.detector", F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("generator"),
        F.col("_unit").alias("sha256"), (F.col("l_quantity") > 25).cast("int").alias("label"), F.round(_logit(F.col("d.a"), F.col("d.b")), 6).alias("score"),
    )
    return _judged(framed)


def wide_scores(rows: DataFrame) -> DataFrame:
    """Rows of lineitem with what scores() says of them, for each detector in columns of their own: risk_score_a and so on."""
    out = rows.withColumns({"label": (F.col("l_quantity") > 25).cast("int"), "generator": F.col("l_returnflag")})
    for n, a, b in DETECTORS:
        out = _judged(out.withColumn(f"score_{n}", F.round(_logit(F.lit(a), F.lit(b)), 6)), f"_{n}")
    return out


SCORES = (
    "k(detector, a, b) AS (VALUES " + ", ".join(f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for n, a, b in DETECTORS) + """),
    f1 AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id, detector, l_linestatus AS split, l_returnflag AS generator,
                  sha256(CAST(l_orderkey AS VARCHAR)) AS sha256, CAST(l_quantity > 25 AS INT) AS label,
                  round(a * (l_quantity - CAST(25.5 AS DOUBLE)) + b * ((l_discount - CAST(0.05 AS DOUBLE)) / CAST(0.05 AS DOUBLE) + (l_tax - CAST(0.04 AS DOUBLE)) / CAST(0.04 AS DOUBLE)), 6) AS score
           FROM lineitem, k),
    f2 AS (SELECT *, round(CASE WHEN score >= 0 THEN 1 / (1 + exp(-score)) ELSE exp(score) / (1 + exp(score)) END, 6) AS p FROM f1),
    f AS (SELECT *, round(1 - greatest(p, 1 - p), 6) AS risk_score, CAST(p >= 0.5 AS INT) AS base_prediction, CAST(CAST(p >= 0.5 AS INT) <> label AS INT) AS base_error FROM f2)"""
)


def orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, view_index, logit, gamma): five views of every event of the events table, the identity first."""
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id"))
    shift = (F.pmod(F.col("user_id") * (F.col("view_index") + 1), F.lit(7)) - 3) * F.lit(0.25) * F.least("view_index", F.lit(1))
    views = rows.withColumn("view_index", F.explode(F.sequence(F.lit(0), F.lit(VIEWS - 1))))
    return views.select(F.col("event_id").alias("parent"), "view_index", F.round(F.log1p(F.abs("value")) - F.lit(3.0) + shift, 6).alias("logit"))


ORBIT = """
    o AS (SELECT event_id AS parent, CAST(i AS INT) AS view_index,
                 round(ln(1 + abs(value)) - CAST(3.0 AS DOUBLE) + (((user_id * (i + 1)) % 7 + 7) % 7 - 3) * CAST(0.25 AS DOUBLE) * least(i, 1), 6) AS logit
          FROM events, range(0, 5) AS t(i))"""
GAMMA = 0.0


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their content hash."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha256"))


TEXTS = "t AS (SELECT doc_id, lang, source, sha256(text) AS sha256 FROM documents)"
