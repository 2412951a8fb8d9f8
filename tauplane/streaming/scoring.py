"""Scoring of streams with a frozen policy, and windowed acceptance rates under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauplane.functions import scores as S
from tauplane.operators.ranking import small


def scored(stream: DataFrame, policy: DataFrame, ctx: list[str], p: str = "p") -> DataFrame:
    """Every row with risk_score and accepted by its cell's tau; a cell without a policy accepts nothing. policy: one row for each cell."""
    joined = stream.join(small(policy.select(*ctx, "tau")), ctx, "left")
    return joined.withColumn("risk_score", S.msp_risk(F.col(p))).withColumn("accepted", S.accepted(F.col("risk_score"), F.col("tau")))


def acceptance(stream: DataFrame, ctx: list[str], time: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows and accepted rows of every window; rows later than the watermark are left out."""
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, width), *ctx)
    return windowed.agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted_count")).select("window.start", "window.end", *ctx, "n", "accepted_count")
