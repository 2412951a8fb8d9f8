"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame functions only.

Every row's normalised text becomes a digest. Rows are dealt into runs; a run
keeps one entry for each digest: its smallest identifier, that is the row to
stay, and how many rows it stands for. In each binomial round `fan_in`
neighbouring runs exchange their digest ranges (a shuffle by run group and
digest) and are merged; after the last round one entry is left for a digest.
The result goes down the same tree, so that a digest which a third of all rows
share is never joined in one task: a leaf run holds 1/runs of it. The number of
runs follows that of the rows (RUN rows each, LEAST_RUNS runs at least), and
rounds are LEVELS whatever the number of runs.

Equality is verified at every level: an entry is keyed by SHA-256, a second
independent 64-bit hash and the length of the normalised text, and entries
merge only if all three agree.

Defined results: a null text counts as empty; texts that are empty after
normalisation are equal to each other; a null doc_id sorts after every other
and may stay only if no other row of its group has as long a text; repeated
rows each count, and rows that have doc_id and text in common are kept alike;
of rows that share a doc_id alone, one stays; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, settle

KEY = ["digest", "check", "length"]
RUN, LEAST_RUNS, LEVELS = 100_000, 64, 3


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def digests(docs: DataFrame, runs: int) -> DataFrame:
    """One row for each document: its identifier's order, its leaf run and the key of its normalised text."""
    return (
        docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("points"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), normalised(F.col("text")).alias("norm"))
        .select(
            "doc_id",
            "points",
            "body",
            F.floor(F.rand(7) * runs).cast("int").alias("run"),
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.xxhash64("norm").alias("check"),
            F.char_length("norm").alias("length"),
        )
    )


def exact_groups(docs: DataFrame, runs: int | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, points, digest, keep_id, group_size and kept of every row of docs."""
    runs = runs or max(LEAST_RUNS, -(-docs.count() // RUN))
    fan_in = max(2, math.ceil(runs ** (1 / levels)))
    rows = settle(digests(docs, runs))
    smallest = F.min(F.struct((-F.col("points")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body")).alias("first")
    leaves = rows.groupBy("run", *KEY).agg(smallest, F.count("*").alias("members"))
    merged, width = leaves, runs
    while width > 1:
        width = -(-width // fan_in)
        merged = merged.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *KEY).agg(F.min("first").alias("first"), F.sum("members").alias("members"))
    # Only digests that stand for more than one row go down the tree again.
    shared = merged.where("members > 1").select(*KEY, "first", "members")
    down = rows.groupBy("run", *KEY).agg(F.count("*").alias("here")).join(shared, KEY).select("run", *KEY, "first", "members")
    stays = (F.col("first.shorter") == -F.col("points")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.body") == F.col("body"))
    return rows.join(down, ["run", *KEY], "left").select(
        "doc_id",
        "points",
        "digest",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("first").isNull(), True).otherwise(stays).alias("kept"),
    )


def exact_dedup(docs: DataFrame, runs: int | None = None, levels: int = LEVELS) -> DataFrame:
    """The rows of exact_groups in the contract's columns."""
    return exact_groups(docs, runs, levels).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
