"""Quality selection by importance resampling over hashed n-grams.

Two generative models count words and word pairs in hashed buckets: the target
(labelled good: quality 1 and not toxic) and the raw text, over all documents.
A text's log weight is the sum of log(target / raw) over its n-grams, tempered
by the square root of their number, as sums of that many noisy terms spread by
that much. Gumbel noise, drawn from a hash of the row and a seed, is added, and
the k largest keys are the sample: drawing k documents without replacement in
proportion to their weights. k is the share of the labelled documents that are
good, of all rows, unless it is given.

The target model is fitted on FIT labelled good documents at most, those of the
smallest id hashes; all other counts cover all rows. Both models are vectors of
2 * BUCKETS numbers, whatever the input's size. The k-th largest key is found by
a radix search: four counts by 16 bits of the key, no sort and no list of keys.

Defined results: null, empty and blank texts have no n-grams and log weight 0.
Without labelled good documents every log weight is 0. Labels of one doc_id are
all to be good. Rows of equal key and equal doc_id are one draw: if they stand
at the edge, all of them are kept. Repeated rows draw the same noise. A null
doc_id has no label. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LineOfWords, frugal, mix, settle, slices, summed, with_bytes

BUCKETS, PRIOR, FIT, SEED = 1 << 17, 10.0, 20_000, 20_240_607
U = np.uint64


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every word and every pair of neighbours: whose it is, and its bucket."""
    line = LineOfWords(texts)
    pairs = mix(line.hashes[:-1] * U(0xD6E8FEB86659FD93) + line.hashes[1:])
    inside = line.text[1:] == line.text[:-1]
    return np.r_[line.text, line.text[1:][inside]], np.r_[line.hashes % U(BUCKETS), U(BUCKETS) + pairs[inside] % U(BUCKETS)].astype(np.int64)


def good_ids(labels: DataFrame, most: int = FIT) -> DataFrame:
    """doc_id of labelled good documents; at most that many, those of the smallest hashes."""
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)), F.lit(False)).alias("good"))
    return judged.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")


def good_share(labels: DataFrame) -> float:
    row = labels.where("doc_id IS NOT NULL").agg(F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double"))).first()
    return 1.0 if row[0] is None else row[0]


def _counts(docs: DataFrame, good: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all texts and of the target's."""
    marks = F.broadcast(good.withColumn("_good", F.lit(True)))  # FIT rows at most
    source = with_bytes(docs.join(marks, "doc_id", "left").withColumn("good", F.coalesce("_good", F.lit(False))), "good")

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        own, found = grams(batch.column("text").to_pylist())
        chosen = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        total[: 2 * BUCKETS] += np.bincount(found, minlength=2 * BUCKETS)
        total[2 * BUCKETS :] += np.bincount(found[chosen[own]], minlength=2 * BUCKETS)

    counts = summed(source, count, 4 * BUCKETS).astype(float)
    return counts[: 2 * BUCKETS], counts[2 * BUCKETS :]


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(target / raw) of every bucket; both are smoothed by the same prior counts, at the target's size."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + prior) / (expected + prior)).astype(np.float32)


def weighted(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight and the row's hash."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own, found = grams(batch.column("text").to_pylist())
            n = np.bincount(own, minlength=batch.num_rows)
            sums = np.bincount(own, sent.value[found], batch.num_rows) / np.sqrt(np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(n, pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "body", "n_grams", "log_weight"])

    source = with_bytes(docs.withColumn("body", F.xxhash64(F.coalesce("text", F.lit("")))), "doc_id", "body")
    return source.mapInArrow(frugal(run), "doc_id long, body long, n_grams long, log_weight double")


def keyed(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with gumbel_key: log_weight and Gumbel noise from a hash of doc_id, body and seed."""
    uniform = ((F.xxhash64("doc_id", "body", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))).cast("double")
    return rows.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a long column (k from 1 to the number of rows): a count for each value of 16 bits, from the highest down."""
    prefix, rest = 0, k
    for shift in (48, 32, 16, 0):
        chunk = F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(-(1 << 63))), shift)
        inside = rows if shift == 48 else rows.where(F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(-(1 << 63))), shift + 16) == prefix)
        counts = sorted(inside.groupBy(chunk.bitwiseAND(F.lit(0xFFFF)).alias("c")).count().collect(), reverse=True)  # 65,536 rows at most
        for value, many in counts:
            if rest <= many:
                prefix = (prefix << 16) | value
                break
            rest -= many
    return prefix - (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw, target = _counts(docs, settle(good_ids(labels)))
    # Keys are ordered to 2**-40; rows that are equal to that are one draw.
    rows = settle(keyed(weighted(docs, log_ratios(raw, target)), seed))
    many = rows.count()
    k = min(many, round(good_share(labels) * many) if k is None else k)
    ordered = rows.withColumn("_order", F.floor(F.col("gumbel_key") * F.lit(float(1 << 40))).cast("long"))
    edge = kth_largest(ordered, "_order", k) if k > 0 else (1 << 63) - 1
    return ordered.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("_order") >= F.lit(edge)).alias("kept"))
