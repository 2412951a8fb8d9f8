"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and U+0009 to U+000D. bytes.split() and bytes.lower() follow exactly these ASCII rules.
SPACE = r"[\x20\x09-\x0D]"

#: Bytes of an Arrow batch that goes to a Python worker, unless one row has more.
BATCH = "4m"

#: Words whose hashes a Python worker remembers before it starts anew.
MEMO_WORDS = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark is one process, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tauplane-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    return settled(df)[0]


def settled(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """settle(df), and what deletes it: only once all that was made of it is written itself."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tauplane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path), lambda: _forget(spark, path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it a job's shuffle files go when the job ends; for jobs whose results are written or collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the cluster's cleaner then takes the folder
        pass


class WordHashes(dict):
    """Word (bytes) -> unsigned 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1), modulo 2**64; read only."""
    own = _powers.get(base)
    if own is None or len(own) < n:
        own = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        own[0] = 1
        own = np.multiply.accumulate(own)
        if len(own) <= 1 << 24:
            _powers[base] = own
    return own[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For each byte, whether it is white space, and a number that stands for it.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class LineOfWords:
    """The words of several texts (A-Z lower-cased), hashed without a loop: .hashes, .text (whose word it is), .counts (words of each text)."""

    def __init__(self, texts: list[bytes], blank: np.ndarray = BLANK):
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        spaces = np.r_[True, blank[self.bytes]]
        self.starts = np.flatnonzero(spaces[:-1] & ~spaces[1:])
        self.ends = np.flatnonzero(~spaces[:-1] & spaces[1:])
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(SYMBOL[self.bytes] * powers(BASE, len(self.bytes)), out=sums[1:])
        self.sums = sums
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * powers(INVERSE, len(sums))[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.text = np.searchsorted(np.cumsum(sizes), self.starts, "right")
        self.counts = np.bincount(self.text, minlength=len(texts))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about most_bytes of the binary column; a longer value makes a piece of its own."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, "right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives its memory back: Spark keeps workers for the tasks to come, also while it needs none.

    The session's Arrow batches are bounded in bytes from here on: 10,000 rows of long texts would be a batch of any size.
    """
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _powers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return all_of


def give_back(spark: SparkSession) -> None:
    """Executors return the heap that they don't use: a JVM keeps what an earlier step has needed, beside the Python workers of the next one."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def with_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """keep..., and the text as UTF-8 bytes (null: empty)."""
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def summed(source: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], length: int, parts: int = 64) -> np.ndarray:
    """The sum over all tasks of a vector of that length, to which count(piece, vector) adds; source has a column text of bytes.

    Tasks send their vectors in parts, which are added up apart: a part's task reads length / parts numbers from each.
    """
    padded = -(-length // parts) * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(padded, np.int64)
        for batch in slices(batches, "text"):
            count(batch, total[:length])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in total.reshape(parts, -1)], pa.binary())], ["part", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": group["part"][:1], "counts": [sum(np.frombuffer(x, np.int64) for x in group["counts"]).tobytes()]})

    out = np.zeros((parts, padded // parts), np.int64)
    for row in source.mapInArrow(frugal(run), "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect():  # one row for each part
        out[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)[:length]
