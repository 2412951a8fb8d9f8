"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.

Defined results: rows with a null text are rejected by the first stage; a row
with a null doc_id keeps all its lines in line dedup, and counts as greater than
any other in the join. Of rows that have doc_id and text in common the join
keeps one; rows that share a doc_id alone are apart. Other columns pass through.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauplane.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from tauplane.llm.common import documents, give_back, settle, table

#: A document's language must hold this share of its letters.
SHARE = 0.5
#: Rows that a join broadcasts at most (16 bytes each).
BROADCAST = 100_000


def _packed(docs: DataFrame, *keep: str) -> DataFrame:
    """keep..., text, and the other columns as one, so that no name of theirs clashes with an operator's."""
    return docs.select(*keep, "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))


def _unpacked(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of docs, with that text."""
    return [text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, and with a language that holds SHARE of them."""
    model = language_id.fit(docs.select("text", "lang"))
    found = language_id.predict(_packed(docs), model, "_row", "text").where((F.col("lang_pred") != "und") & (F.col("share") >= SHARE))
    return found.select(*_unpacked(docs, F.col("text").cast("string")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs; those of which nothing is left go."""
    kept = line_dedup.clean_lines(_packed(docs, "doc_id"), long_repeats=line_dedup.LONG_REPEATS).where("n_lines > n_dropped")
    out = kept.select(*_unpacked(docs, F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of every group of linked documents: the one of the smallest doc_id, of rows that share it that of the smallest hash of the text.

    Rows are known by doc_id and text. Of rows that have both in common, any one stays.
    """
    rows = ngram_join.near_rows(docs)
    keys = rows.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("body").alias("_body"))
    first = F.first((F.col("component_id").eqNullSafe(F.col("doc_id"))) & (F.col("first_body") == F.col("body"))).alias("_first")
    known = settle(keys.agg(first, F.count("*").alias("_rows")).where("NOT _first OR _rows > 1"))
    known = known.hint("broadcast") if known.count() <= BROADCAST else known
    same = F.expr("CAST(d.doc_id AS BIGINT) <=> k._id AND xxhash64(coalesce(d.text, '')) = k._body")
    marked = docs.alias("d").join(known.alias("k"), same, "left").where("coalesce(k._first, true)")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    return marked.where("k._rows IS NULL").select(columns).unionByName(marked.where("k._rows IS NOT NULL").select(columns).dropDuplicates(["doc_id", "text"]))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the decoded bytes."""
    encoded = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, before which executors give back what those before it have left."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", _apart(identify_language)),
    ("line dedup", _apart(drop_repeated_lines)),
    ("n-gram Jaccard join", _apart(keep_one_of_near_copies)),
    ("benchmark decontamination", _apart(decontaminate_documents)),
    ("byte-level BPE encoding and decoding", _apart(encode)),
]

#: SQL can't express language ID, line dedup or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
