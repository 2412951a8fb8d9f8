"""Every stage of the corpus pipeline over nulls, repeats, ties, empty tables, long texts and clashing names; and the whole pipeline."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
CLASHES = ("score", "share", "lang_pred", "_row", "body", "row", "cid", "key", "h", "members", "n_lines", "n_dropped", "template", "first", "ids", "with.dot")
STAGES = dict(pipeline.STAGES)


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijkl") for _ in range(draw.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = words(1, 30_000)
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, words(4, 40), "en"), (4, words(4, 40), "en"), (None, words(6, 50), "en"), (None, None, None), (7, long, "en"), (8, words(8, 3), "en"), (9, "12 34", "en")]
    df = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_stage_returns_the_columns_of_documents(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    given = Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert not kept - given
    gone = {"language ID": {(1, None), (2, ""), (3, " \n\t"), (None, None), (9, "12 34")}, "line dedup": {(1, None), (2, ""), (3, " \n\t"), (None, None)}}
    want = Counter({k: v for k, v in given.items() if k not in gone.get(name, set())})
    if name == "n-gram Jaccard join":
        want[4, words(4, 40)] = 1  # of the rows that are equal, one
    assert kept == want


@pytest.mark.parametrize("name", STAGES)
def test_stage_of_an_empty_table(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stage_begins_with_heap_given_back(spark, name):
    """Else an executor's JVM keeps the heap of all stages before, and their workers find no room beside it."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(x.getCollectionCount() for x in beans if "Young" not in x.getName() and "Copy" not in x.getName())
    before = full()
    STAGES[name](spark, spark.createDataFrame([], SCHEMA), SF)
    assert full() > before


def test_encoding(spark, odd):
    from tiktoken.load import load_tiktoken_bpe

    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in pipeline.encode(spark, odd, SF).collect())
    want = Counter((r["doc_id"], len(x := codec.encode_ordinary(r["text"] or "")), tuple(x)) for r in odd.collect())
    assert got == want


def test_near_copies_go_by_doc_id_and_text(spark):
    a, unrelated = words(20, 200), words(21, 80)
    near = a.replace(" ", "  ", 3) + " tail"
    rows = [(3, a), (5, near), (5, unrelated), (None, near + " more"), (None, words(22, 30)), (9, unrelated), (2, words(23, 4)), (2, words(24, 4)), (6, ""), (6, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = Counter((r["doc_id"], r["text"]) for r in pipeline.keep_one_of_near_copies(spark, df, SF).collect())
    assert kept == Counter(rows) - Counter([(5, near), (None, near + " more"), (9, unrelated)])


def test_one_row_of_a_component_stays_if_its_doc_id_is_repeated(spark):
    a = words(30, 150)
    df = spark.createDataFrame([(1, a + " x", "en", "s", 0), (1, a + " y", "en", "s", 0), (2, a, "en", "s", 0)], SCHEMA)
    assert [r["doc_id"] for r in pipeline.keep_one_of_near_copies(spark, df, SF).collect()] == [1]


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = {r["doc_id"] for r in pipeline.run(spark, SF).select("doc_id").collect()}
    leaks = {d["doc_id"] for d in docs.collect() if any(t in (d["text"] or "") for t in items)}
    blank = {d["doc_id"] for d in docs.collect() if not (d["text"] or "").strip()}
    assert out and leaks and not out & leaks and not out & blank and out <= {d["doc_id"] for d in docs.collect()}
