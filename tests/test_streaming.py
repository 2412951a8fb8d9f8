from pyspark.sql import functions as F

from tauplane.streaming.scoring import acceptance, scored


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{k:02d}:00", "ab"[k % 2], k / 40) for k in range(40)]
    df = spark.createDataFrame(rows, "t string, cell string, p double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    policy = spark.createDataFrame([("a", 0.2)], "cell string, tau double")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = acceptance(scored(stream, policy, ["cell"]), ["cell"], "t").writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    key = ["start", "cell"]
    want = acceptance(scored(df, policy, ["cell"]), ["cell"], "t").orderBy(*key).collect()
    assert spark.table("seen").orderBy(*key).collect() == want
    assert all(r["accepted_count"] == 0 for r in want if r["cell"] == "b")
