import math

from pyspark.sql import functions as F

from lexweave.streaming import rate


def brute(rows, limit, window):
    out, state = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start, used = state.get(k, (None, 0))
        if start is None or t >= start + window:
            start, used = t, 0
        ok = used < limit
        state[k] = (start, used + ok)
        out[i] = (ok, 0 if ok else max(1, math.ceil(start + window - t)))
    return out


def rows():
    return [(f"u{i % 3}", i, float((i * 37) % 400)) for i in range(120)] + [("u0", 500, 5.0), ("u0", 501, 5.0)]


def test_batch_windows_are_anchored(spark):
    df = spark.createDataFrame(rows() + [(None, 1, 1.0)], "k string, i bigint, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")))
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in rate.rate_limit(df, 3, 60.0, "k", "i", "ts").collect()}
    assert got == brute(rows(), 3, 60.0)


def test_stream_agrees_with_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows(), "k string, i bigint, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")))
    df.coalesce(1).write.parquet(src)
    stream = rate.rate_limit_stream(spark.readStream.schema(df.schema).parquet(src), 3, 60.0, "k", "i", "ts")
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in spark.sql("select * from limited").collect()}
    assert got == brute(rows(), 3, 60.0)


def test_ingest_drops_invalid_and_repeated(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:01:00", 1.0), (2, "2024-01-01 00:02:00", -1.0), (3, None, 1.0)], "id int, ts string, v double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.coalesce(1).write.parquet(src)
    s = rate.ingest_stream(spark.readStream.schema(df.schema).parquet(src), "id", "ts", F.col("v") > 0)
    q = s.writeStream.format("memory").queryName("ingested").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["id"] for r in spark.sql("select * from ingested").collect()} - {3} == {1}


def test_sessions(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1000), ("a", 9000), ("b", 5)], "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r["key"], r["n"]) for r in rate.session_counts(df, "k", "ts").collect()) == [("a", 1), ("a", 2), ("b", 1)]
