"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from folioflow.operators import state
from folioflow.streaming.limits import cache_hits_stream, rate_limited_stream


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_streams_equal_batch(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events*")
    run(rate_limited_stream(stream, "user_id", "ts", "event_id", 2, 86400.0), "limits")
    got = {tuple(r) for r in spark.sql("select user_id, event_id, allowed from limits").collect()}
    assert got == {tuple(r) for r in state.rate_limited(batch, "user_id", "ts", "event_id", 2, 86400.0).select("user_id", "event_id", "allowed").collect()}
    keyed = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    run(cache_hits_stream(stream.withColumn("key", keyed), "key", "ts", "event_id", 21600.0), "hits")
    got = {tuple(r) for r in spark.sql("select key, event_id, hit from hits").collect()}
    assert got == {tuple(r) for r in state.cache_hits(batch.withColumn("key", keyed), "key", "ts", "event_id", 21600.0).select("key", "event_id", "hit").collect()}


def test_order_and_state_over_micro_batches(spark, tmp_path):
    """Files in any order inside a micro-batch, a few micro-batches: the flags are the batch operator's, and old state goes."""
    rows = [(k, 100 * b + i, 1000.0 * b + (37 * i) % 50) for b in range(4) for i in range(50) for k in ("x", "y") if k == "x" or b % 3 == 0]
    rows += [(f"once{b}", 100 * b, 1000.0 * b) for b in range(4)]
    frame = spark.createDataFrame(rows, "key string, id long, s double").select("key", "id", F.timestamp_seconds(F.col("s") + 1e6).alias("ts"))
    for b in range(4):
        frame.where(F.floor(F.col("id") / 100) == b).repartition(5).write.parquet(str(tmp_path / "in" / f"b={b}"))
    stream = spark.readStream.schema("key string, id long, ts timestamp, b int").option("maxFilesPerTrigger", 5).parquet(str(tmp_path / "in"))
    query = run(rate_limited_stream(stream, "key", "ts", "id", 10, 60.0, late=5000.0), "ordered")
    got = {tuple(r) for r in spark.sql("select key, id, allowed from ordered").collect()}
    assert len(got) == len(rows)
    assert len({i for *_, i in [(p["batchId"],) for p in query.recentProgress]}) > 1
    for key in ("x", "y"):  # a pause of 950 seconds is between the parts, so each part has its own first ten
        assert all(sum(a for k, i, a in got if k == key and i // 100 == b) == 10 for b in range(4) if key == "x" or b % 3 == 0)
    query = run(rate_limited_stream(stream, "key", "ts", "id", 10, 60.0, late=1.0), "expired")
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4  # of six keys
