import datetime

from pyspark.sql import functions as F

from cairnworks.streaming import velocity
from tests.conftest import SMALL


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    day = events.withColumn("d", F.dayofmonth("ts"))
    for k in range(1, 31, 10):  # files arrive in the order of time; the first one twice
        day.filter(F.col("d").between(k, k + 9)).drop("d").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events.filter(F.dayofmonth("ts") <= 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # One event far ahead moves the watermark past every window of the others.
    late = events.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.lit(datetime.datetime(2024, 12, 1)).cast("timestamp_ntz"), "user_id": F.lit(-1).cast("long")})
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = velocity.velocity(velocity.deduplicated(velocity.event_stream(spark, str(tmp_path / "in"), 1), "40 days"))
    run = stream.writeStream.outputMode("append").format("memory").queryName("velocity").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("velocity").collect())
    want = sorted(tuple(r) for r in velocity.velocity(events.withColumn("at", F.col("ts").cast("timestamp"))).collect())
    assert len(want) > 100 and got == want
