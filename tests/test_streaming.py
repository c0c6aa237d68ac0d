from datetime import datetime, timedelta

from pulseframe.streaming.flags import flagged


def test_flags_across_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    for i, values in enumerate(([50.0, 0.0, float("nan")], [700.0, 1.0, 1000.0])):
        rows = [("T1", start + timedelta(seconds=3 * i + j), v) for j, v in enumerate(values)]
        spark.createDataFrame(rows, "subject string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("subject string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = flagged(stream).writeStream.format("memory").queryName("flags").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.value, r.reasons) for r in spark.sql("SELECT * FROM flags ORDER BY ts").collect()]
    assert [x for _, x in got] == [[], ["non_positive_le_0"], ["non_finite"], [], ["large_step_ge_500", "sentinel_value_1"], ["high_resistance_ge_1000", "large_step_ge_500"]]
