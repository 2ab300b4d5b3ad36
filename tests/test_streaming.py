from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from seismopair.operators import templates
from seismopair.streaming import scan


def at(second):
    return datetime(2020, 1, 1) + timedelta(seconds=float(second))


def test_stream_tells_what_the_batch_tells(spark, tmp_path):
    rng = np.random.default_rng(2)
    pattern = rng.standard_normal(20)
    data = 0.1 * rng.standard_normal(900)
    data[130:150] += pattern
    data[700:720] += pattern
    rows = [("t", at(i), float(v)) for i, v in enumerate(data)]
    schema = "trace_id string, ts timestamp, value double"
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[300 * k : 300 * k + 300], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("t", at(90_000), 0.0)], schema).coalesce(1).write.mode("append").parquet(source)
    known = spark.createDataFrame([(0, "t", pattern.tolist(), 0.0)], "family_number int, trace_id string, data array<double>, p_offset_s double")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = scan.scan(stream, known, 300.0, 20.0, 1.0, 400.0, 6.0)
    scan.upsert_detections(found, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r.orig_time for r in spark.read.parquet(str(tmp_path / "out")).select("orig_time").collect()}
    batch = spark.createDataFrame(rows, schema)
    want = {r.orig_time for r in templates.scanned(templates.series(batch, 300.0, 20.0, 1.0), known, 1.0, 6.0).collect()}
    assert {at(130), at(700)} <= want and got == want


def test_failure_state(spark, tmp_path):
    schema = "key string, ts timestamp, ok boolean"
    source = str(tmp_path / "in")
    for rows in ([("a", at(0), False), ("b", at(0), False)], [("a", at(10), False), ("b", at(10), True)], [("a", at(20), False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = scan.failure_state(stream, 10.0, 3).writeStream.format("memory").queryName("state").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r.key: r for r in spark.table("state").groupBy("key").agg(F.max_by("retry_count", "retry_count").alias("n"), F.max("skip").alias("skip")).collect()}
    assert last["a"].n == 3 and last["a"].skip and last["b"].n in (0, 1)
