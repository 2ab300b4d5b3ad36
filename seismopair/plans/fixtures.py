"""The event domain's relations, derived by fixed rules from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, unlocated: bool = False) -> DataFrame:
    """Events with places, depths and magnitudes; every 97th without a place, if asked for."""
    n = F.col("event_id")
    place = lambda mul, mod, base: base + ((n * mul) % mod) / F.lit(10000.0)
    lost = (n % 97 == 0) if unlocated else F.lit(False)
    hidden = lambda c: F.when(lost, None).otherwise(c)
    return table(spark, sf_dir, "events").select(
        n, F.concat(F.lit("ev"), F.lpad(n.cast("string"), 7, "0")).alias("evid"), F.col("ts").cast("timestamp").alias("orig_time"),
        hidden(place(7919, 60000, F.lit(12.5))).alias("lat"), hidden(place(10459, 40000, F.lit(-62.5))).alias("lon"), ((n * 31) % 600 / F.lit(10.0)).alias("depth_km"),
        F.lit("Mw").alias("mag_type"), (F.lit(2.0) + F.col("value") / 245.0).alias("mag"), F.concat(F.lit("XX."), F.upper("event_type"), F.lit(".00.BHZ")).alias("trace_id"), "user_id", "event_type", "value",
    )


CATALOG = """cat AS (SELECT event_id, 'ev' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS evid, ts AS orig_time,
  12.5 + ((event_id * 7919) % 60000) / 10000.0::DOUBLE AS lat, -62.5 + ((event_id * 10459) % 40000) / 10000.0::DOUBLE AS lon,
  ((event_id * 31) % 600) / 10.0::DOUBLE AS depth_km, 2.0::DOUBLE + value / 245.0::DOUBLE AS mag, 'XX.' || upper(event_type) || '.00.BHZ' AS trace_id, user_id, event_type, value FROM events)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station for each supplier."""
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("XX.S"), n.cast("string"), F.lit(".00.BHZ")).alias("trace_id"), (F.lit(12.5) + ((n * 7919) % 60000) / F.lit(10000.0)).alias("lat"), (F.lit(-62.5) + ((n * 10459) % 40000) / F.lit(10000.0)).alias("lon"))


STATIONS = """sta AS (SELECT 'XX.S' || s_suppkey || '.00.BHZ' AS trace_id, 12.5 + ((s_suppkey * 7919) % 60000) / 10000.0::DOUBLE AS lat, -62.5 + ((s_suppkey * 10459) % 40000) / 10000.0::DOUBLE AS lon FROM supplier)"""


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace of 64 samples for each vector, on its label's station."""
    n = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("wf"), F.lpad(n.cast("string"), 6, "0")).alias("evid"), F.concat(F.lit("XX.W"), F.col("label").cast("string"), F.lit(".00.BHZ")).alias("trace_id"), n, "label", F.lit(1.0).alias("sampling_rate"), F.col("embedding").cast("array<double>").alias("data"))


WAVEFORMS = """wf AS (SELECT 'wf' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS evid, 'XX.W' || label || '.00.BHZ' AS trace_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS raw, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x - list_avg(CAST(embedding AS DOUBLE[]))) AS d FROM embeddings)"""


def wave_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces' events: times, places and magnitudes by rules of the vector's number."""
    n = F.col("vec_id")
    t0 = 1704067200
    return waveforms(spark, sf_dir).select("evid", "trace_id", n, F.timestamp_seconds(F.lit(t0) + (n * 7919) % 2592000).alias("orig_time"), (F.lit(-62.5) + ((n * 10459) % 400) / F.lit(100.0)).alias("lon"), (F.lit(12.5) + ((n * 7919) % 600) / F.lit(100.0)).alias("lat"), ((n * 31) % 600 / F.lit(10.0)).alias("depth_km"), F.lit("Mw").alias("mag_type"), (F.lit(2.0) + (n % 200) / F.lit(100.0)).alias("mag"))


WAVE_EVENTS = """we AS (SELECT 'wf' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS evid, 'XX.W' || label || '.00.BHZ' AS trace_id, vec_id, 1704067200 + (vec_id * 7919) % 2592000 AS t, -62.5 + ((vec_id * 10459) % 400) / 100.0::DOUBLE AS lon,
  12.5 + ((vec_id * 7919) % 600) / 100.0::DOUBLE AS lat, ((vec_id * 31) % 600) / 10.0::DOUBLE AS depth_km, 2.0 + (vec_id % 200) / 100.0::DOUBLE AS mag FROM embeddings)"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two intervals for each trace of the catalog, of 40 and 100 Hz."""
    first = catalog(spark, sf_dir).groupBy("trace_id").agg(F.min("lat").alias("trace_lat"), F.min("lon").alias("trace_lon"))
    parts = F.array(F.struct(F.lit("2024-01-01").cast("timestamp").alias("f"), F.lit("2024-01-16").cast("timestamp").alias("t"), F.lit(40.0).alias("r")), F.struct(F.lit("2024-01-16").cast("timestamp").alias("f"), F.lit(None).cast("timestamp").alias("t"), F.lit(100.0).alias("r")))
    return first.withColumn("p", F.explode(parts)).select("trace_id", F.col("p.f").alias("valid_from"), F.col("p.t").alias("valid_to"), F.col("p.r").alias("sampling_rate_hz"), "trace_lon", "trace_lat")


METADATA = """md AS (SELECT trace_id, lat AS trace_lat, lon AS trace_lon, f AS valid_from, t AS valid_to, r AS sampling_rate_hz FROM (SELECT trace_id, min(lat) AS lat, min(lon) AS lon FROM cat GROUP BY 1),
  (VALUES (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16', 40.0::DOUBLE), (TIMESTAMP '2024-01-16', NULL, 100.0::DOUBLE)) AS v(f, t, r))"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored windows: a minute or more around each event, per user and trace."""
    c = catalog(spark, sf_dir)
    at = lambda s: F.timestamp_micros(F.unix_micros("orig_time") + s * 1000000)
    return c.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("evid"), "trace_id", at(F.lit(0)).alias("start_ts"), at(60 + F.col("event_id") % 7 * 10).alias("end_ts"))


CACHE = """ca AS (SELECT 'u' || user_id AS evid, trace_id, epoch_us(orig_time) AS s, epoch_us(orig_time) + (60 + event_id % 7 * 10) * 1000000 AS e FROM cat)"""
