"""Operators on time-valid trace metadata: half-open intervals per trace, an open end as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import floats_differ


def overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Two half-open intervals have a point in common."""
    return (end1.isNull() | (end1 > start2)) & (end2.isNull() | (end2 > start1))


def overlapping(metadata: DataFrame) -> DataFrame:
    """trace_id, valid_from, next_from of intervals that reach past the start of a later one of the trace."""
    w = Window.partitionBy("trace_id").orderBy("valid_from")
    ends = metadata.withColumns({"next_from": F.lead("valid_from").over(w)})
    return ends.where(F.col("next_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("next_from")))).select("trace_id", "valid_from", "next_from")


FIELDS = (("sampling_rate_hz", 1e-6, 1e-9), ("trace_lon", 0.0, 1e-6), ("trace_lat", 0.0, 1e-6), ("elevation", 0.0, 1e-6), ("local_depth", 0.0, 1e-6))


def drift(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose interval's start is stored with other values."""
    old = stored.select("trace_id", "valid_from", *(F.col(n).alias(f"_{n}") for n, *_ in FIELDS))
    differs = F.lit(False)
    for name, rel, absolute in FIELDS:
        differs |= floats_differ(F.col(f"_{name}"), F.col(name), rel, absolute)
    return new.join(old, ["trace_id", "valid_from"]).where(differs).select(*new.columns)


def inserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows and new ones with another start; an interval that overlaps another is an error."""
    both = stored.unionByName(new.join(stored.select("trace_id", "valid_from"), ["trace_id", "valid_from"], "left_anti"))
    clash = overlapping(both).first()
    if clash is not None:
        raise ValueError(f"intervals of {clash['trace_id']} overlap at {clash['next_from']}")
    return both


def from_channels(channels: DataFrame) -> DataFrame:
    """Metadata rows of station channels; those without a sampling rate are left out, a missing start is 1900."""
    kept = channels.where(F.col("sampling_rate_hz").isNotNull())
    return kept.withColumn("valid_from", F.coalesce("valid_from", F.lit("1900-01-01").cast("timestamp")))


def fallback(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """An unbounded row for each trace that has none, with the rate of its first pair that has one."""
    missing = pairs.join(stored.select("trace_id").distinct(), "trace_id", "left_anti").where(F.col("sampling_rate_hz").isNotNull())
    rates = missing.groupBy("trace_id").agg(F.min_by("sampling_rate_hz", F.struct("evid1", "evid2")).alias("sampling_rate_hz"))
    return rates.withColumns({"valid_from": F.lit("1900-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})


def at_time(rows: DataFrame, metadata: DataFrame, time: str = "orig_time") -> DataFrame:
    """Coordinates valid at each row's time: those of its trace, or else of the same station with a blank channel."""
    m = metadata.select(F.col("trace_id").alias("_id"), "valid_from", "valid_to", "trace_lon", "trace_lat")
    bare = F.regexp_replace("trace_id", r"[^.]*$", "")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    tries = rows.withColumn("_try", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("trace_id").alias("id")), F.struct(F.lit(1).alias("k"), bare.alias("id")))))
    covers = (F.col("_try.id") == F.col("_id")) & (F.col("valid_from") <= F.col(time)) & (F.col("valid_to").isNull() | (F.col(time) < F.col("valid_to")))
    w = Window.partitionBy("_row").orderBy(F.col("_id").isNull(), F.col("_try.k"))
    return tries.join(m, covers, "left").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_row", "_try", "_id", "valid_from", "valid_to")


def with_configured(stored: DataFrame, channels: DataFrame, trace_ids: list[str]) -> DataFrame:
    """Metadata with rows for the configured traces too, whether or not a pair on them ever succeeds: those of the inventory's channels that aren't stored."""
    return inserted(stored, from_channels(channels).where(F.col("trace_id").isin(trace_ids)).select(*stored.columns))
