"""Operators on event catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Interval
from ..shared import small, stage


def in_range(value: Column, low, high) -> Column:
    """Within bounds, both included; a null value passes, and so does a null bound."""
    ok = F.lit(True)
    if low is not None:
        ok &= value >= F.lit(low)
    if high is not None:
        ok &= value <= F.lit(high)
    return value.isNull() | ok


def range_filter(catalog: DataFrame, cfg: Config) -> DataFrame:
    """Events within the bounds on place, depth and magnitude, and within any of the intervals."""
    kept = catalog.where(in_range(F.col("lat"), cfg.lat_min, cfg.lat_max) & in_range(F.col("lon"), cfg.lon_min, cfg.lon_max) & in_range(F.col("depth_km"), cfg.depth_min, cfg.depth_max) & in_range(F.col("mag"), cfg.mag_min, cfg.mag_max))
    return in_intervals(kept, cfg.intervals) if cfg.intervals else kept


def in_intervals(catalog: DataFrame, intervals: tuple[Interval, ...]) -> DataFrame:
    """Events within any of the intervals."""
    bound = lambda t: None if t is None else F.lit(t).cast("timestamp")
    tests = [in_range(F.col("orig_time"), bound(i.start), bound(i.end)) for i in intervals]
    return catalog.where(reduce(lambda x, y: x | y, tests))


def time_sorted(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("orig_time", "evid")


def with_ordinal(rows: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Adds a dense number, from 0 in the order of these columns (of a catalog: its time).

    Rows are numbered inside range partitions, and each partition's start is added, so that no task has to hold all.
    """
    order = order or ("orig_time", "evid")
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = parts.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    parts = stage(parts, "ordinals")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each partition
    return parts.join(small(starts), "_part").withColumn(name, (F.col("_at") + F.col("_start")).cast("bigint")).drop("_part", "_at", "_start")


def deduplicated(catalog: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return catalog.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored events and those new ones whose evid isn't stored; of repeated new ones the first by time."""
    both = stored.withColumn("_source", F.lit(0)).unionByName(new.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    return deduplicated(both, ["evid"], [F.col("_source"), F.col("orig_time"), F.col("trace_id")]).drop("_source")


def located(catalog: DataFrame, stations: DataFrame, depth_km: float = 10.0) -> DataFrame:
    """Events without latitude or longitude get the stations' mean place and a depth of `depth_km`."""
    mean = stations.agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"))  # one row
    lost = F.col("lat").isNull() | F.col("lon").isNull()
    joined = catalog.crossJoin(F.broadcast(mean))
    return joined.withColumns({"depth_km": F.when(lost, depth_km).otherwise(F.col("depth_km")), "lat": F.when(lost, F.col("_lat")).otherwise(F.col("lat")), "lon": F.when(lost, F.col("_lon")).otherwise(F.col("lon"))}).drop("_lat", "_lon")


def runs(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Runs of equal neighbours: key, run (from 1), value, n, and the offset of the run's first row."""
    seq = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(seq)) | F.lag(F.lit(1)).over(seq).isNull()).cast("int"))
    numbered = marked.withColumn("run", F.sum("_new").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    groups = numbered.groupBy(key, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
