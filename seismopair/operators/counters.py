"""Counters of a scan: merging, rates, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(n: Column, of: Column) -> Column:
    """n over `of`; 0 where that is 0 or null."""
    return F.coalesce(F.try_divide(n, F.when(of != 0, of)), F.lit(0.0))


def merged(workers: DataFrame) -> DataFrame:
    """One row of the workers' counters (fetched, fetch_s, correlated, correlate_s, hits, misses): sums, mean seconds of either step, share of hits."""
    total = workers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fetched", "fetch_s", "correlated", "correlate_s", "hits", "misses")))
    return total.withColumns({"mean_fetch_s": rate(F.col("fetch_s"), F.col("fetched")), "mean_correlate_s": rate(F.col("correlate_s"), F.col("correlated")), "hit_rate": rate(F.col("hits"), F.col("hits") + F.col("misses"))})


def snapshots(progress: DataFrame, every_s: float = 600.0) -> DataFrame:
    """window, done and pairs_per_s of each stretch of `every_s` seconds, from rows (ts, done) of a running total: the growth since the stretch before over the time since its last row."""
    last = progress.groupBy(F.window("ts", f"{int(every_s)} seconds").alias("window")).agg(F.max_by("done", "ts").alias("total"), F.max("ts").alias("ts"))
    w = Window.orderBy("window.start")  # a row for each stretch
    before = F.coalesce(F.lag("total").over(w), F.lit(0))
    seconds = (F.unix_micros("ts") - F.unix_micros(F.coalesce(F.lag("ts").over(w), F.col("window.start")))) / 1e6
    return last.select("window", (F.col("total") - before).alias("done"), rate(F.col("total") - before, seconds).alias("pairs_per_s"))
