"""Operators on event families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, duration_seconds
from ..functions import geo, slip, units
from .catalog import with_ordinal

_YEAR_S = 365 * 86400.0


def numbered(members: DataFrame, key: str = "time", origin: tuple[float, float] | None = None) -> DataFrame:
    """Adds family_number to members (cluster, evid, ...): the rank from 0 of the family by its first time, mean place, or distance from `origin` (lon, lat).

    Ties go by the smallest evid.
    """
    sorts: dict[str, Column] = {"time": F.min("orig_time"), "longitude": F.avg("lon"), "latitude": F.avg("lat"), "depth": F.avg("depth_km")}
    if key == "distance_from":
        if origin is None:
            raise ValueError("distance_from needs an origin")
        sorts[key] = geo.haversine_km(F.avg("lat"), F.avg("lon"), F.lit(float(origin[1])), F.lit(float(origin[0])))
    heads = members.groupBy("cluster").agg(sorts[key].alias("_key"), F.min("evid").alias("_tie"))
    ranked = with_ordinal(heads, "_key", "_tie").select("cluster", F.col("ordinal").cast("int").alias("family_number"))
    return members.join(ranked, "cluster")


def summary(members: DataFrame, cfg: Config | None = None, one_trace: bool = False) -> DataFrame:
    """One row per family: n, mean place, first and last time, duration in years, magnitudes, sums of slip and moment, slip rate.

    The first event's slip is outside the rate, which is null for a duration of 0. A family is valid if its last member is. With `one_trace`
    a family on more than one trace is an error; else the column one_trace tells.
    """
    rows = members.withColumns({"_slip": slip.slip_cm(F.col("mag"), cfg), "_moment": slip.moment(F.col("mag"))})
    first = F.struct("orig_time", "evid")
    found = rows.groupBy("family_number").agg(
        F.count(F.lit(1)).alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.avg("depth_km").alias("depth_km"),
        F.min("orig_time").alias("start_time"), F.max("orig_time").alias("end_time"), F.min("mag").alias("mag_min"), F.max("mag").alias("mag_max"),
        F.sum("_slip").alias("cumul_slip_cm"), F.sum("_moment").alias("cumul_moment"), F.min_by("_slip", first).alias("_first"), F.min("trace_id").alias("trace_id"), F.max("trace_id").alias("_other"), F.max_by("valid", first).alias("valid"),
    )
    years = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6 / _YEAR_S
    found = found.withColumn("duration_years", years)
    rate = F.try_divide(F.col("cumul_slip_cm") - F.col("_first"), F.when(F.col("duration_years") > 0, F.col("duration_years")))
    mixed = F.raise_error(F.concat(F.lit("family "), F.col("family_number").cast("string"), F.lit(" has more than one trace: "), F.col("trace_id"), F.lit(" and "), F.col("_other")))
    if one_trace:
        found = found.withColumn("trace_id", F.when(F.coalesce(F.col("trace_id") != F.col("_other"), F.lit(False)), mixed).otherwise(F.col("trace_id")))
    return found.withColumn("slip_rate_cm_y", rate).withColumn("one_trace", F.col("trace_id") == F.col("_other")).drop("_first", "_other")


def distance_stats(members: DataFrame) -> DataFrame:
    """Least and largest horizontal and vertical distance of each family's events from its mean place."""
    w = Window.partitionBy("family_number")
    rows = members.select("family_number", "lat", "lon", "depth_km", *(F.avg(c).over(w).alias(f"_{c}") for c in ("lat", "lon", "depth_km")))
    rows = rows.withColumns({"_h": geo.haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), "_v": F.abs(F.col("depth_km") - F.col("_depth_km"))})
    return rows.groupBy("family_number").agg(F.min("_h").alias("hdist_min"), F.max("_h").alias("hdist_max"), F.min("_v").alias("vdist_min"), F.max("_v").alias("vdist_max"))


def global_stats(summaries: DataFrame) -> DataFrame:
    """One row over all families: their number, and sum, least, median, mean and largest of size and duration, and extreme magnitudes; also the largest distances, if `summaries` have hdist_max and vdist_max."""
    days = F.col("duration_years") * 365
    return summaries.agg(
        *([F.max(c).alias(c) for c in ("hdist_max", "vdist_max") if c in summaries.columns]), F.count(F.lit(1)).alias("families"), F.sum("n").alias("events"), F.min("n").alias("n_min"), F.median("n").alias("n_median"), F.avg("n").alias("n_mean"), F.max("n").alias("n_max"),
        F.min(days).alias("days_min"), F.median(days).alias("days_median"), F.avg(days).alias("days_mean"), F.max(days).alias("days_max"), F.min("mag_min").alias("mag_min"), F.max("mag_max").alias("mag_max"),
    )


def duration_unit(mean_years: Column) -> Column:
    """The unit for durations of this mean."""
    days = mean_years * 365
    return F.when(days >= 365, "years").when(days >= 30, "months").when(days >= 1, "days").when(days * 24 >= 1, "hours").otherwise("mins")


def numbers(expression: str) -> list[int] | None:
    """Family numbers of an expression: all (None), a list 1,4,6, a range 2-5 without its end, or one number."""
    text = expression.strip()
    if text == "all":
        return None
    try:
        if "," in text:
            return [int(x) for x in text.split(",")]
        if "-" in text:
            low, high = text.split("-")
            return list(range(int(low), int(high)))
        return [int(text)]
    except ValueError as e:
        raise ValueError(f"no family numbers: {expression!r}") from e


def selected(summaries: DataFrame, expression: str = "all", cfg: Config | None = None) -> DataFrame:
    """Valid families among the numbers, with enough events, at least `longerthan` and less than `shorterthan` long."""
    cfg = cfg or Config()
    wanted = numbers(expression)
    kept = summaries if wanted is None else summaries.where(F.col("family_number").isin(wanted))
    seconds = F.col("duration_years") * _YEAR_S
    kept = kept.where(F.col("valid") & (F.col("n") >= cfg.minevents))
    if cfg.longerthan is not None:
        kept = kept.where(seconds >= duration_seconds(cfg.longerthan))
    if cfg.shorterthan is not None:
        kept = kept.where(seconds < duration_seconds(cfg.shorterthan))
    return kept


def one(summaries: DataFrame, number: int) -> DataFrame:
    """A family that has to be there and valid."""
    found = summaries.where(F.col("family_number") == number)
    row = found.select("valid").first()
    if row is None:
        raise LookupError(f"no family {number}")
    if not row[0]:
        raise LookupError(f"family {number} is flagged as not valid")
    return found


_TRUTH = {"true": True, "t": True, "1": True, "false": False, "f": False, "0": False}


def flagged(members: DataFrame, number: int, valid: bool | str) -> DataFrame:
    """Members with the family's valid flag set; an unknown family changes nothing."""
    if isinstance(valid, str):
        if valid.lower() not in _TRUTH:
            raise ValueError(f"true or false, not {valid!r}")
        valid = _TRUTH[valid.lower()]
    return members.withColumn("valid", F.when(F.col("family_number") == number, F.lit(valid)).otherwise(F.col("valid")))


def cumulative(members: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Adds running sums of slip and moment and the running number of events, in each family's time order."""
    w = Window.partitionBy("family_number").orderBy("orig_time", "evid").rowsBetween(Window.unboundedPreceding, 0)
    return members.withColumns({"cumul_slip_cm": F.sum(slip.slip_cm(F.col("mag"), cfg)).over(w), "cumul_moment": F.sum(slip.moment(F.col("mag"))).over(w), "cumul_number": F.row_number().over(Window.partitionBy("family_number").orderBy("orig_time", "evid"))})


def details(members: DataFrame) -> DataFrame:
    """family_number and its members in time order, as an array; families are small, a row holds one."""
    row = F.struct("orig_time", "evid", "trace_id", "lon", "lat", "depth_km", "mag_type", "mag")
    return members.groupBy("family_number").agg(F.sort_array(F.collect_list(row)).alias("members"))


def colour_scale(values: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds shade, `column` from 0 to 1 between its bounds (or those given), and shade_class, the family number modulo 10."""
    bounds = values.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))  # one row
    rows = values.crossJoin(F.broadcast(bounds))
    a, b = F.coalesce(F.lit(low).cast("double"), F.col("_low")), F.coalesce(F.lit(high).cast("double"), F.col("_high"))
    shade = F.when(b > a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - a) / (b - a)))).otherwise(F.lit(0.0))
    return rows.withColumns({"shade": shade, "shade_class": F.pmod("family_number", F.lit(10)).cast("int")}).drop("_low", "_high")


def table(summaries: DataFrame, stats: DataFrame) -> DataFrame:
    """The columns of the printed family list."""
    return summaries.join(stats, "family_number").withColumn("duration", units.duration_text(F.col("duration_years"))).orderBy("family_number")
