"""The numbers behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import signal
from . import families

CUMULATIVE = {"slip": "cumul_slip_cm", "moment": "cumul_moment", "number": "cumul_number"}
#: What families can be coloured by.
COLOURS = ("time", "latitude", "longitude", "depth", "family_number", "number_of_events", "duration", "slip_rate", "cumul_slip", "cumul_moment", "mag_max")
_COLUMN = {"time": "start_time", "latitude": "lat", "longitude": "lon", "depth": "depth_km", "number_of_events": "n", "duration": "duration_years", "slip_rate": "slip_rate_cm_y", "cumul_slip": "cumul_slip_cm"}


def cumulative(members: DataFrame, quantity: str = "slip", cfg: Config | None = None) -> DataFrame:
    """family_number, orig_time, value: the steps of each family's running sum."""
    rows = families.cumulative(members, cfg)
    return rows.select("family_number", "evid", "orig_time", F.col(CUMULATIVE[quantity]).cast("double").alias("value"))


def limits(steps: DataFrame, logarithmic: bool = False) -> DataFrame:
    """One row: x_min, x_max (microseconds) and y_min, y_max, 5 % wider than the data; a logarithmic axis spans a tenth to ten times."""
    x = F.unix_micros("orig_time")
    found = steps.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min("value").alias("c"), F.max("value").alias("d"))
    pad, high = 0.05 * (F.col("b") - F.col("a")), 0.05 * (F.col("d") - F.col("c"))
    y = (F.col("c") / 10, F.col("d") * 10) if logarithmic else (F.col("c") - high, F.col("d") + high)
    return found.select((F.col("a") - pad).alias("x_min"), (F.col("b") + pad).alias("x_max"), y[0].alias("y_min"), y[1].alias("y_max"))


def timespans(members: DataFrame, summaries: DataFrame, sort_by: str = "depth", origin: tuple[float, float] | None = None) -> DataFrame:
    """family_number, orig_time, y: a row for each event, at its family's height."""
    from ..functions import geo

    heights: dict[str, Column] = {"depth": F.col("depth_km"), "family_number": F.col("family_number").cast("double"), "latitude": F.col("lat"), "longitude": F.col("lon"), "time": F.unix_micros("start_time") / 1e6}
    if sort_by == "distance_from":
        if origin is None:
            raise ValueError("distance_from needs an origin")
        heights[sort_by] = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(float(origin[1])), F.lit(float(origin[0])))
    y = summaries.select("family_number", heights[sort_by].alias("y"))
    return members.select("family_number", "evid", "orig_time").join(y, "family_number")


def colours(summaries: DataFrame, by: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """summaries with shade and shade_class; an endless value has no shade."""
    if by not in COLOURS:
        raise ValueError(f"by is one of {COLOURS}")
    c = F.col(_COLUMN.get(by, by))
    value = F.unix_micros(c).cast("double") if by == "time" else c.cast("double")
    rows = summaries.withColumn("_shown", F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value))
    return families.colour_scale(rows, "_shown", low, high).withColumn("shade", F.when(F.col("_shown").isNotNull(), F.col("shade"))).drop("_shown")


def duration_colours(summaries: DataFrame) -> DataFrame:
    """summaries with `duration` in the unit that suits the mean duration, `unit`, and the shade of that value."""
    unit = families.duration_unit(F.col("_mean"))
    rows = summaries.crossJoin(F.broadcast(summaries.agg(F.avg("duration_years").alias("_mean"))))  # one row
    days = F.col("duration_years") * 365
    value = F.when(F.col("unit") == "years", days / 365).when(F.col("unit") == "months", days / 30).when(F.col("unit") == "days", days).when(F.col("unit") == "hours", days * 24).otherwise(days * 1440)
    told = rows.withColumn("unit", unit).withColumn("duration", value).drop("_mean")
    return families.colour_scale(told, "duration")


def first_families(members: DataFrame, most: int = 20) -> DataFrame:
    """Members of the `most` families of smallest number: as many as a figure of traces shows."""
    shown = members.select("family_number").distinct().orderBy("family_number").limit(most)
    return members.join(F.broadcast(shown), "family_number", "left_semi")


def boundaries(summaries: DataFrame) -> DataFrame:
    """bounds: whole numbers of events from the least to beyond the most, an odd count of them."""
    a, b = F.min("n"), F.max("n") + 1
    return summaries.agg(F.sequence(a, F.when((b - a) % 2 == 0, b).otherwise(b + 1)).alias("bounds"))


def map_points(summaries: DataFrame) -> DataFrame:
    return summaries.select("family_number", "lon", "lat", F.concat(F.lit("family "), F.col("family_number").cast("string")).alias("label"))


def zoom(summaries: DataFrame) -> DataFrame:
    """zoom: 12 if the families' box is up to 100 km across, else 8."""
    from ..functions import geo

    d = geo.haversine_km(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon"))
    return summaries.agg(F.when(d <= 100, 12).otherwise(8).alias("zoom"))


def family_traces(aligned: DataFrame) -> DataFrame:
    """Aligned traces of equal peaks, numbered from the top in evid order."""
    w = Window.partitionBy("family_number").orderBy("evid")
    return aligned.select("family_number", "evid", F.row_number().over(w).alias("line"), signal.peak_normalised(F.col("data")).alias("data"), "cc_mean")


def pair_traces(rows: DataFrame) -> DataFrame:
    """Both traces of correlated pairs (data1, data2, lag_samples), the second moved to fit, of equal peaks."""
    return rows.select("evid1", "evid2", "trace_id", signal.peak_normalised(F.col("data1")).alias("data1"), signal.peak_normalised(signal.shifted(F.col("data2"), F.coalesce("lag_samples", F.lit(0)))).alias("data2"))
