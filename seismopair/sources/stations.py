"""Station readers."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_trace_id
from .catalogs import guess_fields, sniff

#: The spellings of column names that are accepted for each logical field, and a sampling rate's besides.
GUESSES = {
    "net": ("network", "net", "netw"),
    "sta": ("station", "sta", "stat", "name"),
    "loc": ("location", "loc", "locat"),
    "chan": ("channel", "chan", "ch"),
    "lon": ("longitude", "lon", "long"),
    "lat": ("latitude", "lat"),
    "elevation": ("elevation", "elev", "elevat"),
    "local_depth": ("depth", "dep"),
    "sampling_rate_hz": ("sampling_rate", "samplerate", "sample_rate"),
}


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, lat, lon, elevation, local_depth, sampling_rate_hz; an empty network is @@, missing heights are 0."""
    head = [r[0] for r in spark.read.text(path).limit(5).collect()]  # five lines
    rows = spark.read.options(header=True, sep=sniff(head)).csv(path)
    found = guess_fields(rows.columns, GUESSES)
    col = lambda f: F.trim(F.col(f"`{found[f]}`")) if f in found else F.lit(None).cast("string")
    net = F.when(F.coalesce(col("net"), F.lit("")) == "", "@@").otherwise(col("net"))
    number = lambda f: col(f).try_cast("double")
    return rows.select(clean_trace_id(net, col("sta"), col("loc"), col("chan")).alias("trace_id"), number("lat").alias("lat"), number("lon").alias("lon"), F.coalesce(number("elevation"), F.lit(0.0)).alias("elevation"), F.coalesce(number("local_depth"), F.lit(0.0)).alias("local_depth"), number("sampling_rate_hz").alias("sampling_rate_hz"))


def read_station_xml(spark: SparkSession, path: str) -> DataFrame:
    """The same, with valid_from and valid_to, of StationXML: a row per channel."""
    channel = "struct<_code:string,_locationCode:string,_startDate:string,_endDate:string,Latitude:string,Longitude:string,Elevation:string,Depth:string,SampleRate:string>"
    schema = f"_code string, Station array<struct<_code:string,Channel:array<{channel}>>>"
    rows = spark.read.format("xml").option("rowTag", "Network").schema(schema).load(path)
    rows = rows.select(F.col("_code").alias("net"), F.explode("Station").alias("s")).select("net", F.col("s._code").alias("sta"), F.explode("s.Channel").alias("c"))
    number = lambda f: F.col(f"c.{f}").try_cast("double")
    time = lambda f: F.col(f"c.{f}").try_cast("timestamp")
    return rows.select(clean_trace_id(F.col("net"), F.col("sta"), F.col("c._locationCode"), F.col("c._code")).alias("trace_id"), time("_startDate").alias("valid_from"), time("_endDate").alias("valid_to"), number("Latitude").alias("lat"), number("Longitude").alias("lon"), number("Elevation").alias("elevation"), number("Depth").alias("local_depth"), number("SampleRate").alias("sampling_rate_hz"))


STATION = "trace_id string, valid_from timestamp, valid_to timestamp, lat double, lon double, elevation double, local_depth double, sampling_rate_hz double"


def read_service(spark: SparkSession, url: str, trace_ids: list[str], start: str | None = None, end: str | None = None, timeout: float = 60.0) -> DataFrame:
    """Channels of these traces from a station web service that answers in bar-separated text at channel level: a request for each trace, a task each."""
    from urllib.parse import urlencode
    from urllib.request import urlopen

    asked = []
    for t in trace_ids:
        net, sta, loc, chan = t.split(".")
        terms = {"level": "channel", "format": "text", "network": net, "station": sta, "location": loc or "--", "channel": chan or "*", **({"starttime": start} if start else {}), **({"endtime": end} if end else {})}
        asked.append((f"{url}?{urlencode(terms)}",))

    def run(batches):
        for batch in batches:
            lines = []
            for one in batch.column("url").to_pylist():
                with urlopen(one, timeout=timeout) as answer:
                    lines += [x for x in answer.read().decode("utf-8", "replace").splitlines() if x.strip() and not x.startswith("#")]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    rows = spark.createDataFrame(asked, "url string").repartition(max(1, len(asked))).mapInArrow(run, "value string")
    at = lambda i: F.trim(F.get(F.split("value", r"\|"), F.lit(i)))
    number = lambda i: at(i).try_cast("double")
    return rows.select(clean_trace_id(at(0), at(1), at(2), at(3)).alias("trace_id"), at(15).try_cast("timestamp").alias("valid_from"), at(16).try_cast("timestamp").alias("valid_to"), number(4).alias("lat"), number(5).alias("lon"), number(6).alias("elevation"), number(7).alias("local_depth"), number(14).alias("sampling_rate_hz"))


def first_source(*sources: Callable[[], DataFrame | None]) -> DataFrame:
    """The stations of the first source that has any: a file, the stored metadata, then a web service, as functions, so that a later one isn't asked without need."""
    for source in sources:
        found = source()
        if found is not None and not found.isEmpty():
            return found
    raise LookupError("no source has stations")
