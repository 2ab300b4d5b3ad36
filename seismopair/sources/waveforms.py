"""Stored waveforms: windows, merged segments, and the order of sources."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlencode
from urllib.request import urlopen

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import cache_name
from ..functions.signal import cut
from . import mseed, sac


def trimmed(waveforms: DataFrame, start: str = "req_start", end: str = "req_end") -> DataFrame:
    """Traces cut to a window, its end sample included; start_ts follows."""
    us = F.unix_micros("start_ts")
    step = F.lit(1e6) / F.col("sampling_rate")
    first = F.ceil((F.unix_micros(start) - us) / step - 1e-6).cast("int")
    last = F.floor((F.unix_micros(end) - us) / step + 1e-6).cast("int")
    begin = F.timestamp_micros((us + F.greatest(first, F.lit(0)) * step).cast("bigint"))
    return waveforms.withColumn("data", cut(F.col("data"), first, last)).withColumn("start_ts", begin).withColumn("npts", F.size("data"))


def merged(segments: DataFrame) -> DataFrame:
    """One trace for each evid and trace_id: segments of one rate on a regular grid, gaps filled on a straight line, of overlaps the later segment."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["us"])
        rate = rows[0]["sampling_rate"]
        start = rows[0]["us"]
        known: dict[int, float] = {}
        for r in rows:
            at = round((r["us"] - start) * rate / 1e6)
            known |= dict(enumerate(r["data"], at))
        n = max(known, default=-1) + 1
        at = np.array(sorted(known))
        data = np.interp(np.arange(n), at, [known[i] for i in at.tolist()]) if n else np.zeros(0)
        return pa.table({"evid": [rows[0]["evid"]], "trace_id": [rows[0]["trace_id"]], "us": [start], "sampling_rate": [rate], "data": pa.array([data.tolist()], pa.list_(pa.float64()))})

    rows = segments.where(F.size("data") > 0).select("evid", "trace_id", F.unix_micros("start_ts").alias("us"), "sampling_rate", F.col("data").cast("array<double>").alias("data"))
    out = rows.groupBy("evid", "trace_id").applyInArrow(run, "evid string, trace_id string, us bigint, sampling_rate double, data array<double>")
    return out.withColumn("start_ts", F.timestamp_micros("us")).withColumn("npts", F.size("data")).drop("us")


def first_available(requests: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Requests (evid, trace_id) with data and source of the first source that has them; status no_waveform if none has."""
    rows = requests
    for name, source in sources:
        own = source.select("evid", "trace_id", F.col("data").alias(f"_{name}")).dropDuplicates(["evid", "trace_id"])
        rows = rows.join(own, ["evid", "trace_id"], "left")
    columns = [F.col(f"_{name}") for name, _ in sources]
    which = F.coalesce(*(F.when(F.col(f"_{name}").isNotNull(), name) for name, _ in sources))
    return rows.withColumns({"data": F.coalesce(*columns), "source": which}).withColumn("status", F.when(F.col("source").isNull(), "no_waveform").otherwise("ok")).drop(*(f"_{name}" for name, _ in sources))


def decoded(content: bytes) -> list[dict]:
    """trace_id, start, rate, data of each stretch in a file of either kind: MiniSEED by its record header, else SAC."""
    if len(content) > 48 and content[:6].strip().isdigit() and content[6:7] in (b"D", b"R", b"Q", b"M"):
        return mseed.decode(content)
    one = sac.decode(content)
    return [{"trace_id": one["trace_id"], "start": one["start"], "rate": 1 / one["delta"], "data": one["data"]}]


SEGMENT = "trace_id string, start_ts timestamp, sampling_rate double, npts int, data array<double>"


def _stretches(stretches: list[dict]) -> list[pa.Array]:
    at = [r["start"].replace(tzinfo=timezone.utc) for r in stretches]
    return [pa.array([r["trace_id"] for r in stretches], pa.string()), pa.array(at, pa.timestamp("us", "UTC")), pa.array([float(r["rate"]) for r in stretches], pa.float64()), pa.array([len(r["data"]) for r in stretches], pa.int32()), pa.array([r["data"] for r in stretches], pa.list_(pa.float64()))]


def read_files(spark: SparkSession, pattern: str, strict: bool = False) -> DataFrame:
    """path, folder and, of each stretch in the files, trace_id, start_ts, sampling_rate, npts, data. A file that isn't read is one row with an `error`, or stops the query if `strict`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                error, found = None, []
                try:
                    found = decoded(content)
                except (ValueError, IndexError, OverflowError, struct.error) as e:
                    if strict:
                        raise ValueError(f"{path}: {e}") from e
                    error = str(e) or type(e).__name__
                rows = max(1, len(found))
                parts = _stretches(found) if found else [pa.nulls(1, a.type) for a in _stretches([])]
                yield pa.RecordBatch.from_arrays([pa.array([path] * rows), *parts, pa.array([error] * rows, pa.string())], names=["path", "trace_id", "start_ts", "sampling_rate", "npts", "data", "error"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInArrow(run, f"path string, {SEGMENT}, error string").withColumn("folder", F.element_at(F.split("path", "/"), -2))


def read_event_folders(events: DataFrame, root: str) -> DataFrame:
    """events (evid, trace_id) with start_ts, sampling_rate, npts and data of the first stretch of their trace in the folder whose name contains the evid; status no_waveform if there is none.

    A dot or underscore of the trace's station stands for any character, an empty channel for all, and the network @@ for none.
    """
    files = read_files(events.sparkSession, f"{root.rstrip('/')}/*/*").where("error is null")
    sizes = [n for (n,) in events.select(F.length("evid")).where("evid is not null").distinct().collect() if n]  # a few lengths
    names = files.select("folder").distinct()

    def parts_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("folder") - (n - 1), F.lit(1))), lambda k: F.substring(F.col("folder"), k, F.lit(n)))

    inside = F.flatten(F.array(*map(parts_of, sizes))) if sizes else F.array().cast("array<string>")
    home = names.select("folder", F.explode(F.array_distinct(inside)).alias("evid")).groupBy("evid").agg(F.min("folder").alias("folder"))
    part = lambda c, k: F.try_element_at(F.split(c, r"\."), F.lit(k))
    wanted = events.select("evid", "trace_id").distinct().join(home, "evid")
    net = F.when(part("trace_id", 1) == "@@", "").otherwise(part("trace_id", 1))
    any_sign = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(part("trace_id", 2), r"([^A-Za-z0-9._])", r"\\$1"), "[._]", "."), F.lit("$"))
    have = files.select("folder", "path", F.col("trace_id").alias("_id"), "start_ts", "sampling_rate", "npts", "data")
    met = wanted.join(have, "folder").where((part("_id", 1) == net) & F.regexp(part("_id", 2), any_sign) & (part("_id", 3) == part("trace_id", 3)) & ((part("trace_id", 4) == "") | (part("_id", 4) == part("trace_id", 4))))
    first = met.groupBy("evid", "trace_id").agg(F.min_by(F.struct("start_ts", "sampling_rate", "npts", "data"), F.struct("path", "_id", "start_ts")).alias("w"))
    rows = events.join(first, ["evid", "trace_id"], "left")
    return rows.select(*events.columns, "w.start_ts", "w.sampling_rate", "w.npts", "w.data", F.when(F.col("w").isNull(), "no_waveform").otherwise("ok").alias("status"))


def sds_paths(requests: DataFrame, root: str) -> DataFrame:
    """requests (trace_id, req_start, req_end) with `path`, a row for each day's file under an archive of root/YEAR/NET/STA/CHAN.D/NET.STA.LOC.CHAN.D.YEAR.DAY that the window touches."""
    part = lambda k: F.try_element_at(F.split("trace_id", r"\."), F.lit(k))
    day = F.explode(F.sequence(F.to_date("req_start"), F.to_date("req_end"))).alias("_day")
    net = F.when(part(1) == "@@", "").otherwise(part(1))
    name = F.concat_ws(".", net, part(2), part(3), part(4), F.lit("D"), F.date_format("_day", "yyyy"), F.date_format("_day", "DDD"))
    rows = requests.select(*requests.columns, day)
    return rows.withColumn("path", F.concat_ws("/", F.lit(root.rstrip("/")), F.date_format("_day", "yyyy"), net, part(2), F.concat(part(4), F.lit(".D")), name)).drop("_day")


def windows_of(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """requests (evid, trace_id, req_start, req_end) with the merged, trimmed trace of the segments (trace_id, start_ts, sampling_rate, data) that reach into each; status no_waveform if none does."""
    end = F.timestamp_micros(F.unix_micros("start_ts") + (F.size("data") / F.col("sampling_rate") * 1e6).cast("bigint"))
    own = segments.withColumn("end_ts", end).select("trace_id", F.col("start_ts").alias("_s"), F.col("end_ts").alias("_e"), "sampling_rate", "data")
    keyed = requests.withColumn("_key", F.concat_ws("|", "evid", F.unix_micros("req_start").cast("string"), F.unix_micros("req_end").cast("string")))
    met = keyed.select("_key", "trace_id", "req_start", "req_end").distinct().join(own, "trace_id").where((F.col("_s") <= F.col("req_end")) & (F.col("_e") >= F.col("req_start")))
    whole = merged(met.select(F.col("_key").alias("evid"), "trace_id", F.col("_s").alias("start_ts"), "sampling_rate", "data"))
    cut_ = trimmed(whole.withColumnRenamed("evid", "_key").join(keyed.select("_key", "trace_id", "req_start", "req_end").distinct(), ["_key", "trace_id"])).where("npts > 0")
    rows = keyed.join(cut_.select("_key", "trace_id", "start_ts", "sampling_rate", "npts", "data"), ["_key", "trace_id"], "left").drop("_key")
    return rows.withColumn("status", F.when(F.col("data").isNull(), "no_waveform").otherwise("ok"))


def read_sds(requests: DataFrame, root: str) -> DataFrame:
    """requests (evid, trace_id, req_start, req_end) with their traces out of an archive of a file a day."""
    wanted = sds_paths(requests, root).select("path").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                if source.get_file_info(at).type == fs.FileType.File:
                    with source.open_input_stream(at) as f:
                        yield pa.RecordBatch.from_arrays(_stretches(mseed.decode(f.read())), names=["trace_id", "start_ts", "sampling_rate", "npts", "data"])

    return windows_of(requests, wanted.mapInArrow(run, SEGMENT))


def service_fetch(url: str, timeout: float = 60.0) -> Callable[[str, datetime, datetime], list[dict]]:
    """A function of (trace_id, start, end) that asks a web service for MiniSEED and tells its stretches; without data there is none."""

    def fetch(trace_id: str, start: datetime, end: datetime) -> list[dict]:
        net, sta, loc, chan = trace_id.split(".")
        terms = {"network": net, "station": sta, "location": loc or "--", "channel": chan, "starttime": start.isoformat(), "endtime": end.isoformat()}
        with urlopen(f"{url}?{urlencode(terms)}", timeout=timeout) as answer:
            content = answer.read()
        return mseed.decode(content) if content else []

    return fetch


def download(groups: DataFrame, fetch: Callable[[str, datetime, datetime], list[dict]]) -> DataFrame:
    """The windows of `cache.grouped` with data, start_ts, sampling_rate, status and error: a group is asked for once, and each window is cut from what comes.

    `fetch` maps (trace_id, start, end) to stretches. Its failure, or a window without data in it, is the status no_waveform of all members, or of that window, with what it said as error.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        utc = lambda us: datetime.fromtimestamp(us / 1e6, timezone.utc).replace(tzinfo=None)
        error, stretches = None, []
        try:
            stretches = [s for s in fetch(rows[0]["trace_id"], utc(rows[0]["gs"]), utc(rows[0]["ge"])) if len(s["data"])]
        except (OSError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
        out = []
        for r in rows:
            told = (None, None, None, error or "no data")
            for s in stretches:
                start = round(s["start"].replace(tzinfo=timezone.utc).timestamp() * 1e6)
                first, last = int(np.ceil((r["s"] - start) * s["rate"] / 1e6 - 1e-6)), int(np.floor((r["e"] - start) * s["rate"] / 1e6 + 1e-6))
                part = s["data"][max(first, 0) : max(last + 1, 0)]
                if len(part) and (told[2] is None or len(part) > len(told[2])):
                    told = (start + round(max(first, 0) / s["rate"] * 1e6), s["rate"], part, None)
            out.append((r["trace_id"], r["evid"], r["s"], r["e"], *told))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.string())
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["trace_id", "evid", "s", "e", "us", "sampling_rate", "data", "error"])

    rows = groups.select("trace_id", "evid", F.unix_micros("start_ts").alias("s"), F.unix_micros("end_ts").alias("e"), F.unix_micros("group_start").alias("gs"), F.unix_micros("group_end").alias("ge"))
    found = rows.groupBy("trace_id", "gs").applyInArrow(run, "trace_id string, evid string, s bigint, e bigint, us bigint, sampling_rate double, data array<double>, error string")
    status = F.when(F.col("error").isNull(), "ok").otherwise("no_waveform")
    return found.select("evid", "trace_id", F.timestamp_micros("s").alias("req_start"), F.timestamp_micros("e").alias("req_end"), F.timestamp_micros("us").alias("start_ts"), "sampling_rate", F.size("data").alias("npts"), "data", status.alias("status"), "error")


def extract(stored: DataFrame, folder: str, form: str = "MSEED") -> DataFrame:
    """Write each stored trace to a file of its own, MiniSEED or SAC, and tell evid, trace_id, path and status: written, missing (no data), or failed with its error.

    Files are named by evid, trace and window. They are written by the tasks, to any file system that Arrow reads; a repeated task writes the same file again.
    """
    if form not in ("MSEED", "SAC"):
        raise ValueError("form is MSEED or SAC")
    name = cache_name(F.col("evid"), F.col("trace_id"), F.col("start_ts"), F.col("end_ts"))
    rows = stored.select("evid", "trace_id", F.unix_micros("start_ts").alias("us"), F.col("sampling_rate").cast("double").alias("rate"), F.col("data").cast("array<double>").alias("data"), F.regexp_replace(name, r"\.mseed$", ".mseed" if form == "MSEED" else ".sac").alias("name"))
    base = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        source, at = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
        source.create_dir(at, recursive=True)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                path, status, error = f"{at}/{r['name']}", "written", None
                if not r["data"]:
                    status = "missing"
                else:
                    try:
                        start = datetime.fromtimestamp(r["us"] / 1e6, timezone.utc).replace(tzinfo=None)
                        content = mseed.encode(r["data"], r["rate"], start, r["trace_id"]) if form == "MSEED" else sac.encode(np.array(r["data"]), 1 / r["rate"], start, r["trace_id"])
                        with source.open_output_stream(path) as f:
                            f.write(content)
                    except (OSError, ValueError, TypeError, ZeroDivisionError, struct.error) as e:
                        status, error = "failed", f"{type(e).__name__}: {e}"
                out.append((r["evid"], r["trace_id"], path, status, error))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(5)], names=["evid", "trace_id", "path", "status", "error"])

    return rows.mapInArrow(run, "evid string, trace_id string, path string, status string, error string")
