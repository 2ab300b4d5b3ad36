"""Stacked templates of families, and the search for them in continuous data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import signal
from ..functions.ids import generate_evid
from ..shared import small


def stacked(traces: DataFrame, family: str = "family_number", data: str = "data", normalise: bool = False, offsets: tuple[str, ...] = ()) -> DataFrame:
    """family, n, data: the mean of each family's demeaned traces, sample by sample (and of equal peaks, if asked for), and the means of the columns `offsets`.

    Sums are made before the shuffle, a row for each family and sample, so a family may have any number of traces. A stack is as long as
    the family's first trace, by orig_time, if there is one, and evid: of longer ones the rest is cut off, shorter ones count as 0 beyond their end.
    """
    x = signal.demean(F.col(data).cast("array<double>"))
    order = [F.col(c) for c in ("orig_time", "evid") if c in traces.columns]
    first = F.min_by(F.size(data), F.struct(*order)) if order else F.max(F.size(data))
    rows = traces.where(F.size(data) > 0)
    counts = rows.groupBy(family).agg(F.count(F.lit(1)).alias("n"), first.alias("_length"), *(F.avg(c).alias(c) for c in offsets))
    rows = rows.select(family, (signal.peak_normalised(x) if normalise else x).alias("x"))
    samples = rows.select(family, F.posexplode("x").alias("at", "v")).groupBy(family, "at").agg(F.sum("v").alias("v"))
    own = samples.join(counts, family)
    means = own.where(F.col("at") < F.col("_length")).groupBy(family, "n", "_length", *offsets).agg(F.sort_array(F.collect_list(F.struct("at", (F.col("v") / F.col("n")).alias("v")))).alias("s"))
    missing = F.array_repeat(F.lit(0.0), F.col("_length") - F.size("s"))
    return means.select(family, "n", F.concat(F.col("s.v"), missing).alias("data"), *offsets)


def align(x: np.ndarray, lags: int, rounds: int = 2, ready: Callable[[np.ndarray], np.ndarray] = lambda rows: rows) -> tuple[np.ndarray, np.ndarray, float]:
    """(aligned rows, shifts, mean correlation with the stack): rows follow the first one, then twice the stack.

    `ready` makes what is correlated from the row to follow and all rows, in this order; the rows themselves are moved as they are.
    """
    total = np.zeros(len(x), int)

    def moved(rows: np.ndarray, shift: np.ndarray) -> np.ndarray:
        out = np.zeros_like(rows)
        n = rows.shape[1]
        for i, s in enumerate(shift):
            if s >= 0:
                out[i, s:] = rows[i, : max(n - s, 0)]
            else:
                out[i, : max(n + s, 0)] = rows[i, -s:]
        return out

    mean = 1.0
    for k in range(rounds + 1):
        target = x[:1] if k == 0 else x.mean(0, keepdims=True)
        seen = ready(np.concatenate([target, x]))
        lag, cc = signal.peak(signal.correlate(np.repeat(seen[:1], len(x), axis=0), seen[1:], lags))
        x, total, mean = moved(x, lag), total + lag, float(cc.mean())
    return x, total, mean


def aligned(traces: DataFrame, lags: int | None, family: str = "family_number", data: str = "data", cfg: Config | None = None) -> DataFrame:
    """family, evid, shift, cc_mean, data: each family's traces in evid order, aligned; a family is one task's work.

    Columns orig_time, p_offset_s and s_offset_s, if there are such, stay, and the offsets move with the trace. With `cfg`, traces have a sampling_rate and are passed through its band where they are correlated; lags of None are
    then its cc_max_shift at the rate of the family's first trace.
    """
    kind = traces.schema[family].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("evid")
        x = signal.padded([np.asarray(v, float) for v in group[data]])
        reach, more = lags, {}
        if cfg is not None:
            rates = group["sampling_rate"].to_numpy(float)
            if not (rates > 0).all():
                raise ValueError("a trace has no sampling rate")
            of = np.append(rates[0], rates)
            reach = signal.lags_within(cfg.cc_max_shift, rates[0]) if lags is None else lags

            def ready(rows: np.ndarray) -> np.ndarray:
                out = np.empty_like(rows)
                for hz in set(of):
                    out[of == hz] = signal.conditioned(rows[of == hz], hz, cfg.cc_freq_min, cfg.cc_freq_max)
                return out

            more = {"ready": ready}
        y, shift, mean = align(x - x.mean(1, keepdims=True), reach, **more)
        moved = {c: group[c] + shift / group["sampling_rate"] for c in offsets}
        return pd.DataFrame({family: group[family], "evid": group["evid"], "shift": shift.astype(np.int32), "cc_mean": mean, "data": list(y)} | {c: group[c] for c in time} | moved)

    time = [c for c in ("orig_time",) if c in traces.columns]
    offsets = [c for c in ("p_offset_s", "s_offset_s") if c in traces.columns and "sampling_rate" in traces.columns]
    wanted = traces.select(family, "evid", data, *(["sampling_rate"] if cfg is not None or offsets else []), *time, *(F.col(c).cast("double").alias(c) for c in offsets)).where(F.size(data) > 0)
    schema = f"{family} {kind}, evid string, shift int, cc_mean double, data array<double>" + ", orig_time timestamp" * len(time) + "".join(f", {c} double" for c in offsets)
    return wanted.groupBy(family).applyInPandas(run, schema)


def chunks(samples: DataFrame, chunk_s: float, overlap_s: float, time: str = "ts") -> DataFrame:
    """samples with window (start, end): windows of chunk and overlap, one every chunk."""
    span, step = f"{int((chunk_s + overlap_s) * 1e6)} microseconds", f"{int(chunk_s * 1e6)} microseconds"
    return samples.withColumn("window", F.window(time, span, step))


def filled(rows: DataFrame, n: int) -> DataFrame:
    """rows with `data`, n samples each, in place of the arrays `at` (places from 0) and `value`: the mean of the values at a place, 0 where there is none. One pass over the arrays."""
    names = [c for c in rows.columns if c not in ("at", "value")]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + ["data array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, signal.SAMPLES // max(1, n))
        for whole in batches:
            for start in range(0, whole.num_rows, some):
                batch = whole.slice(start, some)
                at, value = (batch.column(c) for c in ("at", "value"))
                row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(at).fill_null(0)))
                at, value = at.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False).astype(float)
                own = ~np.isnan(value) & (at >= 0) & (at < n)
                place = row[own] * n + at[own].astype(np.int64)
                size = batch.num_rows * n
                count = np.bincount(place, minlength=size)
                data = np.bincount(place, value[own], size) / np.maximum(count, 1)
                cut = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(cut, pa.array(data))], names=[*names, "data"])

    return rows.mapInArrow(run, schema)


def series(samples: DataFrame, chunk_s: float, overlap_s: float, step_s: float, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """keys, start, data: one regular array per chunk from (keys, ts, value), missing samples as 0, repeated ones as their mean."""
    at = F.floor((F.unix_micros("ts") - F.unix_micros(F.col("window.start"))) / F.lit(step_s * 1e6)).cast("int")
    rows = chunks(samples, chunk_s, overlap_s).select(*keys, F.col("window.start").alias("start"), at.alias("at"), F.col("value").cast("double").alias("value"))
    got = rows.groupBy(*keys, "start").agg(F.collect_list(F.struct("at", F.coalesce("value", F.lit(float("nan"))).alias("value"))).alias("s"))
    return filled(got.select(*keys, "start", F.col("s.at").alias("at"), F.col("s.value").alias("value")), int(round((chunk_s + overlap_s) / step_s)))


def correlation(data: np.ndarray, template: np.ndarray, lags: int, ready: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """Correlation of a chunk and a template for lags -lags..lags, over the root of both energies; the shorter one has zeros on both sides."""
    both = signal.padded([ready(data[None])[0], ready(template[None])[0]])
    return signal.correlate(both[:1], both[1:], lags)[0]


def search(cc: np.ndarray, ratio: float, allow_negative: bool = False) -> tuple[int, float, float] | None:
    """(lag, peak, ratio to the median absolute deviation) if the peak stands out enough."""
    spread = signal.mad(cc[None])[0] if len(cc) else 0.0
    if spread <= 0:
        return None
    lag, top = signal.peak(cc[None], allow_negative)
    if top[0] / spread <= ratio:
        return None
    return int(lag[0]), float(top[0]), float(top[0] / spread)


def scanned(series_rows: DataFrame, templates: DataFrame, step_s: float, ratio: float, lags: int | None = None, cfg: Config | None = None) -> DataFrame:
    """Detections, one at most for each template and chunk: family_number, trace_id, evid, orig_time, cc_max, mad_ratio.

    A chunk and a template are correlated for up to `lags` samples (as many as the chunk has, if None) from where their middles meet. With `cfg` both are passed
    through its band before, and cc_max is that of the stretch around the P time (p_offset_s after the template's start: cc_pre_P before it and cc_trace_length
    long) with the template. The origin time lies travel_s, if there is such a column, before the P time.

    `templates` (family_number, trace_id, data, p_offset_s) meet all chunks of their trace: some megabytes of them go to every executor, beyond that they are joined by trace.
    """
    more = ["travel_s"] if "travel_s" in templates.columns else []
    t = templates.select(F.col("family_number").cast("int").alias("family_number"), "trace_id", F.col("data").cast("array<double>").alias("template"), F.coalesce("p_offset_s", F.lit(0.0)).cast("double").alias("p_offset_s"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in more))
    ready = (lambda x: signal.conditioned(x, 1 / step_s, cfg.cc_freq_min, cfg.cc_freq_max)) if cfg is not None else (lambda x: x)
    negative = cfg is not None and cfg.cc_allow_negative

    def detected(data: np.ndarray, one: dict) -> tuple[int, float, float] | None:
        """Microseconds from the chunk's start to the origin, correlation, ratio."""
        template = np.asarray(one["template"], float)
        found = search(correlation(data, template, len(data) if lags is None else lags, ready), ratio, negative) if len(data) and len(template) else None
        if found is None:
            return None
        lag, cc, stands = found
        p = (lag + (len(data) - len(template)) // 2) * step_s + one["p_offset_s"]
        if cfg is not None:
            first, last = round((p - cfg.cc_pre_P) / step_s), round((p - cfg.cc_pre_P + cfg.cc_trace_length) / step_s)
            part = data[max(first, 0) : max(last + 1, 0)]
            if len(part):
                cc = float(signal.peak(correlation(part, template, len(data) if lags is None else lags, ready)[None], negative)[1][0])
        return round((p - one.get("travel_s", 0.0)) * 1e6), cc, stands

    kinds = (pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.float64())

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["family_number", "trace_id", "us", "cc_max", "mad_ratio"])

    rows = series_rows.select("trace_id", F.unix_micros("start").alias("us"), "data")
    sent = small(t, 5000, "template")
    if sent is not t:
        held: dict[str, list[dict]] = {}
        for one in t.toArrow().to_pylist():  # SMALL_BYTES at most
            held.setdefault(one["trace_id"], []).append(one)
        shared = series_rows.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k, trace, us in zip(range(batch.num_rows), batch.column("trace_id").to_pylist(), batch.column("us").to_pylist(), strict=True):
                    own = shared.value.get(trace, [])
                    data = np.asarray(batch.column("data")[k].values) if own else None
                    out += [(one["family_number"], trace, us + f[0], f[1], f[2]) for one in own if (f := detected(data, one))]
                yield told(out)

        found = rows.mapInArrow(run, "family_number int, trace_id string, us bigint, cc_max double, mad_ratio double")
    else:

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    one = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "data"}
                    f = detected(np.asarray(batch.column("data")[k].values), one)
                    yield told([(one["family_number"], one["trace_id"], one["us"] + f[0], f[1], f[2])] if f else [])

        found = rows.join(t, "trace_id").mapInArrow(met, "family_number int, trace_id string, us bigint, cc_max double, mad_ratio double")
    return found.withColumn("orig_time", F.timestamp_micros("us")).withColumn("evid", generate_evid(F.col("orig_time"))).drop("us")


def by_family(detections: DataFrame) -> DataFrame:
    """family_number, trace_id, n, first and last time, mean and largest correlation of stored detections."""
    return detections.groupBy("family_number", "trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("orig_time").alias("first_time"), F.max("orig_time").alias("last_time"), F.avg("cc_max").alias("cc_mean"), F.max("cc_max").alias("cc_max"))
