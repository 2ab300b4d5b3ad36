"""The whole pipelines: scanning a catalog for pairs, building families, and templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import signal, units
from ..operators import families, graph, pairs, stations, templates


def scan_catalog(catalog: DataFrame, waveforms: DataFrame, cfg: Config | None = None, existing: DataFrame | None = None, station_rows: DataFrame | None = None) -> DataFrame:
    """Pairs within the search range, correlated: evid1, evid2, trace_id, lag_samples, cc_x100, sampling_rate_hz, status.

    Pairs that are stored already are left out before any waveform is read. Each trace is demeaned, tapered and passed through the
    band from cc_freq_min to cc_freq_max once, before pairs meet it. `catalog` has the trace that each event is looked up on; with
    `station_rows` (trace_id, lat, lon) a pair is looked up on the first event's nearest trace that both events have a waveform on.
    """
    cfg = cfg or Config()
    traces = waveforms.select("evid", "trace_id", "sampling_rate", "data")
    ready = signal.conditioned_traces(traces, "data", "sampling_rate", cfg.cc_freq_min, cfg.cc_freq_max)
    if station_rows is None:
        told = pairs.correlated_in_range(catalog, ready, cfg.catalog_search_range, float(cfg.cc_max_shift), cfg.cc_allow_negative, existing)
        return told.select("evid1", "evid2", "trace_id", "lag_samples", units.encode_cc(F.col("cc")).alias("cc_x100"), "sampling_rate_hz", "status")
    found = pairs.radius_pairs(catalog, cfg.catalog_search_range, existing=existing).drop("distance_km")
    own = station_rows if not cfg.catalog_trace_ids else station_rows.where(F.col("trace_id").isin(*cfg.catalog_trace_ids))
    found = stations.with_fallback(found, stations.ranked(catalog, own), traces.where(F.size("data") > 0)).drop("status")
    return correlate(pairs.with_waveforms(found, ready), cfg)


def correlate(rows: DataFrame, cfg: Config) -> DataFrame:
    """Correlation of data1 and data2 for lags of up to cc_max_shift seconds; only a status of ok has a result, and no_rate tells that the sampling rate is missing."""
    rate = F.col("sampling_rate_hz")
    known = rows.withColumn("status", F.when((F.col("status") == "ok") & ~F.coalesce(rate > 0, F.lit(False)), "no_rate").otherwise(F.col("status")))
    # as signal.lags_within
    usable = known.withColumn("data1", F.when(F.col("status") == "ok", F.col("data1"))).withColumn("_lags", F.when(rate > 0, (F.lit(float(cfg.cc_max_shift)) / (F.lit(1.0) / rate)).cast("int")))
    told = signal.correlated(usable, "data1", "data2", "_lags", cfg.cc_allow_negative)
    return told.select("evid1", "evid2", "trace_id", "lag_samples", units.encode_cc(F.col("cc")).alias("cc_x100"), "sampling_rate_hz", "status")


def build_families(pair_rows: DataFrame, catalog: DataFrame, cfg: Config | None = None, whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Members of families of two events or more, numbered; `pair_rows` have cc_x100. `whole`: as in `graph.upgma`."""
    cfg = cfg or Config()
    seen = pair_rows.where(F.col("cc_x100").isNotNull())
    edges = seen.where(units.cc_between(F.col("cc_x100"), cfg.cc_min))
    if cfg.clustering_algorithm == "UPGMA":
        groups = graph.upgma(seen.select("evid1", "evid2", units.decode_cc(F.col("cc_x100")).alias("cc")), cfg.cc_min, whole)
    elif cfg.clustering_algorithm == "shared":
        groups = graph.greedy(edges, catalog)
    else:
        groups = graph.components(edges.select(F.col("evid1").alias("a"), F.col("evid2").alias("b"))).select(F.col("id").alias("evid"), F.col("component").alias("cluster"))
    members = groups.join(catalog, "evid").withColumn("valid", F.lit(True))
    origin = None if cfg.distance_from_lon is None else (cfg.distance_from_lon, cfg.distance_from_lat)
    return families.numbered(members, cfg.sort_families_by, origin)


def build_templates(members: DataFrame, waveforms: DataFrame, lags: int | None = None, cfg: Config | None = None, station_rows: DataFrame | None = None) -> DataFrame:
    """One stacked template for each family and trace: aligned within `lags` samples, or cc_max_shift seconds, then averaged, with the family's mean place, and the mean P and S times after the traces' starts.

    With `station_rows` a trace's P and S times are those of the ak135 model, and travel_s, distance_km and distance_deg are those from the family's mean place; without, P lies
    cc_pre_P after a trace's start, where windows are cut, and the others are null.
    """
    cfg = cfg or Config()
    rows = members.join(waveforms.select("evid", "trace_id", "sampling_rate", "data", *([c for c in ("start_ts",) if c in waveforms.columns])), ["evid", "trace_id"])
    if station_rows is not None and "start_ts" in rows.columns:
        rows = stations.arrivals(rows, station_rows)
        after = lambda c: (F.unix_micros(c) - F.unix_micros("start_ts")) / 1e6
        rows = rows.withColumns({"p_offset_s": F.coalesce(after("p_time"), F.lit(cfg.cc_pre_P)), "s_offset_s": after("s_time")})
    else:
        rows = rows.withColumns({"p_offset_s": F.lit(float(cfg.cc_pre_P)), "s_offset_s": F.lit(None).cast("double")})
    moved = templates.aligned(rows, lags, cfg=cfg)
    stack = templates.stacked(moved, offsets=("p_offset_s", "s_offset_s"))
    place = members.groupBy("family_number").agg(F.min("trace_id").alias("trace_id"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("depth_km").alias("depth_km"))
    told = stack.join(place, "family_number")
    if station_rows is None:
        return told.withColumns({c: F.lit(None).cast("double") for c in ("travel_s", "distance_km", "distance_deg")})
    far = stations.arrivals(told.withColumn("orig_time", F.lit("1970-01-01").cast("timestamp")), station_rows)
    return far.withColumn("travel_s", F.col("p_s")).drop("orig_time", "p_s", "s_s", "p_time", "s_time")


def prefetch_plan(catalog: DataFrame, station_rows: DataFrame, cfg: Config | None = None, max_span_s: float = 3600.0, evids: DataFrame | None = None, max_events: int | None = None, speed_km_s: float | None = None) -> DataFrame:
    """Windows to download, grouped into requests of bounded span; P times are those of the ak135 model, or along straight rays if a speed is given."""
    from ..operators import cache

    cfg = cfg or Config()
    chosen = catalog if evids is None else catalog.join(evids, "evid", "left_semi")
    if max_events is not None:
        chosen = chosen.orderBy("orig_time", "evid").limit(max_events)
    wanted = cache.requests(chosen, stations.standard_offsets(catalog, station_rows, speed_km_s), cfg.cc_pre_P, cfg.cc_trace_length)
    return cache.grouped(wanted, max_span_s)
