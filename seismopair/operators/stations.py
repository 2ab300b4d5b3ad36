"""Operators that bring events and stations together."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, traveltime
from ..shared import SMALL, is_small

#: Distances that a task holds at a time; stations that are sent to all executors as one array at most, and such that are ranked there.
CELLS, STATIONS, RANKED = 1 << 21, SMALL, 1 << 20


def _meeting(events: DataFrame, stations: DataFrame, columns: tuple[str, ...], kernel: Callable, schema: str, whole: bool = False, most: int | None = None, block: int | None = None) -> DataFrame:
    """Rows that `kernel` makes of some events (a dictionary of arrays) and some stations (trace ids, latitudes, longitudes), for all of both.

    Up to STATIONS stations (or `most`) go to every executor once, and events meet them where they are. More are dealt to chunks of that size, events to
    blocks (of STATIONS, or `block`), and each chunk meets each block in a task of its own, which holds what it tells. A kernel that takes a batch `whole` bounds its own memory.
    """
    place = stations.where("lat is not null and lon is not null").select("trace_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    rows = events.where("lat is not null and lon is not null").select(*columns)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def made(batch, s: tuple) -> Iterator[pa.RecordBatch]:
        some = max(1, batch.num_rows if whole else CELLS // max(1, len(s[0])))
        for at in range(0, batch.num_rows, some):
            part = batch.slice(at, some)
            own = {c: (part.column(c).to_numpy() if isinstance(part, pa.Table) else part.column(c).to_numpy(zero_copy_only=False)) for c in columns}
            yield from kernel(own, *s)

    if is_small(place, most or STATIONS):
        table = place.orderBy("trace_id").toArrow()  # so many rows at most
        held = events.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("trace_id", "lat", "lon")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from made(batch, held.value)

        return rows.mapInArrow(run, schema)
    chunks = -(-place.count() // STATIONS)
    blocks = max(1, rows.count() // (block or STATIONS))
    left = rows.withColumn("_block", F.pmod(F.xxhash64("evid"), F.lit(blocks))).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = place.withColumn("_chunk", F.pmod(F.xxhash64("trace_id"), F.lit(chunks)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.sort_by("trace_id")
        found = list(made(one, tuple(two[c].to_numpy() for c in ("trace_id", "lat", "lon")))) if one.num_rows and two.num_rows else []
        kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
        return pa.Table.from_batches(found) if found else pa.table({n: pa.array([], kinds[x.split(" ")[1]]) for n, x in zip(names, schema.split(", "), strict=True)})

    return left.groupBy("_chunk", "_block").cogroup(right.groupBy("_chunk", "_block")).applyInArrow(meet, schema)


def _orders(km: np.ndarray, k: int | None) -> np.ndarray:
    """The places of each row's k least values (all, if None) in order; ties go to the first."""
    if k is None or k >= km.shape[1]:
        return np.argsort(km, axis=1, kind="stable")
    bound = np.partition(km, k - 1, axis=1)[:, k - 1 : k]
    # of those at the bound itself the first ones stay
    own = np.argsort(np.where(km <= bound, km, np.inf), axis=1, kind="stable") if k > 64 else None
    if own is not None:
        return own[:, :k]
    out, left = np.empty((len(km), k), np.int64), km.copy()
    for i in range(k):
        out[:, i] = left.argmin(1)
        left[np.arange(len(km)), out[:, i]] = np.inf
    return out


def _xyz(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)


def _nearest(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each first place the nearest second one, the first of equals, and its distance on the sphere: told exactly among those that inner products, with some to spare for rounding, can't tell apart."""
    near = _xyz(lat1, lon1) @ _xyz(lat2, lon2).T
    i, j = np.nonzero(~(near < near.max(1, keepdims=True) - 1e-13))
    km = geo.sphere_km(lat1[i], lon1[i], lat2[j], lon2[j])
    order = np.lexsort((j, km, i))
    first = order[np.unique(i[order], return_index=True)[1]]
    return j[first], km[first]


def _placed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events (those with a place) with _place, and each place once, as evid, lat, lon."""
    lat, lon = (F.col(c).cast("double") + F.lit(0.0) for c in ("lat", "lon"))  # no -0.0
    rows = events.where("lat is not null and lon is not null").withColumn("_place", F.concat_ws(" ", lat.cast("string"), lon.cast("string")))
    return rows, rows.select(F.col("_place").alias("evid"), lat.alias("lat"), lon.alias("lon")).distinct()


def _digests(places: DataFrame, stations: DataFrame, distance: Callable) -> DataFrame:
    """evid, n, nearest, furthest_km, ranking of `places` and any number of stations: pairs are sorted by Spark, which spills, and a task reads each ranking as it comes."""

    def kernel(event: dict, trace: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> Iterator[pa.RecordBatch]:
        km = distance(event["lat"].astype(float)[:, None], event["lon"].astype(float)[:, None], lat[None], lon[None])
        one, two = (pa.array(x.ravel()) for x in np.indices(km.shape))
        yield pa.RecordBatch.from_arrays([pa.array(event["evid"], pa.string()).take(one), pa.array(km.ravel()), pa.array(trace, pa.string()).take(two)], names=["evid", "km", "trace_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([x | {"ranking": x["ranking"].hexdigest()} for x in told], pa.schema([("evid", pa.string()), ("n", pa.int64()), ("nearest", pa.string()), ("furthest_km", pa.float64()), ("ranking", pa.string())]))

        for batch in batches:
            if not batch.num_rows:
                continue
            evid = batch["evid"].dictionary_encode()
            code = evid.indices.to_numpy()
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist()
            for a, b in zip(starts, [*starts[1:], len(code)], strict=True):
                some = batch.slice(a, b - a)
                names = " ".join(t for t in some["trace_id"].to_pylist() if t is not None).encode()
                name = evid[a].as_py()
                if not told or name != at:
                    if len(told) >= 1000:
                        yield made()
                        told = []
                    at = name
                    told.append({"evid": at, "n": 0, "nearest": some["trace_id"][0].as_py(), "ranking": hashlib.md5(names)})
                else:
                    told[-1]["ranking"].update(b" " + names)
                told[-1] |= {"n": told[-1]["n"] + b - a, "furthest_km": some["km"][b - a - 1].as_py()}
        if told:
            yield made()

    met = _meeting(places, stations, ("evid", "lat", "lon"), kernel, "evid string, km double, trace_id string", block=max(1, CELLS // STATIONS))
    return met.repartition("evid").sortWithinPartitions("evid", "km", "trace_id").mapInArrow(run, "evid string, n bigint, nearest string, furthest_km double, ranking string")


def ranking_digests(events: DataFrame, stations: DataFrame, distance: Callable = geo.ellipsoid_km) -> DataFrame:
    """evid, n, nearest, furthest_km, ranking: of `rankings` of all stations the size, the ends, and the MD5 of the ids with spaces between. A place is ranked once for all its events.

    Up to RANKED stations go to every executor, and a task holds one ranking at a time; more are ranked by `_digests`.
    """
    rows, places = _placed(events)
    if not is_small(stations, RANKED):
        found = _digests(places, stations, distance)
    else:

        def kernel(event: dict, trace: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(trace):
                return
            names, told = pa.array([None if t is None else f"{t} " for t in trace], pa.large_string()), []
            for one in zip(event["lat"].astype(float), event["lon"].astype(float), strict=True):
                row = distance(*(np.array([v]) for v in one), lat, lon)
                order = np.argsort(row)
                held = row[order]
                if not (held[1:] > held[:-1]).all():  # ties
                    order = np.argsort(row, kind="stable")
                _, ends, text = names.take(pa.array(order)).buffers()
                size = int(np.frombuffer(ends, np.int64)[len(order)])
                told.append((trace[order[0]], row[order[-1]], hashlib.md5(memoryview(text)[: max(0, size - 1)] if text is not None else b"").hexdigest()))
            nearest, furthest, digest = zip(*told, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(event["evid"], pa.string()), pa.array([len(trace)] * len(told), pa.int64()), pa.array(nearest, pa.string()), pa.array(furthest, pa.float64()), pa.array(digest, pa.string())], names=["evid", "n", "nearest", "furthest_km", "ranking"])

        # a place is some work, whose rows are few bytes
        spread = places.repartition(max(1, places.sparkSession.sparkContext.defaultParallelism) * 4, "evid")
        found = _meeting(spread, stations, ("evid", "lat", "lon"), kernel, "evid string, n bigint, nearest string, furthest_km double, ranking string", whole=True, most=RANKED)
    return rows.select("evid", "_place").join(found.withColumnRenamed("evid", "_place"), "_place").drop("_place")


def rankings(events: DataFrame, stations: DataFrame, k: int | None = None, distance: Callable = geo.ellipsoid_km) -> DataFrame:
    """evid, trace_ids, distances_km: each event's stations (the k nearest, if given), nearest first; ties go by trace_id.

    Distances are on the WGS84 ellipsoid, or as the function on arrays tells them. Events, and stations, without a place take no part. An
    event in two rows is ranked twice.
    """

    def kernel(event: dict, trace: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> Iterator[pa.RecordBatch]:
        if k == 1 and distance is geo.sphere_km and len(lat):
            at, km = _nearest(event["lat"].astype(float), event["lon"].astype(float), lat, lon)
            cut = pa.array(np.arange(len(km) + 1, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(cut, v) for v in (pa.array(trace, pa.string()).take(pa.array(at)), pa.array(km))]
            yield pa.RecordBatch.from_arrays([pa.array(event["evid"], pa.string()), *lists], names=["evid", "trace_ids", "distances_km"])
            return
        km = distance(event["lat"].astype(float)[:, None], event["lon"].astype(float)[:, None], lat[None], lon[None])
        order = _orders(km, k)
        cut = pa.array(np.arange(len(km) + 1, dtype=np.int32) * order.shape[1])
        lists = [pa.ListArray.from_arrays(cut, v) for v in (pa.DictionaryArray.from_arrays(pa.array(order.ravel().astype(np.int32)), pa.array(trace, pa.string())).dictionary_decode(), pa.array(np.take_along_axis(km, order, axis=1).ravel()))]
        yield pa.RecordBatch.from_arrays([pa.array(event["evid"], pa.string()), *lists], names=["evid", "trace_ids", "distances_km"])

    found = _meeting(events, stations, ("evid", "lat", "lon"), kernel, "evid string, trace_ids array<string>, distances_km array<double>", block=max(1, CELLS // STATIONS) if k is None else None)
    if is_small(stations, STATIONS):
        return found
    both = F.arrays_zip(F.col("distances_km").alias("km"), F.col("trace_ids").alias("id"))
    every = found.groupBy("evid").agg(F.array_sort(F.flatten(F.collect_list(both))).alias("s"))
    told = every.select("evid", (F.slice("s", 1, k) if k is not None else F.col("s")).alias("s"))
    return told.select("evid", F.col("s.id").alias("trace_ids"), F.col("s.km").alias("distances_km"))


def ranked(events: DataFrame, stations: DataFrame, k: int | None = None, distance: Callable = geo.ellipsoid_km) -> DataFrame:
    """evid, trace_id, distance_km, rank from 1: `rankings`, a row for each event and station."""
    told = rankings(events, stations, k, distance)
    rows = told.select("evid", F.posexplode(F.arrays_zip(F.col("trace_ids").alias("trace_id"), F.col("distances_km").alias("distance_km"))).alias("rank", "s"))
    return rows.select("evid", "s.trace_id", "s.distance_km", (F.col("rank") + 1).alias("rank"))


def nearest(events: DataFrame, stations: DataFrame, distance: Callable = geo.ellipsoid_km) -> DataFrame:
    """evid, trace_id, distance_km of each event's nearest station; a place is looked up once for all its events."""
    rows, places = _placed(events)
    found = ranked(places.repartition(max(1, places.sparkSession.sparkContext.defaultParallelism) * 4, "evid"), stations, 1, distance).drop("rank")
    return rows.select("evid", "_place").join(found.withColumnRenamed("evid", "_place"), "_place").select("evid", "trace_id", "distance_km")


def with_fallback(pairs: DataFrame, ranks: DataFrame, waveforms: DataFrame) -> DataFrame:
    """Each pair with the first event's nearest trace for which both events have a waveform; status no_waveform if there is none.

    `ranks` has evid, trace_id, rank. Each event's traces travel as one array, so that a pair is one row throughout.
    """
    have = waveforms.select("evid", "trace_id").distinct()
    order = have.join(ranks.select("evid", "trace_id", "rank"), ["evid", "trace_id"]).groupBy("evid").agg(F.sort_array(F.collect_list(F.struct("rank", "trace_id"))).alias("s"))
    first = order.select(F.col("evid").alias("evid1"), F.col("s.trace_id").alias("_one"))
    second = have.groupBy("evid").agg(F.collect_set("trace_id").alias("_two")).withColumnRenamed("evid", "evid2")
    both = pairs.join(first, "evid1", "left").join(second, "evid2", "left")
    found = both.withColumn("trace_id", F.get(F.array_intersect("_one", "_two"), F.lit(0))).drop("_one", "_two")
    return found.select(*pairs.columns, "trace_id").withColumn("status", F.when(F.col("trace_id").isNull(), "no_waveform").otherwise("ok"))


def extremes(events: DataFrame, stations: DataFrame) -> DataFrame:
    """For each trace the events of least and largest hypocentral distance: near_evid, near_km, far_evid, far_km; ties go by evid, the smaller for the nearest, the larger for the furthest."""

    depth = F.greatest(F.coalesce(F.nanvl(F.col("depth_km").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    rows, _ = _placed(events)
    # of a place only the shallowest and the deepest event count
    ends = rows.groupBy("_place").agg(F.first(F.col("lat").cast("double")).alias("lat"), F.first(F.col("lon").cast("double")).alias("lon"), F.min(F.struct(depth.alias("z"), "evid")).alias("a"), F.max(F.struct(depth.alias("z"), "evid")).alias("b"))
    places = ends.select(F.col("_place").alias("evid"), "lat", "lon", F.col("a.z").alias("high"), F.col("a.evid").alias("high_evid"), F.col("b.z").alias("low"), F.col("b.evid").alias("low_evid"))

    def kernel(event: dict, trace: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> Iterator[pa.RecordBatch]:
        lat1, lon1, high, low = (event[c].astype(float) for c in ("lat", "lon", "high", "low"))
        ends = [(high, event["high_evid"], 1), (low, event["low_evid"], -1)]
        ranks = [sign * np.unique(names.astype(str), return_inverse=True)[1] for _, names, sign in ends]
        # of each station the best so far: distance (negative for the furthest), rank of the name, event
        best = [(np.full(len(trace), np.inf), np.zeros(len(trace), np.int64), np.zeros(len(trace), np.int64)) for _ in ends]
        one, two = _xyz(lat, lon), _xyz(lat1, lon1)
        some = max(1, CELLS // max(1, len(trace)))
        for at in range(0, len(lat1), some):
            # squares of distances but for a metre; what they can't tell apart is told exactly
            about = one @ two[at : at + some].T
            np.clip(about, -1, 1, out=about)
            np.arccos(about, out=about)
            about *= geo.EARTH_KM
            about *= about
            for (z, _, sign), rank, (had_km, had_rank, had) in zip(ends, ranks, best, strict=True):
                own = about + (z * z)[None, at : at + some]
                if sign > 0:
                    limit = np.minimum(np.sqrt(own.min(1)), had_km) + 1e-3
                    s, e = np.nonzero(own <= (limit * limit)[:, None])
                else:
                    limit = np.maximum(np.maximum(np.sqrt(own.max(1)), -had_km) - 1e-3, 0)
                    s, e = np.nonzero(own >= (limit * limit)[:, None])
                e += at
                km = sign * np.hypot(geo.sphere_km(lat1[e], lon1[e], lat[s], lon[s]), z[e])
                order = np.lexsort((rank[e], km, s))
                first = order[np.unique(s[order], return_index=True)[1]]
                s, e, km = s[first], e[first], km[first]
                better = (km < had_km[s]) | ((km == had_km[s]) & (rank[e] < had_rank[s]))
                s, e, km = s[better], e[better], km[better]
                had_km[s], had_rank[s], had[s] = km, rank[e], e
        made = [v for (_, names, sign), (km, _, e) in zip(ends, best, strict=True) for v in (pa.array(names[e], pa.string()), pa.array(sign * km))]
        yield pa.RecordBatch.from_arrays([pa.array(trace, pa.string()), *made], names=["trace_id", "near_evid", "near_km", "far_evid", "far_km"])

    spread = places.repartition(max(1, places.sparkSession.sparkContext.defaultParallelism) * 2, "evid")
    some = _meeting(spread, stations, ("evid", "lat", "lon", "high", "high_evid", "low", "low_evid"), kernel, "trace_id string, near_evid string, near_km double, far_evid string, far_km double", whole=True)
    best = some.groupBy("trace_id").agg(F.min(F.struct("near_km", "near_evid")).alias("a"), F.max(F.struct("far_km", "far_evid")).alias("b"))
    return best.select("trace_id", "a.near_evid", "a.near_km", "b.far_evid", "b.far_km")


def travel_seconds(distance_km: Column, speed_km_s: float) -> Column:
    """Time along a straight ray at constant speed, in place of travel-time tables."""
    return distance_km / speed_km_s


def table_seconds(distance_km: Column, depth_km: Column, distances: list[float], depths: list[float], seconds: list[list[float]]) -> Column:
    """Time from a table over distances and depths (seconds[depth][distance]), between its nodes on straight lines, beyond its edges as at them."""
    x = F.greatest(F.lit(float(distances[0])), F.least(distance_km, F.lit(float(distances[-1]))))
    y = F.greatest(F.lit(float(depths[0])), F.least(depth_km, F.lit(float(depths[-1]))))

    def place(v: Column, nodes: list[float]) -> tuple[Column, Column]:
        grid = F.array(*(F.lit(float(n)) for n in nodes))
        at = F.greatest(F.lit(1), F.least(F.size(F.filter(grid, lambda n: n <= v)), F.lit(len(nodes) - 1)))
        low, high = F.element_at(grid, at), F.element_at(grid, at + 1)
        return at, (v - low) / (high - low)

    (i, a), (j, b) = place(x, distances), place(y, depths)
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in seconds))
    cell = lambda jj, ii: F.element_at(F.element_at(rows, jj), ii)
    return (1 - b) * ((1 - a) * cell(j, i) + a * cell(j, i + 1)) + b * ((1 - a) * cell(j + 1, i) + a * cell(j + 1, i + 1))


def standard_offsets(events: DataFrame, stations: DataFrame, speed_km_s: float | None = None) -> DataFrame:
    """trace_id, p_min_s, p_max_s: P times of the nearest and the furthest event, in the ak135 model, or along straight rays if a speed is given. A trace without a P time for either is left out."""
    e = extremes(events, stations)
    if speed_km_s is not None:
        near, far = travel_seconds(F.col("near_km"), speed_km_s), travel_seconds(F.col("far_km"), speed_km_s)
    else:
        place = stations.select("trace_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        e = e.join(place, "trace_id")
        for end in ("near", "far"):
            e = e.join(events.select(F.col("evid").alias(f"{end}_evid"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"), F.coalesce("depth_km", F.lit(0.0)).alias("_z")), f"{end}_evid")
            degrees = geo.haversine_km(F.col("_la"), F.col("_lo"), F.col("_lat"), F.col("_lon")) / (geo.EARTH_KM * np.pi / 180)
            e = e.withColumn(f"{end}_s", traveltime.travel_seconds(degrees, F.col("_z"))).drop("_la", "_lo", "_z")
        near, far = F.col("near_s"), F.col("far_s")
    told = e.select("trace_id", F.least(near, far).alias("p_min_s"), F.greatest(near, far).alias("p_max_s"))
    return told.where("p_min_s is not null and p_max_s is not null")


def arrivals(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """rows (evid, trace_id, orig_time, lat, lon, depth_km) with distance_km on WGS84, distance_deg, p_s and s_s after the origin, and p_time and s_time, in the ak135 model; null where a place is missing or out of the model's reach."""
    place = stations.select("trace_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    met = rows.join(place, "trace_id", "left")
    degrees = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) / (geo.EARTH_KM * np.pi / 180)
    depth = F.coalesce("depth_km", F.lit(0.0))
    told = met.withColumns({"distance_km": geo.geodesic_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), "distance_deg": degrees})
    told = told.withColumns({"p_s": traveltime.travel_seconds(F.col("distance_deg"), depth, "P"), "s_s": traveltime.travel_seconds(F.col("distance_deg"), depth, "S")})
    at = lambda s: F.timestamp_micros(F.unix_micros("orig_time") + F.round(s * 1e6).cast("bigint"))
    return told.withColumns({"p_time": at(F.col("p_s")), "s_time": at(F.col("s_s"))}).drop("_lat", "_lon")


def duplicated(stations: DataFrame) -> DataFrame:
    """Trace ids that stand in more than one row of the same validity."""
    return stations.groupBy("trace_id", "valid_from").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_coordinates(metadata: DataFrame) -> DataFrame:
    """Station coordinates from metadata: those of the earliest interval of each network and station."""
    parts = F.split("trace_id", r"\.")
    w = Window.partitionBy("net", "sta").orderBy("valid_from", "trace_id")
    rows = metadata.withColumns({"net": parts[0], "sta": parts[1]}).withColumn("_r", F.row_number().over(w))
    return rows.where("_r = 1").select("net", "sta", F.col("trace_lat").alias("lat"), F.col("trace_lon").alias("lon"), "elevation")
