"""Events and stations at the same places, against plain distances."""

import hashlib

import numpy as np
import pytest

from seismopair.functions import geo
from seismopair.operators import stations


@pytest.mark.parametrize("most", [20_000, 4])
def test_many_events_at_few_places(spark, monkeypatch, most):
    rng = np.random.default_rng(7)
    at = [(float(a), float(b)) for a, b in rng.uniform(-80, 80, (9, 2))] + [(0.0, 10.0), (-0.0, 10.0)]
    ev = [(f"e{i:03}", *at[i % 11], None if i % 9 == 0 else float(i % 5 - 1) * 40) for i in range(150)] + [("lost", None, 1.0, 1.0)]
    st = [(f"S{i:02}", *((at[i % 11]) if i % 2 else tuple(map(float, rng.uniform(-80, 80, 2))))) for i in range(23)]
    monkeypatch.setattr(stations, "STATIONS", most)
    events = spark.createDataFrame(ev, "evid string, lat double, lon double, depth_km double")
    places = spark.createDataFrame(st, "trace_id string, lat double, lon double")
    ranked = lambda e: sorted((float(geo.sphere_km(e[1], e[2], s[1], s[2])), s[0]) for s in st)
    want = {e[0]: ranked(e) for e in ev[:-1]}
    assert {r.evid: (r.distance_km, r.trace_id) for r in stations.nearest(events, places, geo.sphere_km).collect()} == {e: v[0] for e, v in want.items()}
    found = {r.evid: (r.n, r.nearest, r.furthest_km, r.ranking) for r in stations.ranking_digests(events, places, geo.sphere_km).collect()}
    assert found == {e: (23, v[0][1], v[-1][0], hashlib.md5(" ".join(t for _, t in v).encode()).hexdigest()) for e, v in want.items()}
    for x in stations.extremes(events, places).collect():
        s = next(s for s in st if s[0] == x.trace_id)
        far = sorted((float(np.hypot(geo.sphere_km(e[1], e[2], s[1], s[2]), max(e[3] or 0.0, 0.0))), e[0]) for e in ev[:-1])
        assert ((x.near_km, x.near_evid), (x.far_km, x.far_evid)) == (far[0], far[-1])


@pytest.mark.parametrize("chunk, ranked", [(4, 1 << 20), (4, 7), (20_000, 7)])
def test_more_stations_than_a_chunk_are_ranked(spark, monkeypatch, chunk, ranked):
    """Stations beyond a chunk were collected to lists of structs, a place's whole ranking each, which no executor held at size."""
    rng = np.random.default_rng(3)
    st = [(f"S{i}" if i % 6 else f"station {i} \u00e9", float(i % 5), float(i % 3)) for i in range(40)] + [("lost", None, 1.0)]
    ev = [(f"e{i}", *map(float, rng.uniform(-1, 6, 2))) for i in range(12)] + [("twice", 0.0, 0.0), ("again", -0.0, 0.0), ("lost", None, 0.0)]
    monkeypatch.setattr(stations, "STATIONS", chunk)
    monkeypatch.setattr(stations, "RANKED", ranked)
    monkeypatch.setattr(stations, "rankings", None)
    found = stations.ranking_digests(spark.createDataFrame(ev, "evid string, lat double, lon double"), spark.createDataFrame(st, "trace_id string, lat double, lon double"), geo.sphere_km)
    want = {e[0]: sorted((float(geo.sphere_km(e[1], e[2], s[1], s[2])), s[0]) for s in st[:-1]) for e in ev[:-1]}
    assert {r.evid: (r.n, r.nearest, r.furthest_km, r.ranking) for r in found.collect()} == {e: (40, v[0][1], v[-1][0], hashlib.md5(" ".join(t for _, t in v).encode()).hexdigest()) for e, v in want.items()}
