import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismopair import printing
from seismopair.__main__ import cached, parser
from seismopair.config import Config, Interval, intervals_of, scope
from seismopair.functions import geo, signal, traveltime
from seismopair.functions import sql as sql_functions
from seismopair.operators import cache, catalog, counters, families, keys, metadata, plotdata, stations
from seismopair.plans import pipelines
from seismopair.sources import catalogs, mseed, sac, waveforms
from seismopair.sources import stations as station_files
from seismopair.workspace import Workspace


def at(second):
    return datetime(2020, 1, 1) + timedelta(seconds=second)


# ---- binary formats -------------------------------------------------------------


def test_miniseed_round_trip():
    r = np.random.default_rng(0)
    for k in range(60):
        n, scale = int(r.integers(1, 3000)), 10.0 ** r.integers(0, 9.4)
        x = np.rint(np.cumsum(r.standard_normal(n) * scale) if k % 3 else r.integers(-(2**31), 2**31 - 1, n)).clip(-(2**31), 2**31 - 1)
        rate, start = [100.0, 40.0, 1.0, 0.1, 33.3333, 62.5][k % 6], datetime(2020, 2, 29, 23, 59, 59, 123456)
        (one,) = mseed.decode(mseed.encode(x, rate, start, "XX.STA.00.BHZ", 512 if k % 2 else 4096))
        assert (one["data"] == x).all() and one["start"] == start and one["rate"] == pytest.approx(rate, rel=1e-4) and one["trace_id"] == "XX.STA.00.BHZ"
    assert mseed.encode([1.5, 2.5, 3e10], 1.0, at(0), "X.S..Z") == mseed.encode([2, 2, 2**31 - 1], 1.0, at(0), "X.S..Z")
    assert mseed.decode(b"") == [] and len(mseed.decode(mseed.encode([], 1.0, at(0), "X.S..Z"))) == 0
    gap = mseed.encode(np.arange(10), 1.0, at(0), "X.S..Z") + mseed.encode(np.arange(10), 1.0, at(10), "X.S..Z") + mseed.encode(np.arange(5), 1.0, at(60), "X.S..Z")
    assert [len(s["data"]) for s in mseed.decode(gap)] == [20, 5]
    for bad in (b"x" * 600, gap[:-4]):
        with pytest.raises(ValueError):
            mseed.decode(bad)


def test_miniseed_of_other_encodings():
    """Records by hand: Steim-1 differences and plain numbers, in either byte order."""
    import struct

    def record(encoding, body, n, big=True):
        o = ">" if big else "<"
        head = b"000001D STA  00BHZXX" + struct.pack(o + "HHBBBBHHhhBBBBiHH", 2020, 1, 0, 0, 0, 0, 0, n, 10, 1, 0, 0, 0, 1, 0, 64, 48) + struct.pack(o + "HHBBBB", 1000, 0, encoding, int(big), 9, 0)
        return (head.ljust(64, b"\0") + body).ljust(512, b"\0")

    for big in (True, False):
        o = ">" if big else "<"
        for code, t in ((1, "i2"), (3, "i4"), (4, "f4"), (5, "f8")):
            (one,) = mseed.decode(record(code, np.array([1, -2, 3], o + t).tobytes(), 3, big))
            assert one["data"].tolist() == [1, -2, 3] and one["rate"] == 10
        # words 3 to 5: four bytes, two halves, one whole
        words = np.zeros(16, np.uint32)
        words[0] = 1 << 24 | 2 << 22 | 3 << 20
        words[1], words[2] = 5, 5 + 1 - 2 + 3 + 300 - 300 + 70000
        words[3] = struct.unpack(">I", struct.pack(">bbbb", 9, 1, -2, 3))[0]
        words[4], words[5] = struct.unpack(">I", struct.pack(">hh", 300, -300))[0], 70000
        (one,) = mseed.decode(record(10, words.astype(o + "u4").tobytes(), 7, big))
        assert one["data"].tolist() == [5, 6, 4, 7, 307, 7, 70007]


def test_event_folders_and_archives(spark, tmp_path):
    for name, trace, content in (("a_ev1_x", "XX.A.00.BHZ", None), ("ev2", "XX.B_1.00.BHZ", None), ("ev2", "XX.BQ1.00.BHN", None), ("ev3", "", b"not a waveform")):
        (tmp_path / "events" / name).mkdir(parents=True, exist_ok=True)
        body = content or (mseed.encode(np.arange(20), 10.0, at(5), trace) if name != "ev2" else sac.encode(np.arange(7.0), 0.1, at(6), trace))
        (tmp_path / "events" / name / f"f{trace}").write_bytes(body)
    files = waveforms.read_files(spark, f"{tmp_path}/events/*/*")
    assert files.where("error is not null").count() == 1 and files.where("folder = 'ev2'").count() == 2
    wanted = spark.createDataFrame([("ev1", "XX.A.00.BHZ"), ("ev2", "XX.B.1.00.BHZ".replace("B.1", "B_1")), ("ev2", "XX.B_1.00."), ("ev3", "XX.A.00.BHZ"), ("ev9", "XX.A.00.BHZ"), ("ev1", "XX.Q.00.BHZ")], "evid string, trace_id string")
    got = {(r.evid, r.trace_id): (r.status, r.npts) for r in waveforms.read_event_folders(wanted, f"{tmp_path}/events").collect()}
    assert got == {("ev1", "XX.A.00.BHZ"): ("ok", 20), ("ev2", "XX.B_1.00.BHZ"): ("ok", 7), ("ev2", "XX.B_1.00."): ("ok", 7), ("ev3", "XX.A.00.BHZ"): ("no_waveform", None), ("ev9", "XX.A.00.BHZ"): ("no_waveform", None), ("ev1", "XX.Q.00.BHZ"): ("no_waveform", None)}
    assert waveforms.read_event_folders(wanted.limit(0), f"{tmp_path}/events").count() == 0
    for day in (1, 2):
        folder = tmp_path / "sds/2020/XX/A/BHZ.D"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"XX.A.00.BHZ.D.2020.{day:03d}").write_bytes(mseed.encode(np.arange(86400) % 1000 + day * 1000, 1.0, datetime(2020, 1, day), "XX.A.00.BHZ"))
    asked = spark.createDataFrame([("e", "XX.A.00.BHZ", at(86395), at(86404)), ("e", "XX.A.00.BHZ", at(10), at(12)), ("e", "XX.Z.00.BHZ", at(0), at(9))], "evid string, trace_id string, req_start timestamp, req_end timestamp")
    cut = {(r.trace_id, r.req_start): r for r in waveforms.read_sds(asked, f"{tmp_path}/sds").collect()}
    assert cut["XX.A.00.BHZ", at(86395)].data == [1395, 1396, 1397, 1398, 1399, 2000, 2001, 2002, 2003, 2004] and cut["XX.A.00.BHZ", at(10)].data == [1010, 1011, 1012]
    assert cut["XX.Z.00.BHZ", at(0)].status == "no_waveform" and len(cut) == 3


# ---- downloads ------------------------------------------------------------------


@pytest.fixture
def workspace(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"), Config(cc_pre_P=1.0, cc_trace_length=4.0, retry_base_s=60.0, max_retries=2))
    rows = [(f"e{k}", at(600 * k), 40.0 + k / 100, 10.0, 10.0, 3.0, "XX.A.00.BHZ") for k in range(4)]
    w.put("catalog", spark.createDataFrame(rows, "evid string, orig_time timestamp, lat double, lon double, depth_km double, mag double, trace_id string"))
    return w


def test_download_extract_and_reset(workspace, spark, tmp_path):
    w = workspace
    (tmp_path / "s.csv").write_text("network,station,location,channel,latitude,longitude\nXX,A,00,BHZ,40.1,10.1\nXX,B,00,BHZ,40.2,10.1\n")
    near = station_files.read_delimited(spark, str(tmp_path / "s.csv"))
    plan = w.wfcache("prefetch", stations=near, max_span_s=1800.0)
    assert plan.count() == 8 and plan.select("trace_id", "group_start").distinct().count() == 4
    now = F.lit("2020-01-02 00:00:00").cast("timestamp")

    def fetch(trace, start, end):
        if trace == "XX.B.00.BHZ":
            raise OSError("refused")
        return [{"trace_id": trace, "start": start, "rate": 10.0, "data": np.arange(int((end - start).total_seconds() * 10 * 0.6))}]

    told = {r.status: r.n for r in w.wfcache("download", stations=near, fetch=fetch, now=now, max_span_s=3600.0).collect()}
    assert told == {"ok": 2, "no_waveform": 6}
    failed = {(r.evid, r.trace_id): r for r in w.table("failures").collect()}
    assert len(failed) == 6 and all(r.retry_count == 1 and ("refused" in r.last_error) == (r.trace_id == "XX.B.00.BHZ") for r in failed.values())
    again = {r.status: r.n for r in w.wfcache("download", stations=near, fetch=fetch, now=now, max_span_s=3600.0).collect()}
    assert again == {"fetched": 2, "unavailable": 6}
    later = F.lit("2020-01-03 00:00:00").cast("timestamp")
    assert {r.status: r.n for r in w.wfcache("download", stations=near, fetch=fetch, now=later, max_span_s=3600.0).collect()} == {"fetched": 2, "no_waveform": 6}
    assert {r.retry_count for r in w.table("failures").collect()} == {2}
    told = w.wfcache("inspect", now=later).first()
    assert (told.entries, told.failures, told.exhausted, told.hits, told.read_errors) == (2, 6, 6, 2, 0)
    for form in ("MSEED", "SAC"):
        out = w.wfcache("extract", folder=f"{tmp_path}/out", form=form).collect()
        assert {r.status for r in out} == {"written"} and len(out) == 2
        (one, *_) = waveforms.decoded(open(out[0].path, "rb").read())
        assert one["trace_id"] == out[0].trace_id and len(one["data"]) > 0
    assert w.wfcache("extract", folder=f"{tmp_path}/out", evids=["none"]).count() == 0
    empty = w.table("waveforms").withColumn("data", F.lit(None).cast("array<double>"))
    assert {r.status for r in waveforms.extract(empty, f"{tmp_path}/out").collect()} == {"missing"}
    assert w.wfcache("reset-failures", evids=["e0"], dry_run=True).count() == 1 and w.table("failures").count() == 6
    assert w.wfcache("reset-failures", evids=["e0"]).count() == 1 and w.table("failures").count() == 5
    a = parser().parse_args([w.root, "wfcache", "print", "--evid", "e1", "--evid", "e2"])
    assert cached(w, a).count() == w.table("waveforms").where("evid in ('e1', 'e2')").count()
    assert cached(w, parser().parse_args([w.root, "wfcache", "prefetch", "--stations", str(tmp_path / "s.csv"), "--max-events", "2"])).count() == 4
    assert cached(w, parser().parse_args([w.root, "wfcache", "reset-failures", "--all"])).count() == 5 and w.table("failures").count() == 0


def test_groups_are_those_of_the_sequential_rule(spark):
    r = random.Random(5)
    rows = []
    for trace in range(6):
        for k in range(300):
            s = r.randint(0, 40_000)
            rows.append((f"t{trace}", f"e{trace}-{k}", at(s), at(s + r.choice([0, 30, 60, 200, 1500]))))
    df = spark.createDataFrame(rows, "trace_id string, evid string, start_ts timestamp, end_ts timestamp")
    want = {}
    for trace in range(6):
        first = last = None
        for _, e, s, z in sorted((x for x in rows if x[0] == f"t{trace}"), key=lambda x: (x[2], x[3], x[1])):
            if first is not None and max(last, z) - first <= timedelta(seconds=900):
                last = max(last, z)
            else:
                first, last = s, z
            want[e] = first
    for slot in (None, 1000.0, 5000.0):
        found = cache.grouped(df, 900.0, slot).collect()
        assert {x.evid: x.group_start for x in found} == want
        assert all(x.group_end >= x.end_ts for x in found)
    assert cache.grouped(df.limit(0), 900.0).count() == 0


# ---- stations and travel times -------------------------------------------------


def test_ranking_of_few_and_many_stations(spark, monkeypatch):
    r = np.random.default_rng(1)
    ev = [(f"e{k:03d}", float(a), float(b), 5.0) for k, (a, b) in enumerate(r.uniform(-60, 60, (40, 2)))] + [("none", None, 1.0, 5.0)]
    st = [(f"S{k:03d}", float(a), float(b)) for k, (a, b) in enumerate(r.uniform(-60, 60, (90, 2)))] + [("S900", 1.0, None)]
    st[7] = ("S007", *st[3][1:])  # a tie
    events = spark.createDataFrame(ev, "evid string, lat double, lon double, depth_km double")
    places = spark.createDataFrame(st, "trace_id string, lat double, lon double")
    want = {}
    for e, a, b, _ in ev[:-1]:
        km = geo.ellipsoid_km(np.full(90, a), np.full(90, b), np.array([s[1] for s in st[:-1]]), np.array([s[2] for s in st[:-1]]))
        want[e] = [st[k][0] for k in sorted(range(90), key=lambda k: (km[k], st[k][0]))]
    few = stations.extremes(events, places).orderBy("trace_id").collect()
    for limit in (20_000, 25):
        monkeypatch.setattr(stations, "STATIONS", limit)
        assert {x.evid: x.trace_ids for x in stations.rankings(events, places).collect()} == want
        assert {x.evid: x.trace_ids for x in stations.rankings(events, places, 5).collect()} == {e: v[:5] for e, v in want.items()}
        assert {x.evid: x.trace_id for x in stations.nearest(events, places).collect()} == {e: v[0] for e, v in want.items()}
        assert [tuple(x) for x in stations.extremes(events, places).orderBy("trace_id").collect()] == [tuple(x) for x in few]
    assert stations.rankings(events.limit(0), places).count() == 0
    km = geo.sphere_km(np.array([e[1] for e in ev[:-1]]), np.array([e[2] for e in ev[:-1]]), st[0][1], st[0][2])
    hypo = np.hypot(km, 5.0)
    assert (few[0].near_evid, few[0].far_evid) == (ev[int(hypo.argmin())][0], ev[int(hypo.argmax())][0]) and few[0].near_km == pytest.approx(hypo.min())


def test_travel_times_of_the_model(spark):
    # published first arrivals of the ak135 tables at the surface, to a tenth of a second
    for degrees, seconds in ((10.0, 144.9), (20.0, 274.1)):
        assert traveltime.seconds(np.array([degrees]), np.array([0.0]))[0] == pytest.approx(seconds, abs=0.15)
    chord = np.sqrt(6371.0**2 + 6361.0**2 - 2 * 6371.0 * 6361.0 * np.cos(np.radians(0.3)))
    assert traveltime.seconds(np.array([0.3]), np.array([10.0]))[0] == pytest.approx(chord / 5.8, abs=1e-3)
    assert traveltime.seconds(np.array([0.3]), np.array([10.0]), "S")[0] == pytest.approx(chord / 3.46, abs=1e-3)
    p = traveltime.seconds(np.linspace(0, 25, 500), np.full(500, 33.0))
    assert (np.diff(p) > 0).all() and np.isnan(traveltime.seconds(np.array([26.0, 1.0]), np.array([0.0, 800.0]))).all()
    rows = spark.createDataFrame([("e", "X.S..Z", at(0), 0.0, 0.0, -1.0), ("f", "X.S..Z", at(0), None, 0.0, 1.0), ("g", "X.Q..Z", at(0), 0.0, 0.0, 1.0)], "evid string, trace_id string, orig_time timestamp, lat double, lon double, depth_km double")
    found = {r.evid: r for r in stations.arrivals(rows, spark.createDataFrame([("X.S..Z", 1.0, 0.0)], "trace_id string, lat double, lon double")).collect()}
    assert found["e"].p_s == pytest.approx(19.2, abs=0.1) and found["e"].s_s > found["e"].p_s and found["e"].p_time == at(0) + timedelta(microseconds=round(found["e"].p_s * 1e6))
    assert found["f"].p_s is None and found["g"].p_s is None


def test_scan_on_the_nearest_common_trace(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal(80)
    waves = [(e, t, 1.0, (base + 0.01 * r.standard_normal(80)).tolist()) for e, t in (("a", "S.FAR.."), ("b", "S.FAR.."), ("b", "S.NEAR.."), ("c", "S.NEAR.."), ("a", "S.MID.."), ("b", "S.MID.."))]
    ev = spark.createDataFrame([("a", at(0), 0.0, 0.0), ("b", at(1), 0.0, 0.01), ("c", at(2), 0.01, 0.0)], "evid string, orig_time timestamp, lat double, lon double")
    places = spark.createDataFrame([("S.NEAR..", 0.0, 0.1), ("S.MID..", 0.0, 0.5), ("S.FAR..", 0.0, 2.0)], "trace_id string, lat double, lon double")
    found = {(p.evid1, p.evid2): (p.trace_id, p.status) for p in pipelines.scan_catalog(ev, spark.createDataFrame(waves, "evid string, trace_id string, sampling_rate double, data array<double>"), Config(catalog_search_range=30.0), None, places).collect()}
    assert found == {("a", "b"): ("S.MID..", "ok"), ("a", "c"): (None, "no_waveform"), ("b", "c"): ("S.NEAR..", "ok")}


def test_station_services(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"#Network|Station|Location|Channel|Latitude|Longitude|Elevation|Depth|Azimuth|Dip|SensorDescription|Scale|ScaleFreq|ScaleUnits|SampleRate|StartTime|EndTime\nXX|A.1|00|BHZ|1.5|2.5|10.0|0.0|0|0|s|1|1|m|40.0|2019-01-01T00:00:00|\n")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = station_files.read_service(spark, f"http://127.0.0.1:{server.server_port}/query", ["XX.A..BHZ"])
    (one,) = rows.collect()
    assert (one.trace_id, one.lat, one.sampling_rate_hz, one.valid_to) == ("XX.A_1.00.BHZ", 1.5, 40.0, None)
    assert station_files.first_source(lambda: None, lambda: rows.limit(0), lambda: rows).count() == 1
    with pytest.raises(LookupError):
        station_files.first_source(lambda: None)


# ---- small things --------------------------------------------------------------


def test_keys_and_values(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, evid string")
    made = keys.encoded(stored, spark.createDataFrame([("c",), ("b",), ("aa",), ("c",), (None,)], "evid string"))
    assert {r.evid: r.event_id for r in made.collect()} == {"a": 1, "b": 2, "aa": 3, "c": 4}
    pair = keys.with_keys(spark.createDataFrame([("c", "a"), ("x", "a")], "evid1 string, evid2 string"), made, {"evid1": "event_id1", "evid2": "event_id2"})
    assert {(r.event_id1, r.event_id2) for r in pair.collect()} == {(4, 1), (None, 1)}
    assert tuple(keys.evids_of_pair(pair.select("event_id1", "event_id2"), made, 1 * 10 + 4, 10).first()) == ("c", "a")
    v = spark.createDataFrame([("k", "1"), ("m", "2")], "key string, value string")
    assert {r.key: r.value for r in keys.put_values(v, spark.createDataFrame([("k", "9")], "key string, value string")).collect()} == {"k": "9", "m": "2"}


def test_counters(spark):
    total = counters.merged(spark.createDataFrame([(2, 1.0, 4, 2.0, 3, 1), (0, 0.0, 0, 0.0, 0, 0)], "fetched int, fetch_s double, correlated int, correlate_s double, hits int, misses int")).first()
    assert (total.fetched, total.mean_fetch_s, total.mean_correlate_s, total.hit_rate) == (2, 0.5, 0.5, 0.75)
    none = counters.merged(spark.createDataFrame([], "fetched int, fetch_s double, correlated int, correlate_s double, hits int, misses int")).first()
    assert none.hit_rate == 0 and none.mean_fetch_s == 0
    told = counters.snapshots(spark.createDataFrame([(at(100), 50), (at(500), 200), (at(700), 300)], "ts timestamp, done int"), 600.0).orderBy("window").collect()
    assert [(r.done, r.pairs_per_s) for r in told] == [(200, 0.4), (100, 0.5)]


def test_settings_and_pages():
    told = intervals_of({"catalog_start_time": "a", "catalog_end_time": "b", "catalog_url": "u", "catalog_start_time_1": "c", "catalog_url_1": "v", "catalog_end_time_3": "z"})
    assert told == (Interval("a", "b", "u"), Interval("c", None, "v"))
    assert scope(Config(catalog_trace_ids=("A.B.C.D",))) == ("A.B.C.D",) and scope(Config(), ["X.Y..Z"]) == ("X.Y..Z",)
    with pytest.raises(ValueError):
        scope(Config(), ["X.Y"])
    rows = [{"v": 2}, {"v": None}, {"v": 1}]
    assert [r["v"] for r in printing.sorted_rows(rows, "v")] == [1, 2, None] and [r["v"] for r in printing.sorted_rows(rows, "v", False)] == [None, 2, 1]


def test_pages_are_held(spark):
    asked = []
    df = spark.range(100)
    pages = printing.Pages(lambda at_, n: asked.append((at_, n)) or df.orderBy("id").offset(at_).limit(n), 10)
    assert [r["id"] for r in pages[1]] == list(range(10, 20)) and pages[4][0]["id"] == 40 and pages[0][0]["id"] == 0
    assert asked == [(10, 50), (0, 50)] and pages[9][-1]["id"] == 99 and pages[11] == []


def test_versions_modes_and_sources(workspace, spark):
    w = workspace
    assert w.value("schema_version") == "2" and w.value("none") is None
    w.set_value("tp_min", "1.5")
    assert Workspace(spark, w.root).value("tp_min") == "1.5"
    w.set_value("schema_version", "1")
    with pytest.raises(RuntimeError, match="version 1"):
        Workspace(spark, w.root)
    w.set_value("schema_version", "2")
    w.put("pairs", spark.createDataFrame([("e0", "e1", "XX.A.00.BHZ", 1, 95, 10.0, "ok"), ("e0", "e2", "XX.A.00.BHZ", None, None, None, "no_waveform")], "evid1 string, evid2 string, trace_id string, lag_samples int, cc_x100 int, sampling_rate_hz double, status string"))
    with pytest.raises(RuntimeError):
        w.scan_catalog("abort")
    bad = {r.evid: (r.start_ts, r.end_ts) for r in cache.pair_failures(w.table("pairs"), w.table("catalog")).collect()}
    assert bad == {"e0": (at(-3600), at(3600)), "e2": (at(1200 - 3600), at(1200 + 3600))}
    w.put("waveforms", spark.createDataFrame([(f"e{k}", "XX.A.00.BHZ", 10.0, 4, [0.0, 1.0, 2.0, 0.0]) for k in range(2)] + [("e3", "XX.A.00.BHZ", 10.0, 9, [0.0])], "evid string, trace_id string, sampling_rate double, npts int, data array<double>"))
    (row,) = w.plot_pair("e1", "e0").collect()
    assert row.data2 == [0, 0, 0.5, 1.0]
    good, told = cache.readable(w.table("waveforms"))
    assert good.count() == 2 and (told.first().hits, told.first().read_errors) == (2, 1)
    w.put("detections", spark.createDataFrame([(3, "XX.A.00.BHZ", "d1", at(0), 10.0, 40.0, 5.0, 0.8)], "family_number int, trace_id string, evid string, orig_time timestamp, lon double, lat double, depth_km double, cc_max double"))
    assert w.members_of("templates").first().family_number == 3 and w.members_of().count() == 0
    with pytest.raises(RuntimeError):
        w.scan_templates(spark.createDataFrame([], "trace_id string, ts timestamp, value double"), 1.0, "abort")
    assert w.clear_detections().count() == 0


def test_family_rules(spark):
    rows = [("a", "T1", at(0), 1, True), ("b", "T1", at(5), 1, False), ("c", "T1", at(0), 2, False), ("d", "T2", at(5), 2, True)]
    members = spark.createDataFrame(rows, "evid string, trace_id string, orig_time timestamp, family_number int, valid boolean").withColumns({"lon": F.lit(1.0), "lat": F.lit(1.0), "depth_km": F.lit(5.0), "mag": F.lit(3.0)})
    s = families.summary(members)
    assert {r.family_number: (r.valid, r.one_trace) for r in s.collect()} == {1: (False, True), 2: (True, False)}
    with pytest.raises(Exception, match="more than one trace"):
        families.summary(members, one_trace=True).collect()
    told = families.global_stats(families.table(s, families.distance_stats(members))).first()
    assert told.hdist_max == 0 and told.vdist_max == 0
    assert plotdata.first_families(members, 1).count() == 2
    shades = plotdata.duration_colours(s).collect()
    assert {r.unit for r in shades} == {"mins"} and shades[0].duration == pytest.approx(5 / 60)


def test_configured_metadata(spark):
    schema = "trace_id string, valid_from timestamp, valid_to timestamp, sampling_rate_hz double, trace_lon double, trace_lat double, elevation double, local_depth double"
    stored = spark.createDataFrame([("A", at(0), None, 1.0, 0.0, 0.0, 0.0, 0.0)], schema)
    channels = spark.createDataFrame([("A", at(0), None, 2.0, 0.0, 0.0, 0.0, 0.0), ("B", None, None, 2.0, 0.0, 0.0, 0.0, 0.0), ("C", None, None, 2.0, 0.0, 0.0, 0.0, 0.0)], schema)
    assert {r.trace_id for r in metadata.with_configured(stored, channels, ["A", "B"]).collect()} == {"A", "B"}


def test_registered_functions(spark):
    sql_functions.register(spark)
    r = np.random.default_rng(6)
    x, y = r.standard_normal(30).tolist(), r.standard_normal(30).tolist()
    df = spark.createDataFrame([(x, y, 3.0, at(1000)), (None, y, None, None)], "a array<double>, b array<double>, m double, t timestamp")
    df.createOrReplaceTempView("waves")
    one, none = spark.sql("SELECT cc_max(a, b, 4) AS c, cc_lag(a, b, 4) AS l, mad(b) AS d, slip_cm(m) AS s, moment(m) AS o, haversine_km(0, 0, 0, m) AS k, generate_evid(t) AS e FROM waves ORDER BY m DESC").collect()
    lag, cc = signal.peak(signal.correlate(np.array([x]), np.array([y]), 4))
    assert (one.l, one.c) == (lag[0], pytest.approx(cc[0])) and one.o == pytest.approx(10 ** (1.5 * 9.07)) and one.k == pytest.approx(333.585, abs=0.01)
    from seismopair.functions import ids, slip

    told = df.select(slip.slip_cm(F.col("m")).alias("s"), ids.generate_evid(F.col("t")).alias("e")).first()
    assert one.s == pytest.approx(told.s) and one.e == told.e and none.c is None and none.s == 0 and none.e is None


def test_header_spellings(tmp_path, spark):
    assert catalogs.guess_fields(["Event ID", "YYYY", "MM", "DD", "HH", "Min", "SS", "Latitude", "Longitude", "Depth km", "Mag"]) == {"evid": "Event ID", "year": "YYYY", "month": "MM", "day": "DD", "hour": "HH", "minute": "Min", "seconds": "SS", "lat": "Latitude", "lon": "Longitude", "depth_km": "Depth km", "mag": "Mag"}
    assert catalogs.guess_fields(["time", "lat", "lon", "mag"])["orig_time"] == "time"
    assert catalogs.sniff(["a;b;c;d;e;f;g", "1,2;3,4;5", "6,7,8"]) == ";" and catalogs.sniff(["a,b,c;d;e;f", "1,2,3,4;5;6;7"]) == "," and catalogs.sniff(["a b"]) == " "
    bad = tmp_path / "x.csv"
    bad.write_text("a,b,c,d,e,f\n1,2,3,4,5,6\n")
    with pytest.raises(ValueError, match="no time"):
        catalogs.read_delimited(spark, str(bad))


def test_spread_of_rows():
    r = np.random.default_rng(0)
    x = r.standard_normal((50, 13)) * (r.random((50, 13)) > 0.3)
    x[7] = 0
    for row, told in zip(x, signal.mad(x)):
        own = row[np.abs(row) > 1e-5]
        assert told == pytest.approx(np.median(np.abs(own - np.median(own))) if len(own) else 0.0)
    assert signal.mad(np.zeros((3, 0))).tolist() == [0, 0, 0]


def test_append_keeps_the_stored(spark):
    old = spark.createDataFrame([("a", at(0), "t")], "evid string, orig_time timestamp, trace_id string")
    new = spark.createDataFrame([("a", at(5), "t"), ("b", at(6), "t"), ("b", at(4), "t")], "evid string, orig_time timestamp, trace_id string")
    assert {r.evid: r.orig_time for r in catalog.appended(old, new).collect()} == {"a": at(0), "b": at(4)}


def test_formats_are_tried_in_turn(spark, tmp_path):
    bars = "|".join(["e1", "2020-01-01T00:00:00", "1", "2", "3", "", "", "", "", "Mw", "4", "", ""])
    good, bad, table, none = (tmp_path / n for n in ("good.txt", "bad.txt", "table.csv", "none.txt"))
    good.write_text(f"# header\n{bars}\n")
    bad.write_text(f"{bars}\ne2|no time|1\n")
    table.write_text("evid,time,lat,lon,mag,x\ne3,2020-01-02T00:00:00,1,2,3,4\n")
    none.write_text("\n\n")
    assert catalogs.read(spark, str(good)).first().evid == "e1" and catalogs.read(spark, str(table)).first().evid == "e3"
    with pytest.raises(ValueError, match="no format"):
        catalogs.read(spark, str(bad))
    with pytest.raises(ValueError, match="empty"):
        catalogs.read(spark, str(none))


def test_template_files(spark, tmp_path):
    known = spark.createDataFrame([(2, "XX.A.00.BHZ", 40.0, 10.0, 5.0, 1.5, [1.0, 2.0, 3.0])], "family_number int, trace_id string, lat double, lon double, depth_km double, p_offset_s double, data array<double>")
    assert sac.write_templates(known, f"{tmp_path}/t", 0.1) == 1
    (tmp_path / "t" / "template09.bad.sac").write_bytes(b"short")
    (tmp_path / "own.sac").write_bytes(sac.encode(np.arange(4.0), 0.5, at(0), "XX.Q..BHZ"))
    rows = {r.family_number: r for r in sac.read_templates(spark, f"{tmp_path}/t", str(tmp_path / "own.sac")).collect()}
    assert set(rows) == {2, 3} and rows[2].data == [1, 2, 3] and rows[2].p_offset_s == 1.5 and rows[2].delta == pytest.approx(0.1) and rows[3].trace_id == "XX.Q..BHZ" and rows[3].p_offset_s is None


def test_windows_around_p_and_templates_with_stations(spark, workspace):
    near = spark.createDataFrame([("XX.A.00.BHZ", 40.0, 10.2)], "trace_id string, lat double, lon double")
    told = stations.arrivals(workspace.table("catalog").select("evid", "trace_id", "orig_time", "lat", "lon", "depth_km"), near)
    one = cache.event_windows(told, 1.0, 4.0).where("evid = 'e0'").first()
    p = told.where("evid = 'e0'").first()
    assert one.start_ts == p.p_time - timedelta(seconds=1) and one.end_ts == p.p_time + timedelta(seconds=3)
    r = np.random.default_rng(4)
    base = r.standard_normal(200)
    rows = [(f"e{k}", "XX.A.00.BHZ", (p.p_time + timedelta(seconds=600 * k - 2)), 20.0, np.roll(base, 4 * k).tolist()) for k in range(2)]
    waves = spark.createDataFrame(rows, "evid string, trace_id string, start_ts timestamp, sampling_rate double, data array<double>")
    members = workspace.table("catalog").where("evid in ('e0', 'e1')").withColumn("family_number", F.lit(0))
    (t,) = pipelines.build_templates(members, waves, None, Config(cc_freq_min=1.0, cc_freq_max=8.0), near).collect()
    assert t.n == 2 and len(t.data) == 200 and t.distance_km == pytest.approx(17.1, abs=0.5) and t.travel_s == pytest.approx(p.p_s, abs=0.1)
    # the second trace was moved back by 4 samples, and its P time with it
    assert t.p_offset_s == pytest.approx(2.0 + (told.where("evid = 'e1'").first().p_s - p.p_s) / 2 - 0.1, abs=0.02) and t.s_offset_s > t.p_offset_s
    plain = pipelines.build_templates(members, waves.drop("start_ts"), None, Config(cc_freq_min=1.0, cc_freq_max=8.0)).first()
    assert plain.p_offset_s == pytest.approx(5.0 - 0.1) and plain.travel_s is None
