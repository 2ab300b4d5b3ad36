import pytest
from pyspark.sql import functions as F

from seismopair.config import Config
from seismopair.operators import cache, catalog, families, graph, metadata, pairs, stations, templates
from seismopair.schemas import CATALOG
from seismopair.sources import catalogs, waveforms
from seismopair.sources import stations as station_files

import numpy as np


def events(spark, rows):
    return spark.createDataFrame(rows, "evid string, orig_time timestamp, lat double, lon double").withColumn("orig_time", F.col("orig_time"))


def at(second):
    from datetime import datetime, timedelta

    return datetime(2020, 1, 1) + timedelta(seconds=second)


def test_radius_pairs_at_the_date_line_and_pole(spark):
    c = events(spark, [("a", at(0), 0.0, 179.99), ("b", at(1), 0.0, -179.99), ("c", at(2), 89.99, 0.0), ("d", at(2), 89.99, 180.0), ("e", at(3), None, 1.0), ("f", at(9), 0.0, 179.99)])
    near = {(r.evid1, r.evid2) for r in pairs.radius_pairs(c, 5.0).collect()}
    assert near == {("a", "b"), ("a", "f"), ("b", "f"), ("c", "d")}
    assert pairs.radius_pairs(c, 0.0).count() == 0
    assert pairs.radius_pairs(c, None).count() == 10
    assert pairs.radius_pairs(c.limit(0), 5.0).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[k] for k in range(100, 130)} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_keeps_overlapping_families(spark):
    times = {"A": 1, "B": 2, "X": 3, "Y": 4, "Z": 5}
    ev = spark.createDataFrame([(k, at(v)) for k, v in times.items()], "evid string, orig_time timestamp")
    links = spark.createDataFrame([("A", "X"), ("B", "Y"), ("X", "Z"), ("Y", "Z")], "evid1 string, evid2 string")
    found = {}
    for r in graph.greedy(links, ev).collect():
        found.setdefault(r.cluster, set()).add(r.evid)
    assert sorted(map(sorted, found.values())) == [["A", "B", "X", "Y", "Z"], ["B", "Y"]]


def test_average_linkage(spark):
    rows = [("a", "b", 0.95), ("b", "c", 0.92), ("a", "c", 0.5), ("d", "e", 0.91), ("x", "y", 0.1)]
    found = {}
    for r in graph.upgma(spark.createDataFrame(rows, "evid1 string, evid2 string, cc double"), 0.9).collect():
        found.setdefault(r.cluster, set()).add(r.evid)
    assert sorted(map(sorted, found.values())) == [["a", "b"], ["d", "e"]]


def test_family_numbers():
    assert families.numbers("all") is None and families.numbers("1,4") == [1, 4] and families.numbers("2-5") == [2, 3, 4] and families.numbers("7") == [7]
    with pytest.raises(ValueError):
        families.numbers("x")


def test_family_flag_and_lookup(spark):
    m = spark.createDataFrame([(0, True), (1, True)], "family_number int, valid boolean")
    told = families.flagged(m, 1, "f")
    assert {r.family_number: r.valid for r in told.collect()} == {0: True, 1: False}
    assert families.flagged(m, 9, True).collect() == m.collect()
    with pytest.raises(LookupError):
        families.one(told, 1)
    with pytest.raises(LookupError):
        families.one(told, 5)
    with pytest.raises(ValueError):
        families.flagged(m, 1, "maybe")


def test_ordinals_are_dense(spark):
    c = events(spark, [(f"e{i:02}", at(100 - i), 0.0, 0.0) for i in range(50)])
    rows = catalog.with_ordinal(c).orderBy("orig_time").collect()
    assert [r.ordinal for r in rows] == list(range(50))


def test_append_keeps_what_is_stored(spark):
    old = spark.createDataFrame([("a", at(0), "t")], "evid string, orig_time timestamp, trace_id string")
    new = spark.createDataFrame([("a", at(5), "t"), ("b", at(6), "t"), ("b", at(7), "t")], old.schema)
    assert sorted((r.evid, r.orig_time.second) for r in catalog.appended(old, new).collect()) == [("a", 0), ("b", 6)]


def test_failures_and_reset(spark):
    tries = spark.createDataFrame([("e", "t", at(0)), ("e", "t", at(100)), ("f", "t", at(50))], "evid string, trace_id string, ts timestamp")
    state = cache.failures(tries, 10.0, 2)
    rows = {r.evid: r for r in state.collect()}
    assert rows["e"].retry_count == 2 and (rows["e"].next_retry_after_ts - rows["e"].last_failure_ts).seconds == 20
    assert {r.evid: r.why for r in state.select("evid", cache.skip_reason(F.lit(at(55)).cast("timestamp")).alias("why")).collect()} == {"e": "exhausted", "f": "backoff"}
    with pytest.raises(ValueError):
        cache.reset(state)
    kept, gone = cache.reset(state, evids=["e"])
    assert [r.evid for r in kept.collect()] == ["f"] and [r.evid for r in gone.collect()] == ["e"]


def test_covering_windows(spark):
    stored = spark.createDataFrame([("e", "t", at(0), at(100)), ("e", "t", at(8), at(60)), ("e", "t", at(20), at(40))], "evid string, trace_id string, start_ts timestamp, end_ts timestamp")
    wanted = spark.createDataFrame([("e", "t", at(10), at(50)), ("e", "t", at(20), at(40)), ("x", "t", at(0), at(1))], "evid string, trace_id string, req_start timestamp, req_end timestamp")
    found = {(r.evid, r.req_start.second): r.hit_start for r in cache.covering(wanted, stored).collect()}
    assert found[("e", 10)].second == 20 and found[("e", 20)].second == 20 and found[("x", 0)] is None


def test_overlapping_metadata_is_an_error(spark):
    schema = "trace_id string, valid_from timestamp, valid_to timestamp, sampling_rate_hz double, trace_lon double, trace_lat double, elevation double, local_depth double"
    old = spark.createDataFrame([("t", at(0), at(100), 40.0, 1.0, 2.0, 0.0, 0.0)], schema)
    same = spark.createDataFrame([("t", at(0), None, 41.0, 1.0, 2.0, 0.0, 0.0)], schema)
    assert metadata.inserted(old, same).count() == 1 and metadata.drift(old, same).count() == 1 and metadata.drift(old, old).count() == 0
    with pytest.raises(ValueError):
        metadata.inserted(old, same.withColumn("valid_from", F.lit(at(50))))
    assert metadata.inserted(old, same.withColumn("valid_from", F.lit(at(100)))).count() == 2


def test_station_fallback(spark):
    p = spark.createDataFrame([("a", "b"), ("a", "c")], "evid1 string, evid2 string")
    ranks = spark.createDataFrame([("a", "S1", 1), ("a", "S2", 2)], "evid string, trace_id string, rank int")
    have = spark.createDataFrame([("a", "S1"), ("a", "S2"), ("b", "S2")], "evid string, trace_id string")
    found = {r.evid2: (r.trace_id, r.status) for r in stations.with_fallback(p, ranks, have).collect()}
    assert found == {"b": ("S2", "ok"), "c": (None, "no_waveform")}


def test_template_is_found_where_it_was_put(spark):
    rng = np.random.default_rng(1)
    pattern, noise = rng.standard_normal(40), 0.1 * rng.standard_normal(600)
    noise[200:240] += pattern
    rows = spark.createDataFrame([("t", at(0), noise.tolist())], "trace_id string, start timestamp, data array<double>")
    known = spark.createDataFrame([(3, "t", pattern.tolist(), 5.0, 10.0)], "family_number int, trace_id string, data array<double>, p_offset_s double, travel_s double")
    (hit,) = templates.scanned(rows, known, 1.0, 8.0).collect()
    assert hit.family_number == 3 and hit.orig_time == at(195) and 0.9 < hit.cc_max < 0.96  # both energies are those of the whole chunk
    assert templates.scanned(rows, known.drop("travel_s"), 1.0, 8.0).first().orig_time == at(205)
    # told again on the stretch around the P time
    (cut,) = templates.scanned(rows, known, 1.0, 5.0, cfg=Config(cc_freq_min=0.05, cc_freq_max=0.4, cc_pre_P=5.0, cc_trace_length=39.0)).collect()
    assert cut.orig_time == at(195) and cut.cc_max > 0.97
    assert templates.scanned(rows.limit(0), known, 1.0, 8.0).count() == 0 and templates.scanned(rows, known.limit(0), 1.0, 8.0).count() == 0
    x = np.stack([np.roll(np.r_[np.zeros(30), pattern, np.zeros(30)], s) for s in (0, 3, -2)])
    _, shift, mean = templates.align(x, 5)
    assert shift.tolist() == [0, -3, 2] and mean > 0.99


def test_catalog_files(spark, tmp_path):
    text = tmp_path / "a.txt"
    text.write_text("# c\nev1|2020-01-01T00:00:00|45.0|10.0|10.0|T|T|T|T1|Mw|4.0|T|Place\n\n")
    (row,) = catalogs.read(spark, str(text)).collect()
    assert (row.evid, row.lat, row.mag, row.location_name) == ("ev1", 45.0, 4.0, "Place")
    bad = tmp_path / "b.txt"
    bad.write_text("ev1|nonsense\n")
    assert catalogs.read_text(spark, str(bad), strict=False).count() == 0
    with pytest.raises(Exception, match="not a catalog line"):
        catalogs.read_text(spark, str(bad)).collect()
    table = tmp_path / "c.csv"
    table.write_text("Event_ID,Year,Month,Day,Hour,Min,Sec,Latitude,Longitude,Depth,Magnitude,Mag_Type\nx,2020,1,2,3,4,5.5,1,2,3,4,nan\n,2020,1,2,3,4,6,1,2,,4,Ml\n")
    rows = catalogs.read(spark, str(table)).orderBy("orig_time").collect()
    assert rows[0].evid == "x" and rows[0].mag_type == "M" and rows[0].orig_time.microsecond == 500000
    assert rows[1].evid.startswith("reqk2020") and rows[1].depth_km is None
    quake = tmp_path / "d.xml"
    quake.write_text('<q><eventParameters><event publicID="smi:x/y?eventid=77"><preferredOriginID>o2</preferredOriginID><origin publicID="o1"><time><value>2020-01-01T00:00:00Z</value></time><latitude><value>1</value></latitude><longitude><value>2</value></longitude><depth><value>5000</value></depth></origin><origin publicID="o2"><time><value>2021-01-01T00:00:00Z</value></time><latitude><value>3</value></latitude><longitude><value>4</value></longitude><depth><value>7000</value></depth></origin><magnitude publicID="m"><mag><value>4.5</value></mag><type>Mw</type></magnitude></event><event publicID="z"></event></eventParameters></q>')
    (row,) = catalogs.read(spark, str(quake)).collect()
    assert (row.evid, row.lat, row.depth_km, row.mag) == ("77", 3.0, 7.0, 4.5)
    assert catalogs.union(catalogs.read(spark, str(text)), catalogs.read(spark, str(table))).count() == 3


def test_station_file(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("network,station,location,channel,latitude,longitude,elevation\n,A.B,00,BHZ,1.5,2.5,\n")
    (row,) = station_files.read_delimited(spark, str(f)).collect()
    assert row.trace_id == "@@.A_B.00.BHZ" and row.elevation == 0 and row.lat == 1.5


def test_waveform_windows(spark):
    w = spark.createDataFrame([("e", "t", at(0), 1.0, [float(i) for i in range(20)], at(5), at(10))], "evid string, trace_id string, start_ts timestamp, sampling_rate double, data array<double>, req_start timestamp, req_end timestamp")
    (row,) = waveforms.trimmed(w).collect()
    assert row.data == [5, 6, 7, 8, 9, 10] and row.start_ts == at(5) and row.npts == 6
    s = spark.createDataFrame([("e", "t", at(0), 1.0, [0.0, 1.0]), ("e", "t", at(4), 1.0, [4.0, 5.0])], "evid string, trace_id string, start_ts timestamp, sampling_rate double, data array<double>")
    assert waveforms.merged(s).first().data == [0, 1, 2, 3, 4, 5]


def test_pages_and_bounds(spark):
    rows = spark.createDataFrame([("a", "b", "t", 0.5), ("a", "c", "t", None), ("a", "d", "t", 0.9)], "evid1 string, evid2 string, trace_id string, cc double")
    assert [r.evid2 for r in pairs.page(rows, 3, 0, "cc").collect()] == ["b", "d", "c"]
    assert [r.evid2 for r in pairs.page(rows, 3, 0, "cc", ascending=False).collect()] == ["d", "b", "c"]
    assert pairs.count_up_to(rows, 2) == 3
    with pytest.raises(ValueError):
        pairs.page(rows, 1, 0, "other")


def test_stored_catalog(spark, tmp_path):
    path = str(tmp_path / "stored")
    catalogs.write_stored(spark.createDataFrame([], CATALOG), path)
    with pytest.raises(ValueError):
        catalogs.read_stored(spark, path)
    assert catalog.range_filter(spark.createDataFrame([], CATALOG), Config(mag_min=1.0)).count() == 0
