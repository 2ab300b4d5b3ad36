import numpy as np
import pytest

from seismopair import printing
from seismopair.__main__ import parser
from seismopair.config import Config
from seismopair.functions import signal
from seismopair.operators import templates
from seismopair.workspace import Workspace


@pytest.fixture
def workspace(spark, tmp_path):
    lines = [f"ev{i}|2020-01-01T0{i}:00:00|45.0{i % 2}|10.0|10.0|T|T|T|T|Mw|{3 + i / 10}|T|P" for i in range(6)]
    (tmp_path / "c.txt").write_text("\n".join(lines))
    w = Workspace(spark, str(tmp_path / "w"), Config(catalog_search_range=30.0, cc_min=0.9))
    w.read_catalog(str(tmp_path / "c.txt"))
    w.put("catalog", w.table("catalog").selectExpr("* except (trace_id)", "'XX.A.00.BHZ' as trace_id"))
    r = np.random.default_rng(0)
    base = r.standard_normal((2, 50))
    rows = [(f"ev{i}", "XX.A.00.BHZ", 1.0, (base[i % 2] + 0.05 * r.standard_normal(50)).tolist()) for i in range(5)]
    w.put("waveforms", spark.createDataFrame(rows, "evid string, trace_id string, sampling_rate double, data array<double>"))
    return w


def test_verbs(workspace, tmp_path):
    w = workspace
    assert w.print_catalog().count() == 6
    assert w.read_catalog(str(tmp_path / "c.txt"), append=True).count() == 6
    found = w.scan_catalog()
    assert found.count() == 15 and found.where("status = 'no_waveform'").count() == 5 and found.where("cc_x100 >= 90").count() == 4
    assert w.scan_catalog("continue").count() == 15
    assert w.build_families().count() == 5
    assert [(r.family_number, r.n) for r in w.print_families().collect()] == [(0, 3), (1, 2)]
    assert w.print_families(stats=True).first().families == 2
    w.flag_family(0, "false")
    assert [r.family_number for r in w.print_families().collect()] == [1]
    w.flag_family(0, True)
    assert {(r.family_number, r.n) for r in w.build_templates().collect()} == {(0, 3), (1, 2)}
    assert w.plot("cumulative").count() == 5 and w.plot("map").count() == 2 and w.plot("traces", "1").count() == 2 and w.plot("timespans").count() == 5
    assert w.print_pairs(cc_min=0.9, order_by="cc", ascending=False).count() == 4
    assert w.wfcache("summary").first().entries == 5 and w.wfcache("print", evids=["ev1"]).count() == 1
    with pytest.raises(ValueError):
        w.scan_catalog("other")


def test_shifts_are_seconds_at_any_rate(spark, tmp_path):
    r = np.random.default_rng(3)
    w = Workspace(spark, str(tmp_path / "w"), Config(catalog_search_range=5.0))
    rows, events = [], []
    for k, (rate, late) in enumerate([(100.0, 120), (40.0, 50)]):
        t = np.arange(int(20 * rate)) / rate
        burst = np.sin(2 * np.pi * 5 * t + 3 * np.sin(2 * np.pi * 0.7 * t)) * np.exp(-(((t - 9) / 1.2) ** 2))
        for j in range(2):
            # slow waves outside of the band, larger than the event and different for each
            slow = 5 * np.sin(2 * np.pi * (0.1 + 0.13 * j) * t + r.uniform(0, 6))
            rows.append((f"e{k}{j}", "XX.A.00.BHZ", rate, (np.roll(burst, late * j) + slow).tolist()))
            events.append((f"e{k}{j}", 10 * k + j, 40.0 + k, 10.0))
    w.put("catalog", spark.createDataFrame(events, "evid string, t int, lat double, lon double").selectExpr("evid", "timestamp_seconds(t) as orig_time", "lat", "lon", "10d as depth_km", "3d as mag", "'XX.A.00.BHZ' as trace_id"))
    w.put("waveforms", spark.createDataFrame(rows, "evid string, trace_id string, sampling_rate double, data array<double>"))
    found = {p.evid1: p for p in w.scan_catalog().collect()}
    assert {e: (p.evid2, p.lag_samples, p.sampling_rate_hz) for e, p in found.items()} == {"e00": ("e01", -120, 100.0), "e10": ("e11", -50, 40.0)}
    assert all(p.cc_x100 >= 98 for p in found.values())
    assert w.build_families().count() == 4
    rows = w.table("families").join(w.table("waveforms").select("evid", "trace_id", "sampling_rate", "data"), ["evid", "trace_id"])
    assert {a.evid: a.shift for a in templates.aligned(rows, None, cfg=w.cfg).collect()} == {"e00": 0, "e01": -120, "e10": 0, "e11": -50}
    assert w.build_templates().count() == 2 and w.plot("traces").count() == 4


def test_bands_of_low_rates():
    assert len(signal.band(2.0, 10.0, 50.0)) == 4 and len(signal.band(2.0, 10.0, 4.0)) == 0
    sos = signal.band(2.0, 10.0, 16.0)
    for f, gain in ((2.0, 0.5**0.5), (7.9, 1.0), (0.4, 0.0)):
        z = np.exp(-2j * np.pi * f / 16)
        assert abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos])) == pytest.approx(gain, abs=0.02)


def test_forms(spark):
    df = spark.createDataFrame([(1, "a|b", None), (2, "x" * 60, 1.5)], "n int, s string, v double")
    assert list(printing.lines(df.limit(1), "csv")) == ["n,s,v", "1,a|b,"]
    assert list(printing.lines(df.limit(1), "markdown"))[1] == "|---|---|---|"
    assert list(printing.lines(df, "simple", width=10))[2].split() == ["2", "xxxxxxxxx…", "1.5000"]
    assert list(printing.lines(df.limit(1), "json")) == ['{"n": 1, "s": "a|b", "v": null}']
    with pytest.raises(ValueError):
        list(printing.lines(df, "other"))


def test_command_line():
    a = parser().parse_args(["root", "print_families", "2-5", "-S"])
    assert (a.verb, a.numbers, a.stats) == ("print_families", "2-5", True)
