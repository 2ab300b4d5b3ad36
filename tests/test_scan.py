"""The catalog scan, whose pairs are correlated where they are found."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from seismopair.config import Config
from seismopair.functions import signal
from seismopair.operators import pairs
from seismopair.plans import pipelines

WAVES = "evid string, trace_id string, sampling_rate double, data array<double>"


def tables(spark, more):
    """Events at few places, and waveforms of two lengths, some null, empty, without a rate, or at another; `more`: also a second one of some events on their trace, and ones on other traces."""
    rng = np.random.default_rng(3)
    events = [(f"e{i:02}", datetime(2020, 1, 1) + timedelta(seconds=i // 2), float(i % 5) / 10, 0.0, None if i == 7 else f"T{i % 3}") for i in range(40)]
    waves = []
    for i, (evid, _, _, _, trace) in enumerate(events):
        data = None if i == 9 else [] if i == 12 else [float(v) for v in rng.normal(size=48 if i % 6 == 1 else 64)]
        rate = None if i in (3, 15) else 0.0 if i == 6 else 50.0 if i % 10 == 8 else 100.0
        if i % 11:
            waves.append((evid, trace, rate, data))
        if more and i % 4 == 0:
            waves += [(evid, trace, 100.0, data), (evid, f"T{(i + 1) % 3}", 100.0, [float(v) for v in rng.normal(size=64)])]
    return spark.createDataFrame(events, "evid string, orig_time timestamp, lat double, lon double, trace_id string"), spark.createDataFrame(waves, WAVES)


@pytest.mark.parametrize("more", [False, True])
@pytest.mark.parametrize("negative", [False, True])
def test_scan_correlates_where_pairs_are_found(spark, monkeypatch, more, negative):
    c, w = tables(spark, more)
    cfg = Config(catalog_search_range=25.0, cc_freq_min=2.0, cc_freq_max=20.0, cc_max_shift=0.1, cc_allow_negative=negative)
    found = pairs.radius_pairs(c, 25.0, carry=("trace_id",)).withColumnRenamed("trace_id1", "trace_id").drop("trace_id2")
    done = found.select("evid2", "evid1").toDF("evid1", "evid2").where("evid1 < 'e20' and evid2 > 'e05'")
    want = {}
    for at, rows in (("all", found), ("rest", pairs.without_existing(found, done))):
        told = pipelines.correlate(pairs.with_waveforms(rows, signal.conditioned_traces(w, "data", "sampling_rate", 2.0, 20.0)), cfg)
        want[at] = (told.columns, sorted(map(tuple, told.collect()), key=repr))
    assert {r[-1] for r in want["all"][1]} == {"ok", "no_waveform", "no_rate", "dt_mismatch"} and len(want["all"][1]) > len(want["rest"][1]) > 50
    monkeypatch.setattr(pairs, "TRACED", 8)
    monkeypatch.setattr(pairs, "TOGETHER", 3)
    monkeypatch.delattr(pairs, "with_waveforms")  # pairs are not joined with samples
    for at, existing in (("all", None), ("rest", done)):
        told = pipelines.scan_catalog(c, w, cfg, existing)
        assert (told.columns, sorted(map(tuple, told.collect()), key=repr)) == want[at]
