import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismopair.config import Config, duration_seconds, migrate
from seismopair.functions import geo, ids, signal, slip, units


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_durations():
    assert duration_seconds("90s") == 90 and duration_seconds("1h") == 3600 and duration_seconds("1h", compat_hours=True) == 1440
    assert duration_seconds(None) == math.inf
    with pytest.raises(ValueError):
        duration_seconds("soon")


def test_config_checks_itself():
    with pytest.raises(ValueError):
        Config(clustering_algorithm="other")
    with pytest.raises(ValueError):
        Config(lat_min=2.0, lat_max=1.0)
    cfg, unknown = migrate({"cc_min": 0.5, "cc_freqmin": 1.0, "gone": 3})
    assert cfg.cc_min == 0.5 and cfg.cc_freq_min == 1.0 and unknown == ["gone"]


def test_distances(spark):
    row = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)), geo.geodesic_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.hypocentral_km(F.lit(3.0), F.lit(4.0)), geo.hypocentral_km(F.lit(3.0), F.lit(-4.0)))
    assert row[0] == pytest.approx(math.pi / 2 * 6371.0088) and row[1] == pytest.approx(111.31949, abs=1e-4) and row[2] == 5 and row[3] == 3


def test_moment_and_slip(spark):
    row = one(spark, slip.moment(F.lit(4.0)), slip.moment(F.lit(None).cast("double")), slip.slip_cm(F.lit(None).cast("double")), slip.slip_cm(F.lit(4.0)))
    assert row[0] == pytest.approx(10 ** (1.5 * 10.07)) and row[1] == 0 and row[2] == 0
    assert row[3] == pytest.approx(10**-2.36 * (10 ** (1.5 * 14.7)) ** 0.17)


def test_codec_rounds_halves_to_even(spark):
    row = one(spark, units.encode_cc(F.lit(0.845)), units.encode_cc(F.lit(0.125)), units.encode_cc(F.lit(0.135)))
    assert list(row) == [84, 12, 14]


def test_base26(spark):
    assert list(one(spark, ids.base26(F.lit(0)), ids.base26(F.lit(25)), ids.base26(F.lit(26)))) == ["aaaaaa", "aaaaaz", "aaaaba"]


def test_duration_text(spark):
    years = [2.0, 0.5, 10 / 365, 5 / 24 / 365, 1 / 1440 / 365]
    assert list(one(spark, *(units.duration_text(F.lit(y)) for y in years))) == ["2.0 years", "6.1 months", "10.0 days", "5.0 hours", "1.0 mins"]


def test_tolerance(spark):
    d = lambda a, b: units.floats_differ(F.lit(a).cast("double"), F.lit(b).cast("double"), 1e-6, 1e-9)
    assert list(one(spark, d(1.0, 1.0), d(1.0, 1.1), d(None, None), d(None, 1.0))) == [False, True, False, True]


def test_shift_and_cut(spark):
    x = F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4)))
    row = one(spark, signal.shifted(x, F.lit(1)), signal.shifted(x, F.lit(-1)), signal.shifted(x, F.lit(9)), signal.cut(x, F.lit(1), F.lit(2)), signal.cut(x, F.lit(3), F.lit(1)))
    assert [list(v) for v in row] == [[0, 1, 2, 3], [2, 3, 4, 0], [0, 0, 0, 0], [2, 3], []]


def test_correlation_finds_shifts():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3, 200))
    assert signal.peak(signal.correlate(x, x, 5))[1] == pytest.approx(np.ones(3))
    assert signal.peak(signal.correlate(x, -x, 5), allow_negative=True)[1] == pytest.approx(-np.ones(3))
    late = np.roll(x, 4, axis=1)
    lag, cc = signal.peak(signal.correlate(late, x, 100))
    assert (lag == 4).all() and (cc > 0.9).all()
    assert signal.correlate(x, late, 5) == pytest.approx(signal.correlate(x, late, 100)[:, 95:106])
    assert signal.peak(signal.correlate(np.zeros((1, 9)), np.zeros((1, 9)), 2))[1][0] == 0


def test_band_pass_has_its_corners():
    sos = signal.sections(1.0, 5.0, 50.0)
    for f, gain in ((1.0, math.sqrt(0.5)), (5.0, math.sqrt(0.5)), (2.4, 1.0), (0.2, 0.0), (20.0, 0.0)):
        z = np.exp(-2j * math.pi * f / 50)
        h = np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos])
        assert abs(h) == pytest.approx(gain, abs=0.02)
    with pytest.raises(ValueError):
        signal.sections(5.0, 1.0, 50.0)


def test_envelope_of_a_wave():
    t = np.arange(400) / 40
    assert signal.envelope(np.sin(2 * np.pi * 4 * t)[None])[0, 50:350] == pytest.approx(np.ones(300), abs=0.05)
