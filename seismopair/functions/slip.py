"""Seismic moment and slip from magnitude, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config


def moment(mag: Column, unit: str = "N.m") -> Column:
    """Moment of a moment magnitude, in N.m or dyne.cm; 0 without one."""
    shift = {"N.m": 6.07, "dyne.cm": 10.7}
    if unit not in shift:
        raise ValueError(f"unit is one of {sorted(shift)}")
    return F.coalesce(F.pow(F.lit(10.0), 1.5 * (mag + shift[unit])), F.lit(0.0))


def slip_cm(mag: Column, cfg: Config | None = None) -> Column:
    """Slip by the configured model; 0 without a magnitude.

    NJ1998 is a power law of the moment. B2001 adds slip under strain hardening to that of a circular crack,
    E1957 is the mean slip of the crack alone.
    """
    cfg = cfg or Config()
    if cfg.mag_to_slip_model == "NJ1998":
        value = F.pow(F.lit(10.0), F.lit(-2.36)) * F.pow(moment(mag, "dyne.cm"), F.lit(0.17))
    elif cfg.mag_to_slip_model == "B2001":
        # N.m over MPa is a volume in cubic centimetres
        drop, mu, hardening = cfg.static_stress_drop_MPa, cfg.rigidity_GPa * 1e3, cfg.strain_hardening_MPa_cm
        value = drop * (F.pow(moment(mag) / drop, F.lit(1 / 3)) / (1.81 * mu) + 1 / hardening)
    else:
        drop, mu = cfg.static_stress_drop_MPa * 1e6, cfg.rigidity_GPa * 1e9
        radius = F.pow(7 / 16 * moment(mag) / drop, F.lit(1 / 3))
        value = moment(mag) / (mu * math.pi * radius * radius) * 100
    return F.when(mag.isNull(), 0.0).otherwise(value)
