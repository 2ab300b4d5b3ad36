"""The engine's functions under names that SQL can call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import signal

NAMES = ("cc_max", "cc_lag", "mad", "slip_cm", "moment", "haversine_km", "generate_evid")


def _peaks(a: pd.Series, b: pd.Series, lags: pd.Series) -> list[tuple[int, float] | None]:
    out = []
    for x, y, k in zip(a, b, lags, strict=True):
        if x is None or y is None or k is None or not len(x) or not len(y):
            out.append(None)
            continue
        both = signal.padded([np.asarray(x, float), np.asarray(y, float)])
        lag, cc = signal.peak(signal.correlate(both[:1], both[1:], int(k)))
        out.append((int(lag[0]), float(cc[0])))
    return out


def register(spark: SparkSession) -> None:
    """cc_max(a, b, lags), cc_lag(a, b, lags), mad(x), slip_cm(mag), moment(mag), haversine_km(lat1, lon1, lat2, lon2), generate_evid(time); those of numbers and times are SQL expressions and cost no Python."""

    @F.pandas_udf("double")
    def cc_max(a: pd.Series, b: pd.Series, lags: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else p[1] for p in _peaks(a, b, lags)], dtype=float)

    @F.pandas_udf("int")
    def cc_lag(a: pd.Series, b: pd.Series, lags: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else p[0] for p in _peaks(a, b, lags)], dtype="Int32")

    @F.pandas_udf("double")
    def mad(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else float(signal.mad(np.asarray(v, float)[None])[0]) for v in x], dtype=float)

    for name, f in (("cc_max", cc_max), ("cc_lag", cc_lag), ("mad", mad)):
        spark.udf.register(name, f)
    letter = "concat(" + ", ".join(f"substr('abcdefghijklmnopqrstuvwxyz', cast(pmod(floor(floor((unix_micros(t) - unix_micros(make_timestamp(year(t), 1, 1, 0, 0, 0))) / 1e6D / {366 * 86400.0}D * {26**6 - 1}) / {26**k}), 26) + 1 as int), 1)" for k in reversed(range(6))) + ")"
    for head, kind, body in (
        ("moment(mag double)", "double", "coalesce(pow(10.0D, 1.5D * (mag + 6.07D)), 0.0D)"),
        ("slip_cm(mag double)", "double", "coalesce(pow(10.0D, -2.36D) * pow(pow(10.0D, 1.5D * (mag + 10.7D)), 0.17D), 0.0D)"),
        ("haversine_km(lat1 double, lon1 double, lat2 double, lon2 double)", "double", "2 * 6371.0088D * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
        ("generate_evid(t timestamp)", "string", f"concat('reqk', cast(year(t) as string), {letter})"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
