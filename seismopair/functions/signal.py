"""Waveform kernels: native array expressions for short traces, NumPy on Arrow batches for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- native expressions -----------------------------------------------------


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def demean(x: Column) -> Column:
    return F.transform(x, lambda v: v - total(x) / F.size(x))


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def peak_normalised(x: Column) -> Column:
    top = F.array_max(F.transform(x, F.abs))
    return F.when(top > 0, F.transform(x, lambda v: v / top)).otherwise(x)


def shifted(x: Column, lag: Column) -> Column:
    """The trace delayed by `lag` samples (earlier, if negative), filled with zeros, of the same length."""
    n = F.size(x)
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    late = F.slice(F.concat(zeros(F.greatest(lag, F.lit(0))), x), F.lit(1), n)
    early = F.slice(F.concat(x, zeros(F.greatest(-lag, F.lit(0)))), F.greatest(-lag, F.lit(0)) + 1, n)
    return F.when(F.abs(lag) >= n, zeros(n)).when(lag >= 0, late).otherwise(early)


def cut(x: Column, first: Column, last: Column) -> Column:
    """Samples first to last, both included, counted from 0 and held within the trace."""
    a, b = F.greatest(first, F.lit(0)), F.least(last, F.size(x) - 1)
    return F.when(b >= a, F.slice(x, a + 1, b - a + 1)).otherwise(F.array().cast("array<double>"))


def to_counts(x: Column) -> Column:
    """Samples as 32-bit integers: halves to even, held within the range."""
    return F.transform(x, lambda v: F.rint(F.greatest(F.least(v, F.lit(2147483647.0)), F.lit(-2147483648.0))).cast("int"))


# ---- kernels on matrices, one row a trace ------------------------------------


def padded(rows: list[np.ndarray]) -> np.ndarray:
    """Traces of different lengths, each with zeros on both sides up to the longest."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        left = (width - len(r)) // 2
        out[i, left : left + len(r)] = r
    return out


def correlate(a: np.ndarray, b: np.ndarray, lags: int) -> np.ndarray:
    """Correlation of rows for lags -lags..lags: sum of a[i + lag] * b[i], over the root of both energies; a trace without energy has 0."""
    n = a.shape[1]
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    out = np.zeros((len(a), 2 * lags + 1))
    if lags > 64:
        size = 1 << int(np.ceil(np.log2(max(2 * n, 2))))
        whole = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
        for k, lag in enumerate(range(-lags, lags + 1)):
            if abs(lag) < n:
                out[:, k] = whole[:, lag % size]
    else:
        for k, lag in enumerate(range(-lags, lags + 1)):
            if abs(lag) < n:
                x, y = (a[:, lag:], b[:, : n - lag]) if lag >= 0 else (a[:, : n + lag], b[:, -lag:])
                out[:, k] = np.einsum("ij,ij->i", x, y)
    return out / np.where(norm > 0, norm, 1)[:, None]


def peak(cc: np.ndarray, allow_negative: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(lag, value) of the largest correlation, or of the largest absolute one; of equals (to twelve digits) the lag nearest 0, then the lower."""
    lags = cc.shape[1] // 2
    order = np.array(sorted(range(cc.shape[1]), key=lambda k: (abs(k - lags), k)))
    size = (np.abs(cc) if allow_negative else cc)[:, order]
    best = order[np.argmax(size >= size.max(1, keepdims=True) - 1e-12, axis=1)] if len(cc) else np.zeros(0, int)
    return best - lags, cc[np.arange(len(cc)), best]


class Matched:
    """Correlations, as `correlate` tells them, of every row of `a` with every row of `b`; rows of the shorter traces have zeros on both sides."""

    def __init__(self, a: np.ndarray, b: np.ndarray, lags: int):
        self.n, self.lags = max(a.shape[1], b.shape[1]), lags
        if not (a.shape[1] and b.shape[1]):
            return
        a, b = (np.pad(t, ((0, 0), ((self.n - t.shape[1]) // 2, self.n - t.shape[1] - (self.n - t.shape[1]) // 2))) for t in (a, b))
        self.a, self.b = (np.ascontiguousarray(t - t.mean(1, keepdims=True)) for t in (a, b))
        self.energy = [(t * t).sum(1) for t in (self.a, self.b)]
        if lags > 64:
            self.size = 1 << int(np.ceil(np.log2(max(2 * self.n, 2))))
            self.spectra = np.fft.rfft(self.a, self.size), np.conj(np.fft.rfft(self.b, self.size))

    def correlations(self, one: slice, two: slice) -> np.ndarray:
        """A matrix for each lag from -lags to lags."""
        a, b, n = self.a[one], self.b[two], self.n
        norm = np.sqrt(self.energy[0][one][:, None] * self.energy[1][two][None])
        scale = 1 / np.where(norm > 0, norm, 1)
        out = np.zeros((2 * self.lags + 1, len(a), len(b)))
        lags = np.arange(-min(self.lags, n - 1), min(self.lags, n - 1) + 1)
        if self.lags > 64:
            for i, row in enumerate(self.spectra[0][one]):
                some = max(1, SAMPLES // self.size)
                for at in range(0, len(b), some):
                    whole = np.fft.irfft(row * self.spectra[1][two][at : at + some], self.size)
                    out[lags + self.lags, i, at : at + some] = whole[:, lags % self.size].T
        else:
            for lag in lags:
                x, y = (a[:, lag:], b[:, : n - lag]) if lag >= 0 else (a[:, : n + lag], b[:, -lag:])
                np.matmul(x, y.T, out=out[lag + self.lags])
        out *= scale
        return out


def peak_of_lags(cc: np.ndarray, allow_negative: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """`peak` of correlations that have a matrix for each lag."""
    lags = len(cc) // 2
    order = sorted(range(len(cc)), key=lambda k: (abs(k - lags), k))
    size = np.abs(cc) if allow_negative else cc
    least = size.max(0) - 1e-12
    lag, value = np.zeros(least.shape, np.int32), cc[lags].copy()
    for k in reversed(order):
        best = size[k] >= least
        np.copyto(lag, k - lags, where=best, casting="unsafe")
        np.copyto(value, cc[k], where=best)
    return lag, value


def mad(cc: np.ndarray) -> np.ndarray:
    """Median absolute deviation of each row's values above 1e-5 in size, unscaled; 0 for a row without any."""
    own = np.abs(cc) > 1e-5
    n = own.sum(1)

    def median(values: np.ndarray) -> np.ndarray:
        held = np.sort(np.where(own, values, np.inf), axis=1)
        low, high = (np.take_along_axis(held, np.maximum(at, 0)[:, None], axis=1)[:, 0] for at in ((n - 1) // 2, n // 2))
        with np.errstate(invalid="ignore"):
            return np.where(n > 0, (low + high) / 2, 0.0)

    return median(np.abs(cc - median(cc)[:, None])) if cc.shape[1] else np.zeros(len(cc))


def sections(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections of a Butterworth band-pass, by the bilinear transform: rows b0 b1 b2 a0 a1 a2."""
    if not 0 < low < high < rate / 2:
        raise ValueError("0 < low < high < half of the sampling rate")
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    width, center = w2 - w1, np.sqrt(w1 * w2)
    angles = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    half = np.exp(1j * angles) * width / 2
    root = np.sqrt(half**2 - center**2 + 0j)
    poles = np.concatenate([half + root, half - root])
    z = (2 * rate + poles) / (2 * rate - poles)
    upper = z[np.imag(z) > 1e-12]
    real = np.sort(np.real(z[np.abs(np.imag(z)) <= 1e-12]))
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(p + q), p * q) for p, q in real.reshape(-1, 2)]
    out = np.array([[1, 0, -1, 1, a1, a2] for a1, a2 in pairs])
    at = np.exp(-1j * 2 * np.arctan(center / (2 * rate)))
    gain = np.prod([abs((b0 + b1 * at + b2 * at**2) / (1 + a1 * at + a2 * at**2)) for b0, b1, b2, _, a1, a2 in out])
    out[:, :3] /= gain ** (1 / len(out))
    return out


def high_sections(low: float, rate: float, order: int = 4) -> np.ndarray:
    """Sections of a Butterworth high-pass of even order, in the form of `sections`."""
    angles = np.pi * (2 * np.arange(1, order // 2 + 1) + order - 1) / (2 * order)
    poles = 2 * rate * np.tan(np.pi * low / rate) / np.exp(1j * angles)
    z = (2 * rate + poles) / (2 * rate - poles)
    out = np.array([[1, -2, 1, 1, -2 * p.real, abs(p) ** 2] for p in z])
    out[:, :3] *= ((1 - out[:, 4] + out[:, 5]) / 4)[:, None]
    return out


def band(low: float, high: float, rate: float) -> np.ndarray:
    """Sections for traces of a rate: a high-pass, if the upper corner isn't below half of the rate, and none at all, if the lower one isn't."""
    if low >= rate / 2:
        return np.zeros((0, 6))
    return high_sections(low, rate) if high >= rate / 2 * (1 - 1e-6) else sections(low, high, rate)


def lags_within(shift_s: float, rate: float) -> int:
    """Whole samples of a rate in a shift in seconds."""
    return int(shift_s / (1 / rate))


def filtered(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Rows passed through sections, from front to back; all rows take a sample together."""
    x = np.array(x, float)
    for b0, b1, b2, _, a1, a2 in sos:
        s1, s2 = np.zeros(len(x)), np.zeros(len(x))
        for i in range(x.shape[1]):
            v = x[:, i].copy()
            y = b0 * v + s1
            s1 = b1 * v - a1 * y + s2
            s2 = b2 * v - a2 * y
            x[:, i] = y
    return x


def taper(n: int, part: float = 0.05) -> np.ndarray:
    """Weights of a cosine taper over `part` of the trace at either end."""
    k = int(n * part)
    out = np.ones(n)
    if k:
        edge = 0.5 * (1 - np.cos(np.pi * np.arange(k) / k))
        out[:k], out[n - k :] = edge, edge[::-1]
    return out


def conditioned(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """Rows of one rate, demeaned, tapered and passed through a band, as they are correlated."""
    return filtered((x - x.mean(1, keepdims=True)) * taper(x.shape[1]), band(low, high, rate))


def envelope(x: np.ndarray, smooth: int = 1) -> np.ndarray:
    """Length of the analytic signal of each row, averaged over `smooth` samples."""
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    out = np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1))
    return np.apply_along_axis(lambda r: np.convolve(r, np.ones(smooth) / smooth, "same"), 1, out) if smooth > 1 else out


# ---- operators over DataFrames -----------------------------------------------


def _traces(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, float) for v in column.to_pylist()]


#: Samples, or lags, of traces that are correlated or filtered at a time, for bounded memory.
SAMPLES = 1 << 22


def correlated(pairs: DataFrame, a: str, b: str, lags: int | str, allow_negative: bool = False, with_mad: bool = False) -> DataFrame:
    """Adds lag_samples and cc (and cc_mad): the peak of the correlation of two trace columns; null if either trace is null or empty.

    `lags` holds for all rows, or names the column of each row's own; null lags give null as well.
    """
    pairs = pairs.drop("lag_samples", "cc", "cc_mad")
    names = pairs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema] + ["lag_samples int", "cc double"] + ["cc_mad double"] * with_mad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x, y = batch.column(a), batch.column(b)
                lag, value, spread = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x))
                lengths = [np.asarray(pa.compute.list_value_length(v).fill_null(0)) for v in (x, y)]
                reach = np.full(len(x), lags) if isinstance(lags, int) else np.asarray(batch.column(lags).fill_null(-1))
                ok = (lengths[0] > 0) & (lengths[1] > 0) & (reach >= 0)
                for m, n, k in {(int(m), int(n), int(k)) for m, n, k in zip(lengths[0][ok], lengths[1][ok], reach[ok], strict=True)}:
                    every = np.flatnonzero(ok & (lengths[0] == m) & (lengths[1] == n) & (reach == k))
                    width = max(m, n)
                    some = max(1, SAMPLES // max(width, 2 * k + 1))
                    for own in (every[i : i + some] for i in range(0, len(every), some)):
                        one, two = (v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1) for v in (x, y))
                        one, two = (np.pad(t, ((0, 0), ((width - t.shape[1]) // 2, width - t.shape[1] - (width - t.shape[1]) // 2))) for t in (one, two))
                        cc = correlate(one, two, k)
                        lag[own], value[own] = peak(cc, allow_negative)
                        if with_mad:
                            spread[own] = mad(cc)
                made = [pa.array(lag, mask=~ok), pa.array(value, mask=~ok)] + ([pa.array(spread, mask=~ok)] if with_mad else [])
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "lag_samples", "cc"] + ["cc_mad"] * with_mad)

    return pairs.mapInArrow(run, schema)


def bandpassed(df: DataFrame, column: str, low: float, high: float, rate: float, order: int = 4) -> DataFrame:
    """The traces of a column, demeaned, tapered and passed through a band."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sos = sections(low, high, rate, order)
        for batch in batches:
            rows = batch.column(column).to_pylist()
            made: list = [None] * len(rows)
            for n in {len(r) for r in rows if r}:
                own = [i for i, r in enumerate(rows) if r and len(r) == n]
                x = np.array([rows[i] for i in own], float)
                for i, y in zip(own, filtered((x - x.mean(1, keepdims=True)) * taper(n), sos), strict=True):
                    made[i] = y
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())) if c == column else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, schema)


def conditioned_traces(df: DataFrame, column: str, rate: str, low: float, high: float) -> DataFrame:
    """The traces of a column, each conditioned for correlation at the rate in column `rate`; null and empty ones, and those without a rate, stay."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(column)
            made: list = x.to_pylist()
            length = np.asarray(pa.compute.list_value_length(x).fill_null(0))
            rates = np.asarray(batch.column(rate).cast(pa.float64()).fill_null(0))
            ok = (length > 0) & (rates > 0)
            for n, hz in {(int(n), float(hz)) for n, hz in zip(length[ok], rates[ok], strict=True)}:
                every = np.flatnonzero(ok & (length == n) & (rates == hz))
                some = max(1, SAMPLES // n)
                for own in (every[i : i + some] for i in range(0, len(every), some)):
                    for i, y in zip(own, conditioned(np.array([made[i] for i in own], float), hz, low, high), strict=True):
                        made[i] = y
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())) if c == column else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, schema)


def mad_of(x: Column) -> Column:
    """Median absolute deviation of an array's values above 1e-5 in size."""

    def run(rows: pd.Series) -> pd.Series:
        values = [None if v is None else np.asarray(v, float) for v in rows]
        out = pd.Series([None] * len(values), dtype=float)
        for n in {len(v) for v in values if v is not None}:
            own = [i for i, v in enumerate(values) if v is not None and len(v) == n]
            out.iloc[own] = mad(np.array([values[i] for i in own]).reshape(len(own), n))
        return out

    return F.pandas_udf(run, "double")(x)
