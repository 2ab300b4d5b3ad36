"""Settings of the pipelines, as a frozen dataclass that checks itself."""

from __future__ import annotations

import math
import re
from dataclasses import asdict, dataclass, fields, replace

SORT_KEYS = ("time", "longitude", "latitude", "depth", "distance_from")
CLUSTERINGS = ("connected", "shared", "UPGMA")
SLIP_MODELS = ("NJ1998", "B2001", "E1957")
_UNIT = {"s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "M": 30 * 86400.0, "y": 365 * 86400.0}


def duration_seconds(text: str | None, compat_hours: bool = False) -> float:
    """Seconds of a literal such as 90s, 15m, 1h, 30d, 2M or 1y; None is endless.

    `compat_hours` counts an hour as 24 minutes, for comparison with results made that way.
    """
    if text is None:
        return math.inf
    found = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([smhdMy])\s*", text)
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    unit = 1440.0 if compat_hours and found[2] == "h" else _UNIT[found[2]]
    return float(found[1]) * unit


@dataclass(frozen=True)
class Interval:
    """Bounds of one catalog request; None is open."""

    start: str | None = None
    end: str | None = None
    url: str | None = None


@dataclass(frozen=True)
class Config:
    """All settings with their defaults."""

    catalog_trace_ids: tuple[str, ...] = ()
    catalog_search_range: float | None = 10.0
    lat_min: float | None = None
    lat_max: float | None = None
    lon_min: float | None = None
    lon_max: float | None = None
    depth_min: float | None = None
    depth_max: float | None = None
    mag_min: float | None = None
    mag_max: float | None = None
    intervals: tuple[Interval, ...] = ()
    cc_pre_P: float = 5.0
    cc_trace_length: float = 60.0
    cc_freq_min: float = 2.0
    cc_freq_max: float = 10.0
    cc_max_shift: float = 3.0
    cc_allow_negative: bool = False
    cc_min: float = 0.9
    clustering_algorithm: str = "connected"
    sort_families_by: str = "time"
    distance_from_lon: float | None = None
    distance_from_lat: float | None = None
    minevents: int = 2
    longerthan: str | None = None
    shorterthan: str | None = None
    mag_to_slip_model: str = "NJ1998"
    static_stress_drop_MPa: float = 3.0
    rigidity_GPa: float = 30.0
    strain_hardening_MPa_cm: float = 0.5
    min_cc_mad_ratio: float = 8.0
    time_chunk_s: float = 3600.0
    time_chunk_overlap_s: float = 60.0
    retry_base_s: float = 60.0
    max_retries: int = 5
    cover_tolerance_s: float = 10.0

    def __post_init__(self):
        def check(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        check(self.clustering_algorithm in CLUSTERINGS, f"clustering_algorithm is one of {CLUSTERINGS}")
        check(self.sort_families_by in SORT_KEYS, f"sort_families_by is one of {SORT_KEYS}")
        check(self.mag_to_slip_model in SLIP_MODELS, f"mag_to_slip_model is one of {SLIP_MODELS}")
        check(self.sort_families_by != "distance_from" or None not in (self.distance_from_lon, self.distance_from_lat), "sorting by distance_from needs distance_from_lon and distance_from_lat")
        check(0 < self.cc_freq_min < self.cc_freq_max, "0 < cc_freq_min < cc_freq_max")
        check(-1 <= self.cc_min <= 1, "cc_min lies within -1 and 1")
        check(self.cc_trace_length > 0 and self.cc_max_shift >= 0 and self.cc_pre_P >= 0, "lengths of windows aren't negative")
        check(self.max_retries >= 0 and self.retry_base_s >= 0, "retry limits aren't negative")
        for a, b in (("lat_min", "lat_max"), ("lon_min", "lon_max"), ("depth_min", "depth_max"), ("mag_min", "mag_max")):
            low, high = getattr(self, a), getattr(self, b)
            check(low is None or high is None or low <= high, f"{a} exceeds {b}")
        for name in ("longerthan", "shorterthan"):
            if getattr(self, name) is not None:
                duration_seconds(getattr(self, name))

    @classmethod
    def known(cls) -> set[str]:
        return {f.name for f in fields(cls)}

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)


def intervals_of(settings: dict) -> tuple[Interval, ...]:
    """Intervals from numbered settings: catalog_start_time, catalog_end_time and catalog_url, then the same with _1, _2 and so on; a missing one of the three is open, or the first url."""
    out = []
    for n in range(100):
        end = f"_{n}" if n else ""
        start, stop, url = (settings.get(f"catalog_{k}{end}") for k in ("start_time", "end_time", "url"))
        if n and start is stop is url is None:
            break
        if not (start is stop is url is None):
            out.append(Interval(start, stop, url or settings.get("catalog_url")))
    return tuple(out)


def scope(cfg: Config, trace_ids: list[str] | None = None) -> tuple[str, ...]:
    """The traces that a command works on: those it was given, else those of the settings; each is NET.STA.LOC.CHAN."""
    found = tuple(trace_ids or cfg.catalog_trace_ids)
    for t in found:
        if t.count(".") != 3:
            raise ValueError(f"not NET.STA.LOC.CHAN: {t!r}")
    return found


#: Former names of settings.
RENAMED = {"catalog_trace_id": "catalog_trace_ids", "cc_freqmin": "cc_freq_min", "cc_freqmax": "cc_freq_max"}


def migrate(old: dict) -> tuple[Config, list[str]]:
    """Settings from an older set: known ones are carried over under their present names; the names of the others are returned."""
    kept, unknown = {}, []
    for name, value in old.items():
        name = RENAMED.get(name, name)
        if name in Config.known():
            kept[name] = tuple(value) if isinstance(value, list) else value
        else:
            unknown.append(name)
    return Config(**kept), unknown
