"""Identifiers and texts of events and traces, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def base26(n: Column, width: int = 6) -> Column:
    """A number in base 26, digits a to z, padded on the left."""
    digits = [F.element_at(F.array(*(F.lit(c) for c in LETTERS)), (F.pmod(F.floor(n / 26**k), F.lit(26)) + 1).cast("int")) for k in reversed(range(width))]
    return F.concat(*digits)


def generate_evid(t: Column) -> Column:
    """reqk, the year, and six letters for the place within 366 days, as a share of all that six letters can tell."""
    start = F.make_timestamp(F.year(t), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    micros = F.unix_micros(t) - F.unix_micros(start)
    value = F.floor(micros / 1e6 / (366 * 86400.0) * (26**6 - 1)).cast("bigint")
    return F.concat(F.lit("reqk"), F.year(t).cast("string"), base26(value))


def fdsn_line(**c: Column) -> Column:
    """One catalog line of 13 fields; the time is cut to seconds and a missing value is printed as None."""
    names = ("evid", "orig_time", "lat", "lon", "depth_km", "author", "catalog", "contributor", "contributor_id", "mag_type", "mag", "mag_author", "location_name")
    parts = [F.date_format(c[n], "yyyy-MM-dd'T'HH:mm:ss") if n == "orig_time" else c[n].cast("string") for n in names]
    return F.concat_ws("|", *(F.coalesce(p, F.lit("None")) for p in parts))


def trace_part(trace_id: Column, part: str) -> Column:
    """net, sta, loc or chan of NET.STA.LOC.CHAN; an empty network is @@."""
    at = ("net", "sta", "loc", "chan").index(part)
    value = F.try_element_at(F.split(trace_id, r"\."), F.lit(at + 1))
    return F.when(value == "", "@@").otherwise(value) if part == "net" else value


def clean_trace_id(net: Column, sta: Column, loc: Column, chan: Column) -> Column:
    """A trace id whose parts have no dots of their own."""
    return F.concat_ws(".", *(F.translate(F.coalesce(x, F.lit("")), ".", "_") for x in (net, sta, loc, chan)))


def evid_from_uri(uri: Column) -> Column:
    """The event's own id inside a resource identifier: what follows the last =, or else the last / ; a query's other terms go."""
    tail = F.element_at(F.split(uri, "/"), -1)
    query = F.regexp_extract(tail, r"(?:^|[?&])(?:eventid|evid|id)=([^&]+)", 1)
    return F.when(query != "", query).when(tail.contains("="), F.element_at(F.split(F.element_at(F.split(tail, "&"), -1), "="), -1)).otherwise(F.element_at(F.split(tail, r"\?"), 1))


def cache_name(evid: Column, trace_id: Column, start: Column, end: Column) -> Column:
    """File name of a stored waveform."""
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    return F.concat(F.concat_ws("__", evid, trace_id, stamp(start), stamp(end)), F.lit(".mseed"))


def truncated(text: Column, width: int = 40) -> Column:
    """At most `width` characters, the last an ellipsis if something is cut."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)
