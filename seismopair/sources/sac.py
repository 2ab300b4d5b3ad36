"""SAC files: one evenly sampled trace each, a binary header of 632 bytes before 32-bit samples."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places in the header: floats from byte 0, whole numbers from 280, texts from 440 (8 bytes each, the second 16).
_FLOATS = {"delta": 0, "b": 5, "e": 6, "a": 8, "t0": 10, "evla": 35, "evlo": 36, "evdp": 38}
_WHOLES = {"nzyear": 0, "nzjday": 1, "nzhour": 2, "nzmin": 3, "nzsec": 4, "nzmsec": 5, "nvhdr": 6, "npts": 9, "iftype": 15, "leven": 35}
_TEXTS = {"kstnm": 0, "khole": 24, "kcmpnm": 160, "knetwk": 168}
_MISSING = -12345


def encode(data: np.ndarray, delta: float, start: datetime, trace_id: str, **more: float) -> bytes:
    """A trace with its network, station, location and channel, and further header values."""
    net, sta, loc, chan = (trace_id.split(".") + [""] * 4)[:4]
    values = {"delta": delta, "b": 0.0, "e": delta * max(len(data) - 1, 0), **more}
    floats, wholes = np.full(70, float(_MISSING), "<f4"), np.full(40, _MISSING, "<i4")
    for k, v in values.items():
        floats[_FLOATS[k]] = v
    for k, v in {"nzyear": start.year, "nzjday": start.timetuple().tm_yday, "nzhour": start.hour, "nzmin": start.minute, "nzsec": start.second, "nzmsec": start.microsecond // 1000, "nvhdr": 6, "npts": len(data), "iftype": 1, "leven": 1}.items():
        wholes[_WHOLES[k]] = v
    texts = bytearray(b"-12345  " * 24)
    for k, v in (("kstnm", sta), ("khole", loc), ("kcmpnm", chan), ("knetwk", net)):
        texts[_TEXTS[k] : _TEXTS[k] + 8] = v.encode()[:8].ljust(8)
    return floats.tobytes() + wholes.tobytes() + bytes(texts) + np.asarray(data, "<f4").tobytes()


def decode(content: bytes) -> dict:
    """trace_id, start, delta, data and the header values that are set."""
    if len(content) < 632:
        raise ValueError("too short for a SAC file")
    order = "<" if struct.unpack_from("<i", content, 280 + 4 * _WHOLES["nvhdr"])[0] in (6, 7) else ">"
    floats, wholes = np.frombuffer(content, f"{order}f4", 70), np.frombuffer(content, f"{order}i4", 40, 280)
    n = int(wholes[_WHOLES["npts"]])
    if len(content) < 632 + 4 * n:
        raise ValueError("samples are missing")
    text = {k: content[440 + at : 448 + at].decode("ascii", "replace").strip() for k, at in _TEXTS.items()}
    text = {k: "" if v == str(_MISSING) else v for k, v in text.items()}
    w = lambda k: int(wholes[_WHOLES[k]])
    start = datetime(w("nzyear"), 1, 1) + timedelta(days=w("nzjday") - 1, hours=w("nzhour"), minutes=w("nzmin"), seconds=w("nzsec"), milliseconds=w("nzmsec"))
    known = {k: float(floats[at]) for k, at in _FLOATS.items() if floats[at] != _MISSING}
    return {"trace_id": ".".join((text["knetwk"], text["kstnm"], text["khole"], text["kcmpnm"])), "start": start, "data": np.frombuffer(content, f"{order}f4", n, 632).astype(float), **known}


def write_templates(templates: DataFrame, folder: str, delta: float) -> int:
    """Export each template as template{family}.{trace}.sac on the driver's disk; rows stream, and their number is returned."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in templates.select("family_number", "trace_id", "lat", "lon", "depth_km", "p_offset_s", "data").toLocalIterator():
        content = encode(np.array(r["data"]), delta, datetime(1970, 1, 1), r["trace_id"], evla=r["lat"], evlo=r["lon"], evdp=r["depth_km"], a=r["p_offset_s"])
        with open(os.path.join(folder, f"template{r['family_number']:02d}.{r['trace_id']}.sac"), "wb") as f:
            f.write(content)
        n += 1
    return n


def read_templates(spark: SparkSession, folder: str, user_file: str | None = None) -> DataFrame:
    """Templates out of template{family}.{trace}.sac files under a folder: family_number, trace_id, delta, lat, lon, depth_km, p_offset_s, data; a user's own file gets the number after the largest.

    A file that isn't read is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = re.fullmatch(r"template(\d+)\..*\.sac", unquote(path.rsplit("/", 1)[-1]))
                try:
                    one = decode(content)
                except (ValueError, struct.error):
                    continue
                out.append((int(name[1]) if name else None, one["trace_id"], one.get("delta"), one.get("evla"), one.get("evlo"), one.get("evdp"), one.get("a"), one["data"]))
            kinds = (pa.int32(), pa.string(), *[pa.float64()] * 5, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["family_number", "trace_id", "delta", "lat", "lon", "depth_km", "p_offset_s", "data"])

    schema = "family_number int, trace_id string, delta double, lat double, lon double, depth_km double, p_offset_s double, data array<double>"
    read = lambda path: spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    own = read(f"{folder.rstrip('/')}/template*.sac").where("family_number is not null")
    if user_file is None:
        return own
    last = own.agg(F.coalesce(F.max("family_number"), F.lit(-1)).alias("_last"))  # one row
    more = read(user_file).crossJoin(F.broadcast(last)).withColumn("family_number", (F.col("_last") + 1).cast("int")).drop("_last")
    return own.unionByName(more)
