"""MiniSEED records: a header of 48 bytes, blockettes 1000 and 1001, and samples as whole numbers, floats or Steim frames of differences."""

from __future__ import annotations

import struct
from datetime import datetime, timedelta

import numpy as np

#: Fixed values of the format: codes of encodings; the Steim-2 forms of a word as (code in its frame's first word, code inside the word, differences, bits).
INT16, INT32, FLOAT32, FLOAT64, STEIM1, STEIM2 = 1, 3, 4, 5, 10, 11
STEIM2_FORMS = ((1, None, 4, 8), (2, 1, 1, 30), (2, 2, 2, 15), (2, 3, 3, 10), (3, 0, 5, 6), (3, 1, 6, 5), (3, 2, 7, 4))
_PLAIN = {INT16: "i2", INT32: "i4", FLOAT32: "f4", FLOAT64: "f8"}


def _signed(words: np.ndarray, count: int, bits: int) -> np.ndarray:
    """(word, count) signed numbers of some bits, the last one in the lowest bits."""
    shift = np.array([bits * k for k in reversed(range(count))], np.uint32)
    value = (words[:, None] >> shift & np.uint32((1 << bits) - 1)).astype(np.int64)
    return np.where(value >= 1 << bits - 1, value - (1 << bits), value)


def _differences(words: np.ndarray, encoding: int) -> tuple[np.ndarray, int, int]:
    """Differences of a record's frames in order, and its first and last sample."""
    frames = words.reshape(-1, 16)
    codes = (frames[:, :1] >> np.arange(30, -2, -2, dtype=np.uint32) & np.uint32(3)).ravel()
    flat = frames.ravel()
    codes[::16] = 0
    codes[1:3] = 0
    forms = STEIM2_FORMS if encoding == STEIM2 else ((1, None, 4, 8), (2, None, 2, 16), (3, None, 1, 32))
    inner = flat >> np.uint32(30)
    which = [np.flatnonzero((codes == c) & (True if d is None else inner == d)) for c, d, _, _ in forms]
    size = np.zeros(len(flat), np.int64)
    for at, (_, _, n, _) in zip(which, forms, strict=True):
        size[at] = n
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int64)
    for at, (_, _, n, bits) in zip(which, forms, strict=True):
        if len(at):
            out[start[at][:, None] + np.arange(n)] = _signed(flat[at], n, bits)
    first, last = flat[1:3].astype(np.uint32).view(np.int32).tolist()
    return out, first, last


def _words(d: np.ndarray) -> list[tuple[int, int, int]]:
    """(differences, code, word) of each Steim-2 word, as many differences in a word as fit."""
    limits = [(n, c, i, bits) for c, i, n, bits in sorted(STEIM2_FORMS, key=lambda f: -f[2])]
    room = np.zeros(len(d), np.int64)  # bits that a difference takes
    for bits in (30, 15, 10, 8, 6, 5, 4):
        room[(d >= -(1 << bits - 1)) & (d < 1 << bits - 1)] = bits
    out, at, values = [], 0, d.tolist()
    while at < len(values):
        for n, code, inner, bits in limits:
            if at + n <= len(values) and room[at : at + n].max() <= bits:
                word = 0
                for v in values[at : at + n]:
                    word = word << bits | v & (1 << bits) - 1
                out.append((n, code, word if inner is None else inner << 30 | word))
                at += n
                break
    return out


def _rate(rate: float) -> tuple[int, int]:
    """Factor and multiplier of a sampling rate."""
    if rate >= 1 and rate == int(rate) and rate < 32768:
        return int(rate), 1
    if rate < 1 and abs(1 / rate - round(1 / rate)) < 1e-9 and 1 / rate < 32768:
        return -round(1 / rate), 1
    scale = min(32767, int(32767 / rate))
    return round(rate * scale), -scale


def encode(data: np.ndarray, rate: float, start: datetime, trace_id: str, length: int = 4096) -> bytes:
    """Records of a trace: Steim-2, of samples rounded to whole numbers and held within 32 bits, or plain 32-bit numbers where a difference is too large."""
    net, sta, loc, chan = (trace_id.split(".") + [""] * 4)[:4]
    x = np.rint(np.asarray(data, float)).clip(-(1 << 31), (1 << 31) - 1).astype(np.int64)
    d = np.diff(x, prepend=x[:1])
    plain = bool(len(d)) and bool(np.abs(d).max() >= 1 << 29)
    words = None if plain else _words(d)
    factor, multiplier = _rate(rate)
    room, out, at, word, number = length // 64 - 1, [], 0, 0, 1
    while at < len(x):
        if plain:
            n = min(len(x) - at, room * 16)
            body = x[at : at + n].astype(">i4").tobytes()
        else:
            frames, n = np.zeros((room, 16), np.uint32), 0
            for f in range(room):
                for w in range(3 if f == 0 else 1, 16):
                    if word < len(words):
                        count, code, value = words[word]
                        frames[f, 0] |= np.uint32(code << 30 - 2 * w)
                        frames[f, w] = value
                        word, n = word + 1, n + count
            frames[0, 1:3] = np.array([x[at], x[at + n - 1]]).astype(np.int32).view(np.uint32)
            body = frames.astype(">u4").tobytes()
        t = start + timedelta(seconds=at / rate)
        tenth, micro = divmod(t.microsecond, 100)
        text = f"{number:06d}D {sta[:5]:5}{loc[:2]:2}{chan[:3]:3}{net[:2]:2}".encode()
        head = text + struct.pack(">HHBBBBHHhhBBBBiHH", t.year, t.timetuple().tm_yday, t.hour, t.minute, t.second, 0, tenth, n, factor, multiplier, 0, 0, 0, 2, 0, 64, 48)
        head += struct.pack(">HHBBBB", 1000, 56, INT32 if plain else STEIM2, 1, length.bit_length() - 1, 0) + struct.pack(">HHBbBB", 1001, 0, 100, micro, 0, room)
        out.append((head + body).ljust(length, b"\0"))
        at, number = at + n, number + 1
    return b"".join(out)


def records(content: bytes) -> list[dict]:
    """trace_id, start, rate, data of each record; an error if the bytes are none."""
    at, out = 0, []
    while at + 48 <= len(content):
        if content[at + 6 : at + 7] not in (b"D", b"R", b"Q", b"M"):
            raise ValueError("no MiniSEED record")
        order = ">" if 1900 <= struct.unpack_from(">H", content, at + 20)[0] <= 2500 else "<"
        year, day, hour, minute, second, _, tenth, n, factor, multiplier, _, _, _, _, correction, offset, block = struct.unpack_from(f"{order}HHBBBBHHhhBBBBiHH", content, at + 20)
        micro, encoding, length, data_order = 0, None, 0, order
        while block:
            kind, following = struct.unpack_from(f"{order}HH", content, at + block)
            if kind == 1000:
                encoding, big, power = struct.unpack_from("BBB", content, at + block + 4)
                length, data_order = 1 << power, ">" if big else "<"
            elif kind == 1001:
                micro = struct.unpack_from("b", content, at + block + 5)[0]
            if following <= block:
                break
            block = following
        if encoding is None or at + length > len(content):
            raise ValueError("a record without a blockette 1000, or cut off")
        rate = abs(float(factor)) ** (1 if factor > 0 else -1) * abs(float(multiplier)) ** (1 if multiplier > 0 else -1) if factor and multiplier else 0.0
        if n and rate:
            body = content[at + offset : at + length]
            if encoding in _PLAIN:
                data = np.frombuffer(body, data_order + _PLAIN[encoding], n).astype(float)
            elif encoding in (STEIM1, STEIM2):
                d, first, last = _differences(np.frombuffer(body[: len(body) // 64 * 64], f"{data_order}u4").astype(np.uint32), encoding)
                if len(d) < n:
                    raise ValueError("samples are missing")
                data = (first + np.cumsum(np.append(0, d[1:n]))).astype(float)
                if data[-1] != last:
                    raise ValueError("the last sample isn't the one told")
            else:
                raise ValueError(f"encoding {encoding} isn't read")
            text = content[at + 8 : at + 20].decode("ascii", "replace")
            trace = ".".join(p.strip() for p in (text[10:12], text[0:5], text[5:7], text[7:10]))
            shift = 0 if content[at + 36] & 2 else correction * 100
            start = datetime(year, 1, 1) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second, microseconds=tenth * 100 + micro + shift)
            out.append({"trace_id": trace, "start": start, "rate": rate, "data": data})
        at += length
    return out


def decode(content: bytes) -> list[dict]:
    """trace_id, start, rate, data of each gapless stretch, by trace and time: records join where one begins within half a sample of the end of the last."""
    out: list[dict] = []
    for r in sorted(records(content), key=lambda r: (r["trace_id"], r["start"])):
        last = out[-1] if out else None
        if last is not None and (last["trace_id"], last["rate"]) == (r["trace_id"], r["rate"]) and abs((r["start"] - last["start"]).total_seconds() * r["rate"] - sum(map(len, last["data"]))) < 0.5:
            last["data"].append(r["data"])
        else:
            out.append(r | {"data": [r["data"]]})
    return [r | {"data": np.concatenate(r["data"])} for r in out]
