"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encoding maps byte strings into a monoid of token sequences: two encoded neighbours are joined by
encoding a window around their boundary anew, and the window grows until what stands outside it can
no longer change. Whether it can is decided exactly: a token sequence is the greedy encoding of its
bytes if and only if each two adjacent tokens x, y are the encoding of their own bytes, since the
merges that greedy encoding does inside one region, until a merge first crosses its border, are those
that it does on that region alone. So a join is final once the two pairs at the window's edges hold.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries, and bytes of keys, of a worker's memory of encoded matches, of which it holds twice as many at most; a longer key isn't remembered.
MEMORY, MEMORY_BYTES, LONGEST_KEY = 250_000, 8 << 20, 256
#: Up to so many bytes a string is encoded by the plain merge loop.
LEAF = 8
#: The rank of a pair that doesn't merge.
NEVER = 1 << 62


class Memo(dict):
    """A dictionary that computes what it lacks, of bounded size: what wasn't asked for of late goes first."""

    def __init__(self, compute, limit: int = MEMORY):
        super().__init__()
        self.compute, self.limit, self.before, self.room = compute, limit, {}, MEMORY_BYTES

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        size = len(key) if isinstance(key, (str, bytes)) else 16
        if size > LONGEST_KEY:
            return value
        self.room -= size
        if len(self) >= self.limit or self.room < 0:
            self.before = dict(self)
            self.clear()
            self.room = MEMORY_BYTES - size
        self[key] = value
        return value


_kept: dict[tuple, object] = {}


def kept(make, *of):
    """make(*of), one for each worker process, for all tasks that it runs; only the last one stays."""
    key = (make, *of)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make(*of)
    return _kept[key]


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class Codec:
    """Encoder and decoder for one table of ranks (token bytes to id, lower merges first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"ranks lack single bytes: {missing[:5]}")
        self.pairs = Memo(lambda xy: len(m := self.merge(self.bytes_of[xy[0]] + self.bytes_of[xy[1]])) == 2 and tuple(m) == xy)
        self.small = Memo(self._tree)
        self.windows = Memo(self.merge)

    def merge(self, data: bytes) -> list[int]:
        """The plain greedy encoding: again and again the adjacent pair of lowest rank merges, leftmost first."""
        ranks = self.ranks
        if data in ranks and len(data) == 1:
            return [ranks[data]]
        if len(data) > 48:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        get = ranks.get
        costs = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while costs:
            best = min(costs)
            if best == NEVER:
                break
            i = costs.index(best)
            merged = parts[i] = parts[i] + parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(merged + parts[i + 1], NEVER)
            if i:
                costs[i - 1] = get(parts[i - 1] + merged, NEVER)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """As merge, with a heap of candidate pairs over a linked list."""
        n, get = len(data), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        live = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not live[i] or after[i] >= n or end[after[i]] != to:
                continue
            j = after[i]
            live[j] = 0
            end[i], after[i] = to, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := get(data[before[i] : to])) is not None:
                heapq.heappush(heap, (r, before[i], to))
        return [self.ranks[data[i : end[i]]] for i in range(n) if live[i]]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of a and b on end, from their encodings."""
        if not a or not b:
            return a or b
        bytes_of, i, j = self.bytes_of, 1, 1
        while True:
            if i + j == 2 and self.pairs[a[-1], b[0]]:
                return a + b
            inner = self.windows[b"".join([bytes_of[t] for t in a[-i:] + b[:j]])]
            left = i >= len(a) or self.pairs[a[-i - 1], inner[0]]
            right = j >= len(b) or self.pairs[inner[-1], b[j]]
            if left and right:
                return a[: len(a) - i] + inner + b[j:]
            if not left:
                i = min(2 * i, len(a))
            if not right:
                j = min(2 * j, len(b))

    def _tree(self, data: bytes) -> list[int]:
        n = len(data)
        if n <= LEAF:
            return self.merge(data)
        half = 1 << (n - 1).bit_length() - 1
        return self.join(self._part(data[:half]), self._part(data[half:]))

    def _part(self, data: bytes) -> list[int]:
        return self.small[data] if len(data) <= 16 else self._tree(data)

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match: halves are encoded recursively and joined."""
        if not data:
            return []
        whole = self.ranks.get(data)  # by the library's rule a match that is a token is that token
        return [whole] if whole is not None else self._part(data)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up a tree."""
        parts = list(map(self.bytes_of.__getitem__, ids))
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 64]) for k in range(0, len(parts), 64)]
        return parts[0] if parts else b""


class Matches(Memo):
    """Ids, as bytes, of matches of the pattern."""

    def __init__(self, ranks: bytes):
        super().__init__(lambda match: np.array(self.codec.encode(match.encode()), "<u4").tobytes())
        self.codec = Codec(read_ranks(ranks))


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds array column `ids`: the ids of each match of `pattern` in the text, on end (null or empty text: no ids).

    The rows may hold other columns; one named as `ids` is replaced.
    """
    return _mapped(df, ranks, pattern, text, {ids: pa.list_(pa.uint32())})


def digests(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encoding, then decoding of the ids, as digests."""
    rows = df.select(F.col(key), F.col(text).alias("_text"))
    return _mapped(rows, ranks, pattern, "_text", {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}).drop("_text")


def _mapped(df: DataFrame, ranks: bytes, pattern: str, text: str, made: dict[str, pa.DataType]) -> DataFrame:
    df = df.drop(*made)
    names = {pa.int64(): "bigint", pa.string(): "string"}
    held = df.sparkSession.sparkContext.broadcast(ranks)  # the size of one vocabulary file
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{k} {names.get(v, 'array<bigint>')}" for k, v in made.items()])
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        packed = kept(Matches, held.value)
        codec = packed.codec
        find = regex.compile(pattern).findall
        for batch in common.pieces(batches, text):
            rows = []
            for value in batch.column(text).to_pylist():
                data = b"".join(map(packed.__getitem__, find(value or "")))
                ids = np.frombuffer(data, "<u4")
                if "ids_sha256" in made:
                    rows.append((len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(codec.decode(ids.tolist())).hexdigest()))
                else:
                    rows.append((ids.astype(np.int64),))
            old = [batch.column(c) for c in columns]
            new = [pa.array([r[i] for r in rows], pa.list_(pa.int64()) if t == pa.list_(pa.uint32()) else t) for i, t in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays(old + new, names=[*columns, *made])

    return common.small_batches(df).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds binary column `to`: the bytes of the ids (null: null). An id without bytes is an error."""
    df = df.drop(to)
    held = df.sparkSession.sparkContext.broadcast(ranks)
    columns = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{to} binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(Matches, held.value).codec
        for batch in batches:
            made = pa.array([None if v is None else codec.decode(v) for v in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [made], names=[*columns, to])

    return df.mapInArrow(run, schema)
