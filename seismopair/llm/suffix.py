"""Removal of long repeated substrings, across all documents, by suffix order.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document of smaller key.

All strings of LENGTH bytes are dealt to partitions so that equal ones meet: each belongs to the least hash of the 20-byte
strings inside it, and a run of neighbours with the same least hash travels as one segment. First only these hashes
travel, and segments follow for those that occur again, in another document. Each partition builds the
Burrows-Wheeler transform and common prefixes of its segments column by column (bwt.py); strings of LENGTH
bytes are equal where no prefix between their rows is shorter. What comes back for each segment is, for each of
its strings, the first document that has it.

Texts travel as compressed blocks of many documents, so that rows are few however small the documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, common

LENGTH = 50
SEED = 20
WINDOW = LENGTH - SEED + 1
#: Bytes of text in a block, seed hashes in a partition of the first exchange, segments in one of the second, about;
#: a partition holds collections that are small enough for a processor's cache.
BLOCK_BYTES, HASHES, SEGMENTS, COLLECTIONS = 1 << 20, 1 << 20, 64_000, 32
#: Bytes of a letter of the strings that are sorted.
SPAN = 5
#: Positions of a text that are looked at together, for bounded memory whatever its length.
PIECE = 1 << 20
#: A hash with more segments than this is dealt by its single strings.
HOT = 20_000
#: From this count on a block tells how many segments a hash has in four bytes more.
ESCAPE = 127
#: Parquet options for rows of a megabyte: look at a page's size often, and seek no repeated values.
_WIDE = {"parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "2", "parquet.block.size.row.check.min": "8", "parquet.block.size": str(16 << 20), "compression": "none"}
_NONE = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 40) - 1)
_SPREAD = np.uint64(0x9FB21C651E98DF25)


def blocks(docs: DataFrame, key: str, text: str, others: list[str]) -> DataFrame:
    """(block, keys, sizes, body, rest): documents on end, compressed, and their columns `others`, in rest by their places.

    A null key becomes the largest, which is no source and loses nothing.
    """
    places = [f"c{i}" for i in range(len(others))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in common.pieces(batches, "_text", BLOCK_BYTES):
            body, starts = common.flat(batch.column("_text"))
            keys = batch.column("_key").fill_null(_NONE).to_numpy(zero_copy_only=False).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([np.diff(starts).astype("<i8").tobytes()]), pa.array([pack(body.tobytes())]), pa.array([_frozen(batch.select(places))], pa.binary()), pa.array([len(body)], pa.int64())], names=["keys", "sizes", "body", "rest", "n_bytes"])

    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"), *(F.col(f"`{c}`").alias(p) for c, p in zip(others, places, strict=True)))
    made = common.small_batches(rows).mapInArrow(run, "keys binary, sizes binary, body binary, rest binary, n_bytes bigint")
    return common.stage(made.withColumn("block", F.monotonically_increasing_id()), "blocks", **_WIDE)


def _frozen(batch: pa.RecordBatch) -> bytes | None:
    if not batch.num_columns:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Block:
    """The documents of a block, and the segments of their strings."""

    def __init__(self, keys: bytes, sizes: bytes, body: bytes):
        import zstandard

        self.keys = np.frombuffer(keys, "<i8")
        sizes = np.frombuffer(sizes, "<i8")
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.body = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(self.starts[-1]))), np.uint8)
        # begin, count (strings), hash and content hash of each segment, in order; a long text is gone through piece by piece
        last = max(len(self.body) - LENGTH + 1, 0)
        parts = [self.runs(at, min(at + PIECE, last)) for at in range(0, last, PIECE)]
        self.begin, self.count, self.hash, self.content = (np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate((np.int64, np.int64, np.uint64, np.uint64)))
        self.doc = np.searchsorted(self.starts, self.begin, side="right") - 1

    def runs(self, first: int, last: int) -> tuple[np.ndarray, ...]:
        """begin, count, hash and content of the segments of the strings that start from `first` up to `last`."""
        m = last - first
        body = self.body[first : last + LENGTH - 1]
        n = len(body)
        up, down = common._power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        low = sums[SEED:] - sums[:-SEED]
        low *= down[: n - SEED + 1]
        low *= _SPREAD
        low ^= low >> np.uint64(32)
        size = 1
        while 2 * size <= WINDOW:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:m], low[WINDOW - size : WINDOW - size + m])
        valid = np.ones(m, bool)
        inner = self.starts[np.searchsorted(self.starts, first, side="right") : np.searchsorted(self.starts, last + LENGTH)] - first
        for back in range(1, LENGTH):  # strings that would cross into the next document
            at = inner - back
            valid[at[(at >= 0) & (at < m)]] = False
        valid &= np.arange(first, last) + LENGTH <= len(self.body)
        change = np.ones(m + 1, bool)
        change[1:m] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
        edge = np.flatnonzero(change)
        begin, end = edge[:-1], edge[1:]
        inside = valid[begin]
        begin, end = begin[inside], end[inside]
        parts = -(-(end - begin) // WINDOW)  # long runs of one hash, as in periodic text, are cut
        index = np.repeat(np.arange(len(begin)), parts)
        nth = np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = begin[index] + nth * WINDOW
        count = np.minimum(end[index] - start, WINDOW)
        content = common.mix((sums[start + count + LENGTH - 1] - sums[start]) * down[start] + count.astype(np.uint64))
        return start + first, count, common.mix(low[start] + np.uint64(0xA5A5)), content

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, how often each one's segment differs from the one before, with 1 for the first, and whether it is in two documents."""
        order = np.argsort(self.hash)
        h, c, keys = self.hash[order], self.content[order], self.keys[self.doc[order]]
        head = np.append(True, h[1:] != h[:-1])[: len(h)]
        at = np.flatnonzero(head)
        fresh = head | np.append(True, c[1:] != c[:-1])[: len(h)]
        if not len(at):
            return h, np.zeros(0, np.int64), np.zeros(0, bool)
        return h[at], np.add.reduceat(fresh.astype(np.int64), at), np.minimum.reduceat(keys, at) != np.maximum.reduceat(keys, at)

    def alone(self, at: np.ndarray) -> np.ndarray:
        """Content hashes of the single strings that start there."""
        total = np.zeros(len(at), np.uint64)
        for k, power in enumerate(common._power(LENGTH)[0]):
            total += (self.body[at + k].astype(np.uint64) + np.uint64(1)) * power
        return common.mix(total + np.uint64(1))

    def segments(self, again: np.ndarray, hot: np.ndarray, partitions: int) -> tuple[np.ndarray, ...]:
        """(partition, begin, count, doc, content) of the segments that are marked, by partition and content; of those marked as hot each string is one."""
        plain, single = np.flatnonzero(again & ~hot), np.flatnonzero(again & hot)
        index = np.repeat(single, self.count[single])
        nth = np.arange(len(index)) - np.repeat(np.cumsum(self.count[single]) - self.count[single], self.count[single])
        begin = np.concatenate([self.begin[plain], self.begin[index] + nth])
        count = np.concatenate([self.count[plain], np.ones(len(index), np.int64)])
        doc = np.concatenate([self.doc[plain], self.doc[index]])
        alone = self.alone(begin[len(plain) :])
        content = np.concatenate([self.content[plain], alone])
        dealt = np.concatenate([self.hash[plain], alone])
        partition = ((common.mix(dealt + np.uint64(77)) >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((begin, content, partition))
        return tuple(x[order] for x in (partition, begin, count, doc, content))


def _distinct(partition: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Heads of equal content in one partition."""
    return np.append(True, (partition[1:] != partition[:-1]) | (content[1:] != content[:-1]))[: len(content)]


def _cuts(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """The bytes of values[edge[i]:edge[i + 1]] for each i."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * values.itemsize * int(np.prod(values.shape[1:]))).astype("<i4")), pa.py_buffer(values)])


def _hashed(partitions: int) -> Callable:
    """A row for each block and partition: hashes, five bytes each, and what `Block.hashes` tells of each, in a byte; counts that it can't hold follow whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, keys, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "sizes", "body")), strict=True):
                value, count, shared = Block(keys, sizes, body).hashes()
                part = ((value >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
                some, edge = np.unique(part, return_index=True)
                edge = np.append(edge, len(part))
                low = (value & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                large = np.flatnonzero(count >= ESCAPE)
                many = np.minimum(count, ESCAPE).astype(np.uint8) * 2 + shared
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at)), pa.array(some), _cuts(low, edge), _cuts(many.astype(np.uint8), edge), _cuts(count[large].astype("<u4"), np.searchsorted(large, edge))], names=["block", "part", "hashes", "many", "more"])

    return run


def _repeated(hot: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        blobs = [np.frombuffer(b, np.uint8).reshape(-1, 5) for b in group["hashes"].to_pylist()]
        sizes = [len(b) for b in blobs]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :5] = np.concatenate(blobs)
        value = wide.view("<u8").ravel()
        many = np.frombuffer(b"".join(group["many"].to_pylist()), np.uint8)
        count = (many >> 1).astype(np.int64)
        count[count == ESCAPE] = np.frombuffer(b"".join(group["more"].to_pylist()), "<u4")
        order = np.argsort(value, kind="stable")
        head = np.flatnonzero(np.append(True, value[order][1:] != value[order][:-1])[: len(value)])
        times = np.diff(np.append(head, len(value)))
        total = np.add.reduceat(count[order], head)
        again = (times > 1) | (np.bitwise_or.reduceat(many[order] & 1, head) > 0)
        mark = np.zeros(len(value), np.uint8)
        mark[order] = np.repeat(again + 2 * (again & (total > hot)), times)
        cut = np.cumsum([0, *sizes])
        parts = [mark[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        keep = [i for i, p in enumerate(parts) if p.any()]
        pick = lambda c: group[c].take(pa.array(keep, pa.int64()))
        return pa.table({"block": pick("block"), "part": pick("part"), "again": pa.array([np.packbits(parts[i] & 1).tobytes() for i in keep], pa.binary()), "hot": pa.array([np.packbits(parts[i] >> 1).tobytes() for i in keep], pa.binary()), "n": pa.array([int((parts[i] & 1).sum()) for i in keep], pa.int64())})

    return run


def _marked(block: Block, marks: list[tuple[int, bytes, bytes]], first: int, second: int) -> tuple[np.ndarray, ...]:
    """The segments of a block, from the marks (part, again, hot) of its hashes."""
    value, which = np.unique(block.hash, return_inverse=True)
    part = ((value >> np.uint64(32)) * np.uint64(first) >> np.uint64(32)).astype(np.int64)
    again, hot = np.zeros(len(value), bool), np.zeros(len(value), bool)
    for p, a, h in marks:
        low, high = np.searchsorted(part, [p, p + 1])
        again[low:high] = np.unpackbits(np.frombuffer(a, np.uint8), count=high - low)
        hot[low:high] = np.unpackbits(np.frombuffer(h, np.uint8), count=high - low)
    return block.segments(again[which], hot[which], second)


def _sent(first: int, second: int) -> Callable:
    """A row for each block and partition: its distinct segments, with the least key of each."""
    kinds = {"block": pa.int64(), "part": pa.int64(), "sets": pa.binary(), "sizes": pa.binary(), "body": pa.binary(), "keys": pa.binary()}

    def run(block: pa.Table, marks: pa.Table) -> pa.Table:
        if block.num_rows and marks.num_rows:
            row = block.to_pylist()[0]
            own = Block(row["keys"], row["sizes"], row["body"])
            partition, begin, count, doc, content = _marked(own, [(m["part"], m["again"], m["hot"]) for m in marks.to_pylist()], first, second * COLLECTIONS)
            if len(partition):
                head = np.flatnonzero(_distinct(partition, content))
                least = np.minimum.reduceat(own.keys[doc], head)
                partition, begin, size = partition[head], begin[head], count[head] + LENGTH - 1
                some, edge = np.unique(partition // COLLECTIONS, return_index=True)
                edge = np.append(edge, len(size))
                to = np.cumsum(np.append(0, size))
                body = own.body[np.repeat(begin - to[:-1], size) + np.arange(to[-1])]
                made = [pa.array(np.full(len(some), row["block"])), pa.array(some), _cuts((partition % COLLECTIONS).astype(np.uint8), edge), _cuts(size.astype(np.uint8), edge), _cuts(body, to[edge]), _cuts(least.astype("<i8"), edge)]
                return pa.table(made, names=list(kinds))
        return pa.table({k: pa.array([], t) for k, t in kinds.items()})

    return run


def lettered(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, starts of strings, segment and shift of each string): a segment as SPAN strings of letters of SPAN bytes, from each of its first bytes on.

    A string of LENGTH bytes is then LENGTH / SPAN letters of one of them, and rounds are SPAN times fewer.
    """
    n = len(data) - SPAN + 1
    gram = np.zeros(max(n, 0), np.uint64)
    for k in range(SPAN):
        gram |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    _, letter = np.unique(gram, return_inverse=True, sorted=True)
    count = np.maximum((np.diff(starts)[:, None] - np.arange(SPAN)[None]) // SPAN, 0).ravel()
    segment, shift = np.divmod(np.arange(len(count)), SPAN)
    to = np.concatenate([[0], np.cumsum(count)])
    nth = np.arange(to[-1]) - np.repeat(to[:-1], count)
    return letter[np.repeat(starts[segment] + shift, count) + SPAN * nth], to, segment, shift


def first_keys(data: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes of each segment, on end, the least key of a segment that has it, from transform and prefixes."""
    letters, to, segment, shift = lettered(data, starts)
    most = LENGTH // SPAN
    _, prefix, string, length = bwt.build(letters, to, most)
    counts = np.maximum(np.diff(starts) - LENGTH + 1, 0)
    offset = np.cumsum(counts) - counts
    whole = length >= most
    group = np.cumsum(prefix < most)[whole]
    out = np.full(int(counts.sum()), _NONE)
    if not whole.any():
        return out
    string = string[whole].astype(np.int64)
    own = segment[string]
    at = offset[own] + shift[string] + SPAN * (np.diff(to)[string] - length[whole])
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    out[at] = np.repeat(np.minimum.reduceat(keys[own], head), np.diff(np.append(head, len(group))))
    return out


def _judged(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    known: dict[bytes, int] = {}
    keys, names, sets = [], [], []
    for row in rows:
        cut = np.cumsum(np.append(0, np.frombuffer(row["sizes"], np.uint8).astype(np.int64))).tolist()
        least, body = np.frombuffer(row["keys"], "<i8").tolist(), row["body"]
        own = np.empty(len(least), np.int64)
        for i, k in enumerate(least):
            part = body[cut[i] : cut[i + 1]]
            at = known.setdefault(part, len(known))
            if at == len(keys):
                keys.append(k)
                sets.append(row["sets"][i])
            elif k < keys[at]:
                keys[at] = k
            own[i] = at
        names.append(own)
    segments, least, own_set = list(known), np.array(keys, np.int64), np.array(sets)
    counts = np.array([len(x) for x in segments]) - LENGTH + 1
    offset = np.cumsum(counts) - counts
    first = np.empty(int(counts.sum()), np.int64)
    for k in np.unique(own_set):  # equal strings are in one collection
        own = np.flatnonzero(own_set == k)
        parts = [segments[i] for i in own.tolist()]
        n = counts[own]
        index = np.repeat(offset[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        first[index] = first_keys(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), least[own])
    runs, values = [], []
    for own in names:
        n = counts[own]
        index = np.repeat(offset[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        value = first[index]
        change = np.append(True, value[1:] != value[:-1])
        change[np.arange(0, len(value), 200)] = True  # a run's length fits a byte
        at = np.flatnonzero(change)
        runs.append(np.diff(np.append(at, len(value))).astype(np.uint8).tobytes())
        values.append(value[at].astype("<i8").tobytes())
    common.give_back()
    return pa.table({"block": group["block"], "part": group["part"], "again": pa.array(runs, pa.binary()), "hot": pa.array(values, pa.binary())})


def _covered(block: Block, marks: list[dict], first: int, second: int) -> np.ndarray:
    """Which bytes of a block go."""
    gone = np.zeros(len(block.body), bool)
    own = [(m["part"], m["again"], m["hot"]) for m in marks if not m["judged"]]
    partition, begin, count, doc, content = _marked(block, own, first, second * COLLECTIONS) if own else [np.zeros(0, np.int64)] * 5
    if len(partition):
        answers = {m["part"]: (np.frombuffer(m["hot"], "<i8"), np.frombuffer(m["again"], np.uint8)) for m in marks if m["judged"]}
        value = np.concatenate([np.repeat(*answers[p]) for p in np.unique(partition // COLLECTIONS).tolist()])
        head = _distinct(partition, content)
        which = np.cumsum(head) - 1
        unique = count[head]
        offset = np.cumsum(unique) - unique
        for at in range(0, len(count), PIECE // WINDOW):  # segments at a time, for bounded memory
            part = slice(at, at + PIECE // WINDOW)
            size = count[part]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            mine = block.keys[np.repeat(doc[part], size)]
            lost = (value[np.repeat(offset[which[part]], size) + nth] < mine) & (mine != _NONE)
            gone[(np.repeat(begin[part], size) + nth)[lost]] = True
    # so far a byte is marked if a string that goes starts there: its whole string goes
    size = 1
    while size < LENGTH:
        step = min(size, LENGTH - size)
        gone[step:] |= gone[:-step].copy()
        size += step
    return gone


def _cleaned(first: int, second: int, places: list[str], with_text: bool) -> Callable:
    made = {"_key": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if with_text else {})

    def run(block: pa.Table, marks: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in made}
        rest = []
        for row in block.to_pylist():
            own = Block(row["keys"], row["sizes"], row["body"])
            gone = _covered(own, marks.to_pylist(), first, second)
            rise = gone & ~np.append(False, gone[:-1])
            inner = own.starts[(own.starts > 0) & (own.starts < len(gone))]
            rise[inner] = gone[inner]
            for k, a, b in zip(own.keys.tolist(), own.starts[:-1].tolist(), own.starts[1:].tolist(), strict=True):
                left = own.body[a:b][~gone[a:b]].tobytes()
                for column, v in zip(out.values(), (None if k == _NONE else k, b - a, int(gone[a:b].sum()), int(rise[a:b].sum()), hashlib.sha256(left).hexdigest(), left), strict=False):
                    column.append(v)
            if row["rest"] is not None:
                rest.append(pa.ipc.open_stream(row["rest"]).read_all())
        table = pa.table({n: pa.array(v, made[n]) for n, v in out.items()})
        if places and rest:
            whole = pa.concat_tables(rest)
            for name in places:
                table = table.append_column(name, whole[name])
        return table

    return run


_NEW = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _removed(docs: DataFrame, key: str, text: str, with_text: bool) -> tuple[DataFrame, list[str]]:
    """(_key, the new columns, other columns as c0, c1 and so on; names of the other columns)."""
    others = [c for c in docs.columns if c not in (key, text)] if with_text else []
    table = blocks(docs, key, text, others)
    size = table.agg(F.sum("n_bytes")).first()[0] or 0
    first = max(1, -(-size // (HASHES * 14)))  # a hash stands for about 14 bytes
    hashed = table.drop("rest").mapInArrow(_hashed(first), "block bigint, part bigint, hashes binary, many binary, more binary")
    marks = common.stage(hashed.groupBy("part").applyInArrow(_repeated(HOT), "block bigint, part bigint, again binary, hot binary, n bigint"), "marks")
    second = max(1, -(-(marks.agg(F.sum("n")).first()[0] or 0) // SEGMENTS))
    given = marks.select("block", "part", "again", "hot", F.lit(False).alias("judged"))
    sent = table.drop("rest").groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_sent(first, second), "block bigint, part bigint, sets binary, sizes binary, body binary, keys binary")
    judged = common.stage(sent.groupBy("part").applyInArrow(_judged, "block bigint, part bigint, again binary, hot binary").withColumn("judged", F.lit(True)), "judged")
    places = [f"c{i}" for i in range(len(others))]
    kinds = "_key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text + "".join(f", {p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(places, others, strict=True))
    both = given.unionByName(judged)
    out = table.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_cleaned(first, second, places, with_text), kinds)
    return out.withColumn("_key", F.col("_key").cast(docs.schema[key].dataType)), others


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256; if asked for, also kept (binary, the bytes that stay) and the other columns.

    A null or empty text has no bytes. Documents of one key don't count as sources for one another, and a null key
    neither gives nor loses anything. Texts shorter than LENGTH stay whole; longer ones are read whole, whatever their length. Keys are
    integers below 2^63 - 1. An empty table gives none. Columns of docs with the names of new ones are left out.

    What passes through the transform are not whole documents but the distinct segments (of up to 80 bytes) around hashes that occur in
    two documents or more: equal segments are merged by their bytes before, and those of other hashes can't repeat.
    """
    out, others = _removed(docs, key, text, with_text)
    new = [c for c in _NEW if c in out.columns]
    return out.select(F.col("_key").alias(key), *new, *(F.col(f"c{i}").alias(c) for i, c in enumerate(others) if c not in new))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the bytes that stay as their texts (empty, if null); what is left of a character cut in two goes too. All other columns stay as they are, whatever their names."""
    out, others = _removed(docs, key, text, True)
    # a cast doesn't look at the bytes, so the check is a function of its own
    whole = F.col("kept").cast("string")
    made = {key: F.col("_key"), text: F.when(F.is_valid_utf8(whole), whole).otherwise(F.regexp_replace(F.make_valid_utf8(whole), "\ufffd", ""))} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    return out.select(*(made[c].alias(c) for c in docs.columns))
