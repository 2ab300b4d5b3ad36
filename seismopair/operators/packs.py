"""The last row of each key, where rows travel many to a blob: tasks pack what they read by buckets of keys, and a bucket's blobs meet in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes, that a task packs together; rows of a bucket, about; rows that leave a task at a time.
HELD, BYTES, BUCKET, OUT = 1 << 20, 1 << 27, 1 << 22, 1 << 16
_WHOLE = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}


def _codes(column: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each value, null among them, and how many there may be."""
    column = column if pa.types.is_dictionary(column.type) else column.dictionary_encode()
    n = len(column.dictionary)
    return column.indices.cast(pa.int64()).fill_null(n).to_numpy(zero_copy_only=False), n + 1


def _ranks(column: pa.Array) -> np.ndarray:
    """Whole numbers from 0 in the order of values: null first, nan last."""
    if pa.types.is_integer(column.type) and not column.null_count:
        v = column.to_numpy().astype(np.int64)
        low, high = (int(x) for x in (v.min(), v.max()))
        if high - low < 1 << 20:
            return v - low
    if pa.types.is_floating(column.type):
        told = np.unique(np.asarray(column.fill_null(0)), return_inverse=True)[1].reshape(-1) + 1
        told[np.asarray(column.is_null())] = 0
        return told
    if pa.types.is_dictionary(column.type):
        column = column.cast(column.type.value_type)
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1


def _last(rows: pa.RecordBatch, keys: tuple[str, ...], order: str) -> np.ndarray:
    """The places of the last row of each key by _batch and `order`, in order of keys."""
    key, size = np.zeros(rows.num_rows, np.int64), 1
    for c in keys:
        code, n = _codes(rows.column(c))
        if size * n >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
            size = len(key) + 1
        key, size = key * n + code, size * n
    rank = _ranks(rows.column(order))
    rank += rows.column("_batch").to_numpy().astype(np.int64) * (int(rank.max(initial=0)) + 1)
    n = int(rank.max(initial=0)) + 1
    by = np.argsort(key * n + rank) if size * n < 1 << 62 else np.lexsort((rank, key))
    key = key[by]
    return by[np.append(key[1:] != key[:-1], True)] if len(by) else by


def _narrow(column: pa.Array) -> pa.Array:
    """The same values in the fewest bytes: whole numbers in a lesser type, names by those that occur."""
    if pa.types.is_dictionary(column.type):
        own = column.indices.dictionary_encode()
        return pa.DictionaryArray.from_arrays(_narrow(own.indices), column.dictionary.take(own.dictionary))
    if not pa.types.is_signed_integer(column.type):
        return column
    low, high = (x.as_py() or 0 for x in pc.min_max(column).values())
    return column.cast(next(t for t, bits in ((pa.int8(), 7), (pa.int16(), 15), (pa.int32(), 31), (pa.int64(), 63)) if -(1 << bits) <= low and high < 1 << bits))


def _blob(rows: pa.RecordBatch) -> bytes:
    told = pa.RecordBatch.from_arrays([_narrow(c) for c in rows.columns], names=rows.schema.names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, told.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(told)
    return sink.getvalue().to_pybytes()


def _one(rows: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (x.combine_chunks() for x in rows.columns)], names=rows.column_names)


def last_rows(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Of rows with _batch (a small whole number) the last by _batch and `order` for each key, without _batch; nulls are equal as keys, and come first in order.

    Keys are names or whole numbers. A task keeps the last row of each key of what it reads, and packs these by bucket: some of the first key's values
    meet some of the second's there, so that rows of neighbouring pairs share their names, and neither a frequent name nor a repeated key makes a bucket large.
    """
    side = int(np.ceil(np.sqrt(rows.count() / BUCKET))) or 1
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    dealt = rows.withColumn("_bucket", (at(keys[0]) * side + at(keys[min(1, len(keys) - 1)])).cast("int"))
    names = [*rows.columns]
    whole = {c: _WHOLE[k] for c, k in rows.dtypes if k in _WHOLE}

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = pa.Table.from_batches(held)
        # names stand for their numbers from here on
        read = _one(pa.table([c.dictionary_encode() if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in (x.combine_chunks() for x in read.columns)], names=read.column_names))
        found = _last(read, keys, order)
        bucket = read.column("_bucket").to_numpy()[found]
        by = np.argsort(bucket.astype(np.uint16) if side < 256 else bucket, kind="stable")
        found, bucket = found[by], bucket[by]
        body = _one(pa.Table.from_batches([read]).select(names).take(pa.array(found)))
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        blobs = [_blob(body.slice(a, b - a)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(blobs, pa.binary())], names=["_bucket", "_blob"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held, n, size = [*held, batch], n + batch.num_rows, size + batch.nbytes
            if n >= HELD or size >= BYTES:
                yield from told(held)
                held, n, size = [], 0, 0
        if n:
            yield from told(held)

    def wide(name: str, column: pa.ChunkedArray) -> pa.Array:
        column = column.chunk(0)
        if pa.types.is_dictionary(column.type):
            return pa.DictionaryArray.from_arrays(column.indices.cast(pa.int32()), column.dictionary)
        return column.cast(whole[name]) if name in whole else column

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for blob in batch.column("_blob"):
                part = pa.ipc.open_stream(blob.as_buffer()).read_all()
                parts.append(pa.table([wide(c, part[c]) for c in names], names=names))
        met = _one(pa.concat_tables(parts).unify_dictionaries())
        parts.clear()
        found = _last(met, keys, order)
        out = pa.Table.from_batches([met]).drop_columns(["_batch"])
        for a in range(0, len(found), OUT):
            some = out.take(pa.array(found[a : a + OUT]))
            yield _one(pa.table([c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in some.columns], names=some.column_names))

    return dealt.mapInArrow(pack, "_bucket int, _blob binary").groupBy("_bucket").applyInArrow(meet, rows.drop("_batch").schema)
