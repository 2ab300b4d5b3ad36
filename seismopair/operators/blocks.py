"""All pairs of rows of one trace, by blocks: rows are dealt to blocks, and each two blocks of a trace meet in a task, so rows travel once for each block of their trace and no pair does."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from ..shared import small
from . import graph

#: Rows, and samples, of a block, about; pairs whose correlations are held at a time, over all lags.
ROWS, SAMPLES, HELD = 1024, 1 << 20, 1 << 18


def dealt(rows: DataFrame, data: str | None = None) -> DataFrame:
    """rows (evid, trace_id, ...) once for each two blocks that they meet in: _low and _high are the blocks, _own is the row's. Rows with a null evid or trace meet nothing.

    `data` names a column of arrays, whose size bounds the blocks too.
    """
    known = rows.where("evid is not null and trace_id is not null")
    size = F.lit(0) if data is None else F.coalesce(F.size(data), F.lit(0))
    counts = known.groupBy(F.col("trace_id").alias("_trace")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / ROWS, F.sum(size.cast("bigint")) / SAMPLES)).alias("_blocks"))
    own = known.join(small(counts), F.col("trace_id") == F.col("_trace")).withColumn("_own", F.pmod(F.xxhash64("evid"), "_blocks"))
    met = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    return met.withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other")}).drop("_trace", "_blocks", "_other")


def paired(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """evid1, evid2, trace_id of each two rows of a trace, evid1 the smaller; `carry` adds narrow columns with suffixes 1 and 2."""
    met = dealt(rows.select("evid", "trace_id", *carry))
    sides = [met.where(F.col("_own") == F.col(end)).select("trace_id", "_low", "_high", F.struct("evid", *carry).alias(side)) for end, side in (("_low", "_one"), ("_high", "_two"))]
    both = sides[0].join(sides[1], ["trace_id", "_low", "_high"])
    both = both.where((F.col("_one.evid") < F.col("_two.evid")) | ((F.col("_low") < F.col("_high")) & (F.col("_one.evid") > F.col("_two.evid"))))
    first = F.col("_one.evid") < F.col("_two.evid")
    told = [F.when(first, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")).alias(f"{c}{k}") for c in ("evid", *carry) for a, b, k in (("_one", "_two", 1), ("_two", "_one", 2))]
    return both.select(*told, "trace_id")


def correlated(traces: DataFrame, lags: int, allow_negative: bool = False, with_mad: bool = False, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """evid1, evid2, trace_id, lag_samples, cc (and cc_mad) of each two traces (evid, trace_id, data) of one trace_id, evid1 the smaller: as `signal.correlated`, by products of matrices.

    `keep` tells from arrays of cc and cc_mad which pairs are wanted, so that no other leaves the task; pairs without a result are not.
    """
    schema = "evid1 string, evid2 string, trace_id string, lag_samples int, cc double" + ", cc_mad double" * with_mad

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        trace, low, high = (group[c][0].as_py() for c in ("trace_id", "_low", "_high"))
        own = group["_own"].to_numpy()
        sides = [_by_length(group.filter(pa.array(own == k))) for k in ((low,) if low == high else (low, high))]
        for one, two in [(sides[0], sides[-1])] + ([(sides[1], sides[0])] if low < high else []):
            for a in one:
                for b in two:
                    yield from _met(trace, *a, *b, lags, allow_negative, with_mad, keep)

    # one by one, as the groups come from one exchange
    return dealt(traces.select("evid", "trace_id", F.col("data").cast("array<double>").alias("data")), "data").groupBy("trace_id", "_low", "_high").applyInArrow(run, schema)


def packed(traces: DataFrame, part: DataFrame, lags: int, allow_negative: bool = False) -> DataFrame:
    """Correlations in hundredths of each two traces of one trace_id whose events are in one component of part (id, component), as rows of `graph.packed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        low, high = (group[c][0].as_py() for c in ("_low", "_high"))
        own, component = group["_own"].to_numpy(), group["component"][0].as_py()
        sides = [_by_length(group.filter(pa.array(own == k))) for k in ((low,) if low == high else (low, high))]
        for one, two in [(sides[0], sides[-1])] + ([(sides[1], sides[0])] if low < high else []):
            for a in one:
                for b in two:
                    for names, others, i, j, _, cc, _ in _found(*a, *b, lags, allow_negative, False, None):
                        if cc is not None:
                            yield graph.packed(component, pa.array(names, pa.string()), pa.array(others, pa.string()), i, j, np.rint(cc * 100).astype(np.int64))

    own = traces.join(part.withColumnRenamed("id", "evid"), "evid").withColumn("trace_id", F.to_json(F.struct("component", "trace_id")))
    met = dealt(own.select("evid", "trace_id", "component", F.col("data").cast("array<double>").alias("data")), "data")
    return met.groupBy("trace_id", "_low", "_high").applyInArrow(run, graph._PACKED)


def _by_length(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Names in order and traces of each length; null traces have none."""
    names = rows["evid"].to_numpy(zero_copy_only=False) if rows.num_rows else np.array([], object)
    data = rows["data"].combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) and data.num_chunks else data
    length = np.asarray(pa.compute.list_value_length(data).fill_null(0)) if rows.num_rows else np.zeros(0, int)
    found = []
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        at = at[np.argsort(names[at], kind="stable")]
        x = data.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1) if n else np.zeros((len(at), 0))
        found.append((names[at], x))
    return found


def _met(trace: str, names: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, lags: int, allow_negative: bool, with_mad: bool, keep: Callable | None) -> Iterator[pa.RecordBatch]:
    """Pairs of a name and a larger one of `others`, both in order."""
    b = pa.array(others, pa.string())
    for own, _, i, j, lag, value, spread in _found(names, x, others, y, lags, allow_negative, with_mad, keep):
        made = [pa.nulls(len(i), pa.int32() if k == 0 else pa.float64()) if v is None else pa.array(v) for k, v in enumerate((lag, value, spread)[: 2 + with_mad])]
        name = pa.array(own, pa.string())
        yield pa.RecordBatch.from_arrays([name.take(pa.array(i)), b.take(pa.array(j)), pa.repeat(pa.scalar(trace, pa.string()), len(i)), *made], names=["evid1", "evid2", "trace_id", "lag_samples", "cc"] + ["cc_mad"] * with_mad)


def _found(names: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, lags: int, allow_negative: bool, with_mad: bool, keep: Callable | None) -> Iterator[tuple]:
    """Some names, all others, and of pairs of these their places, lags, correlations and spreads; the last three are None without a result."""
    empty = not (x.shape[1] and y.shape[1])
    if empty and keep is not None:
        return
    a = signal.Matched(x, y, lags)
    some = max(1, HELD // ((2 * lags + 1) * max(1, len(others))))
    for at in range(0, len(names), some):
        own = names[at : at + some]
        first = int(np.searchsorted(others, own[0], side="right"))
        if first == len(others):
            break
        # of each row the place of its first larger name
        starts = np.searchsorted(others, own, side="right") - first
        wanted = np.arange(len(others) - first) >= starts[:, None]
        lag = value = spread = None
        if not empty:
            cc = a.correlations(slice(at, at + some), slice(first, None))
            lag, value = signal.peak_of_lags(cc, allow_negative)
            spread = signal.mad(cc.reshape(len(cc), -1).T).reshape(value.shape) if with_mad else value
            if keep is not None:
                wanted &= keep(np.where(wanted, value, np.nan), spread)
        i, j = np.nonzero(wanted)
        if len(i):
            yield own, others, i, j + first, *(None if v is None else v[i, j] for v in (lag, value, spread))
