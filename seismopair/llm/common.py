"""What the corpus operators share: batching of Arrow texts, hashing of words, labelled samples."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import release, shared_dir, shared_path, stage

__all__ = ["release", "shared_dir", "shared_path", "stage"]

#: Bytes of text that a Python worker takes on at a time (a longer single text is taken on alone).
CHUNK_BYTES = 1 << 20
FOLDS = 5


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session is told to hand Python workers 2,000 rows at a time at most: 10,000 long texts are too many for a small worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > 2000:
        df.sparkSession.conf.set(name, "2000")
    return df


def held_out(key: str = "doc_id") -> Column:
    """Rows from which no label may be learnt: crc32 of the key as text, mod 5, is 0 (a null key: not held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece has about `limit` bytes in `column`; a longer row makes a piece alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on for other tasks beside a JVM that wants it too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values on end (null: empty), and where each value starts, with the end."""
    values = pc.fill_null(values, b"" if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else "")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


# ---- hashing of words ------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the value bears on every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    x ^= x >> np.uint64(27)
    x *= _MIX2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                run = np.full(size, base, np.uint64)
                run[0] = 1
                _powers[name] = np.cumprod(run, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def words(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts laid on end: (row of each word, 64-bit hash of each word).

    A word is a maximal run of ASCII letters, digits and non-ASCII characters within one text.
    """
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mask = _WORD[body]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    value = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return np.searchsorted(starts, begin, side="right") - 1, value


_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(16)], np.uint64)


def shingles(row: np.ndarray, word: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `size` words; a text of fewer words, but one at least, gives the run of all its words."""
    n = len(word)
    if not n:
        return row, word
    total = np.zeros(n, np.uint64)
    same = np.ones(n, bool)
    for k in range(size):
        if k:
            same = np.zeros(n, bool)
            same[: n - k] = row[k:] == row[: n - k]
        total[same] += word[k:][same[: n - k]] * _STEP[k] if k else word[same] * _STEP[0]
    head = np.ones(n, bool)
    head[1:] = row[1:] != row[:-1]
    keep = same | head
    # a head of a text with fewer words keeps its partial sum
    return row[keep], mix(total[keep])


# ---- labelled samples and calibration --------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most `per_class` rows of each of the classes 0 and 1, outside the held-out fold.

    The rows are those of smallest key hash among labelled ones with a text of 1 to `longest` characters, so that
    the sample doesn't depend on how rows are laid out. A key that is labelled twice counts once, by its larger label.
    """
    clean = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    fit = docs.where(F.length(text).between(1, longest)).select(F.col(key), F.col(text).alias("_text"))
    ranked = fit.select(key).join(clean, key).distinct().withColumn("_order", F.xxhash64(F.col(key), F.lit(17)))
    chosen = None
    for value in (0, 1):
        some = ranked.where(F.col("_label") == value).orderBy("_order", key).limit(per_class)
        chosen = some if chosen is None else chosen.unionAll(some)
    return fit.join(F.broadcast(chosen.select(key, "_label")), key)  # 2 * per_class small rows at most


def class_share(labels: DataFrame, label: str, key: str = "doc_id") -> float:
    """Part of label 1 among all labels outside the held-out fold; a half where there is none."""
    row = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).agg(F.avg(F.col(label).cast("double"))).first()
    return 0.5 if row[0] is None else float(row[0])


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last for the constant) of a logistic model, classes weighted to have the given share of label 1."""
    x = np.column_stack([x, np.ones(len(x))])
    n1, n = max(1, int(y.sum())), len(y)
    weight = np.where(y == 1, share * n / n1, (1 - share) * n / max(1, n - n1))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * np.append(beta[:-1], 0)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([ridge] * (len(beta) - 1) + [1e-6])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(df: DataFrame, text: str, score, threshold: float) -> DataFrame:
    """Adds score and predicted (columns of these names are replaced); `score` maps a pyarrow array of texts to scores and is made once a task by calling it."""
    df = df.drop("score", "predicted")
    columns = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for batch in pieces(batches, text):
            value = np.clip(of(batch.column(text)), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(value, pa.float64()), pa.array((value >= threshold).astype(np.int32), pa.int32())], names=[*columns, "score", "predicted"])

    return small_batches(df).mapInArrow(run, schema)


def filtered(df: DataFrame, text: str, score, test) -> DataFrame:
    """The rows of df whose score passes the test, with all their columns as they are; `score` as in scored, `test` maps scores to booleans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for batch in pieces(batches, text):
            yield batch.filter(pa.array(test(np.clip(of(batch.column(text)), 0.0, 1.0)), pa.bool_()))

    return small_batches(df).mapInArrow(run, df.schema)
