"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, under a linear hinge-loss model.

The n-grams are of bytes, so that marks and case count, hashed into a table of fixed size. The hinge
loss is minimised by dual coordinate descent, and margins on documents that a fit hasn't seen
calibrate the score.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SIZES = (2, 3, 4)
BITS = 17
#: Labelled documents of each class that the model is fitted on at most, and their longest text.
PER_CLASS, LONGEST = 2500, 16_384
THRESHOLD = 0.3
EPOCHS, COST, SMOOTH = 12, 1.0, 1.0
#: Bytes of text whose n-grams are in memory at a time.
PIECE = 1 << 18


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram bucket) of the distinct n-grams of each text, in order of rows."""
    body, starts = common.flat(texts)
    n, wide = len(body), body.astype(np.uint64)
    row = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    found = []
    value = wide.copy()
    for size in range(2, max(SIZES) + 1):
        if n < size:
            break
        value = value[: n - size + 1] | wide[size - 1 :] << np.uint64(8 * (size - 1))
        inside = row[: n - size + 1] == row[size - 1 :]
        bucket = common.mix(value[inside] + np.uint64(size << 40)) >> np.uint64(64 - BITS)
        found.append(row[: n - size + 1][inside] << np.uint64(BITS) | bucket)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.sort(np.concatenate(found))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed counts of each bucket in documents of class 1 and of class 0, each normalised."""
    counts = [np.full(1 << BITS, SMOOTH) for _ in range(2)]
    for index, label in zip(rows, y, strict=True):
        counts[int(label)][index] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, seed: int = 3) -> np.ndarray:
    """Weights (the last for the constant) that minimise |w|^2 / 2 + COST * sum of hinge losses, by dual coordinate descent."""
    w = np.zeros((1 << BITS) + 1)
    sign, alpha = np.where(y == 1, 1.0, -1.0), np.zeros(len(rows))
    share = np.clip(y.mean(), 0.05, 0.95)
    most = COST * np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            index, v = rows[i], values[i]
            gradient = sign[i] * (w[index] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[index] += step * sign[i] * v
                w[-1] += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


class Model:
    """One weight for each bucket (times its ratio), and the calibration of margins."""

    def __init__(self, ratio: np.ndarray | None, weight: np.ndarray | None, line: np.ndarray | None, share: float):
        self.ratio, self.weight, self.line, self.share = ratio, weight, line, share

    def margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[bucket]
        length = np.sqrt(np.bincount(row, r * r, n))
        return np.bincount(row, self.weight[bucket] * r, n) / np.maximum(length, 1e-12) + self.weight[-1]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weight is None:
            return np.full(len(texts), self.share)
        cuts = common.pieces([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", PIECE)
        margins = [self.margins(*features(b.column("text")), b.num_rows) for b in cuts]
        return common.sigmoid(self.line[0] * np.concatenate([np.zeros(0), *margins]) + self.line[1])


def _solve(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ratio = ratios(rows, y)
    values = [(ratio[r] / max(float(np.linalg.norm(ratio[r])), 1e-12)).astype(np.float32) for r in rows]
    return ratio, descend(rows, values, y)


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """A model from the buckets of each document and labels of 0 and 1; with a class missing every score is the share of label 1."""
    y = np.asarray(labels, int)
    if len(set(y.tolist())) < 2:
        return Model(None, None, None, share)
    margin, fold = np.zeros(len(y)), np.arange(len(y)) % 2
    for part in (0, 1):
        if len(set(y[fold != part].tolist())) == 2:
            other = Model(*_solve([r for r, f in zip(rows, fold, strict=True) if f != part], y[fold != part]), None, share)
            own = np.flatnonzero(fold == part)
            lengths = [len(rows[i]) for i in own]
            margin[own] = other.margins(np.repeat(np.arange(len(own)), lengths), np.concatenate([rows[i] for i in own]) if len(own) else np.zeros(0, int), len(own))
    line = common.logistic(margin[:, None], y, share, ridge=1e-3)
    return Model(*_solve(rows, y), line, share)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """A model from a bounded sample of labelled documents (PER_CLASS of each class, of up to LONGEST characters) and the share of label 1 among all labels.

    Labels without a text in reach give a constant score, and a warning.
    """
    sample = common.labelled_sample(docs, labels, label, PER_CLASS, LONGEST, key, text)

    def run(batches):
        for batch in common.pieces(batches, "_text", PIECE):
            row, bucket = features(batch.column("_text"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_label"), pa.array(packed, pa.binary())], names=[key, "_label", "buckets"])

    kind = docs.schema[key].dataType.simpleString()
    rows = sorted(sample.mapInArrow(run, f"{key} {kind}, _label int, buckets binary").collect(), key=lambda r: (r[key], r["buckets"]))
    order, share = np.random.default_rng(11).permutation(len(rows)), common.class_share(labels, label, key)
    if not rows:
        warnings.warn(f"no labelled text of 1 to {LONGEST} characters: every score is {share}", stacklevel=2)
    return fit([np.frombuffer(rows[i]["buckets"], "<i4") for i in order], np.array([rows[i]["_label"] for i in order], int), share)


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1, higher: likelier of quality) and predicted.

    Every row gives one, in whatever order: a null text counts as the empty one, equal texts have equal scores, whole texts of any length are read, and
    an empty table stays empty. Columns of docs that are named score or predicted are replaced, others stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2^BITS numbers
    return common.scored(docs, text, lambda: held.value.score, threshold)


def good_rows(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns as they are, whose score reaches the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2^BITS numbers
    return common.filtered(docs, text, lambda: held.value.score, lambda score: score >= threshold)
