"""Toxicity by compression distance: windows of a text are compressed with a dictionary of ordinary text and with one of toxic text.

Each dictionary is trained by zstandard on windows of its own class. Most of a toxic document is ordinary, so the
windows that train the toxic dictionary are chosen by compression as well: at first those that the ordinary dictionary
compresses worst, then, a few times over, those that save most with a dictionary trained on chosen windows of the other half of
the documents. In a window of ordinary words with a toxic one among them two dictionaries without anything in common differ by chance
more than by the toxic word; so the toxic dictionary is used with the ordinary one behind it, and what a window saves is due to the
toxic one alone. Thresholds on these savings are calibrated on documents that neither dictionary has seen.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a window that is scored, and of one that trains the toxic dictionary; they end at a space if they can.
WINDOW, TOXIC_WINDOW = 128, 48
#: Bytes of the dictionaries, and of the stretches that zstandard picks for them at a time.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_PIECE, TOXIC_PIECE = 262_144, 4096, 128, 24
LEVEL, SHORTEST_MATCH = 7, 4
#: Part of the toxic documents' windows that is chosen, how often it is chosen anew, and the fewest windows.
SHARE, ROUNDS, LEAST = 0.06, 3, 64
#: Bytes that a window has to save to be counted by the share of such windows, and how many largest savings are averaged.
SAVED, LARGEST = 3, 3
#: Labelled documents of each class that the model is fitted on at most, and their longest text.
PER_CLASS, LONGEST = 2000, 16_384
#: Windows of ordinary documents that train the ordinary dictionary at most, drawn at random.
WINDOWS = 20_000
THRESHOLD = 0.5


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """A text in lower case, cut into windows of at most `size` bytes; the empty text has none."""
    data, out, at = text.lower().encode("utf-8", "replace"), [], 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data) and (space := data.rfind(b" ", at, end)) > at:
            end = space + 1
        out.append(data[at:end])
        at = end
    return out


def dictionary(samples: list[bytes], size: int, piece: int) -> bytes:
    """A dictionary that zstandard trains on the samples; of so few that all fit in, or that it can't be trained, the samples themselves."""
    import zstandard

    if sum(map(len, samples)) + len(samples) <= size:
        return b" ".join(samples)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, k=piece, d=6 if piece < 64 else 8).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def compressor(content: bytes):
    """A function that compresses short windows after `content`, without anything in a frame that doesn't depend on them."""
    import zstandard as z

    own = z.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=ORDINARY_BYTES + TOXIC_BYTES, min_match=SHORTEST_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = z.ZstdCompressionDict(content.ljust(8, b" "), dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=own)
    return z.ZstdCompressor(dict_data=d, compression_params=own).compress


def lengths(compress, parts: list[bytes]) -> np.ndarray:
    return np.array([len(compress(w)) for w in parts], float)


def chosen(parts: list[bytes], half: np.ndarray, ordinary: bytes) -> list[bytes]:
    """The windows, out of those of toxic documents, that train the toxic dictionary; `half` (0 or 1) of a window is its document's."""
    plain = lengths(compressor(ordinary), parts)
    n = min(len(parts), max(LEAST, int(SHARE * len(parts))))
    # a compressed window has some bytes whatever its length
    novelty = plain / (np.array([len(w) for w in parts]) + 6)
    top = np.argsort(-novelty, kind="stable")[:n]
    for _ in range(ROUNDS):
        saved = np.zeros(len(parts))
        for k in (0, 1):
            others = [parts[i] for i in top if half[i] != k]
            if others:
                with_toxic = compressor(dictionary(others, TOXIC_BYTES, TOXIC_PIECE) + b" " + ordinary)
                own = np.flatnonzero(half == k)
                saved[own] = plain[own] - lengths(with_toxic, [parts[i] for i in own])
        top = np.lexsort((-novelty, -saved))[:n]
    return [parts[i] for i in top]


class Model:
    """Two dictionaries and a logistic threshold on what the toxic one saves in a text's windows."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None = None, share: float = 0.5):
        self.ordinary, self.toxic, self.weights, self.share = ordinary, toxic, weights, share

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def savings(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that each window saves with the toxic dictionary."""
        if "_made" not in self.__dict__:
            self._made = [compressor(c) for c in (self.ordinary, self.toxic + b" " + self.ordinary)]
        return lengths(self._made[0], parts) - lengths(self._made[1], parts)

    def features(self, text: str) -> list[float]:
        """Mean of all windows' savings, mean of the largest, and the share of windows that save SAVED bytes; zeros for the empty text."""
        parts = windows(text)
        if not parts:
            return [0.0, 0.0, 0.0]
        saved = self.savings(parts)
        return [saved.mean(), np.sort(saved)[-LARGEST:].mean() / 10, (saved >= SAVED).mean()]

    def score(self, texts: pa.Array) -> np.ndarray:
        values = texts.to_pylist()
        if self.weights is None:
            return np.full(len(values), self.share)
        x = np.array([self.features(t or "") for t in values]).reshape(-1, 3)
        return common.sigmoid(x @ self.weights[:-1] + self.weights[-1])


def fit(texts: list[str], labels: list[int], share: float) -> Model:
    """A model from texts and labels of 0 and 1; with a class missing it gives the share of label 1 as every score.

    Two texts of three train the dictionaries, the others the thresholds.
    """
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(b"", b"", None, share)
    third = np.arange(len(y)) % 3
    plain = [w for t, label, k in zip(texts, labels, third, strict=True) if k < 2 and not label for w in windows(t)]
    ordinary = dictionary([plain[i] for i in np.random.default_rng(5).permutation(len(plain))[:WINDOWS]], ORDINARY_BYTES, ORDINARY_PIECE)
    toxic = [(w, k) for t, label, k in zip(texts, labels, third, strict=True) if k < 2 and label for w in windows(t, TOXIC_WINDOW) if len(w) >= TOXIC_WINDOW // 3]
    model = Model(ordinary, dictionary(chosen([w for w, _ in toxic], np.array([k for _, k in toxic]), ordinary), TOXIC_BYTES, TOXIC_PIECE) if toxic else b"")
    rest = third == 2 if len(set(y[third == 2])) == 2 else np.ones(len(y), bool)
    x = np.array([model.features(t) for t, r in zip(texts, rest, strict=True) if r])
    model.weights = common.logistic(x, y[rest], share, ridge=0.1)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """A model from a bounded sample of labelled documents (PER_CLASS of each class, of up to LONGEST characters) and the share of label 1 among all labels.

    Labels without a text in reach give a constant score, and a warning.
    """
    table = common.labelled_sample(docs, labels, label, PER_CLASS, LONGEST, key, text).select("_text", F.col("_label"), F.xxhash64(F.col(key), F.lit(7)).alias("_order")).orderBy("_order", "_text").toArrow()
    share = common.class_share(labels, label, key)
    if not table.num_rows:
        warnings.warn(f"no labelled text of 1 to {LONGEST} characters: every score is {share}", stacklevel=2)
    return fit(table["_text"].to_pylist(), table["_label"].to_pylist(), share)


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1, higher: likelier toxic) and predicted.

    Every row gives one, in whatever order: a null text counts as the empty one, equal texts have equal scores, whole texts of any length are read, and
    an empty table stays empty. Columns of docs that are named score or predicted are replaced, others stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries
    return common.scored(docs, text, lambda: held.value.score, threshold)


def ordinary_rows(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns as they are, whose score is below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries
    return common.filtered(docs, text, lambda: held.value.score, lambda score: score < threshold)
