"""Language identification with hyperdimensional profiles.

Each letter has a random vector of -1 and 1. An n-gram's vector binds (multiplies) its letters' vectors, permuted
by their place; a text's vector bundles (adds) those of its n-grams, and so does a language's prototype over all its
training texts. A text has the language of the prototype nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSION = 1024
#: Symbols: 0 for what is no letter, 26 plain letters, and further letters by code point modulo the rest.
SYMBOLS = 64
UNKNOWN = "und"
_table: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Symbol of each code point."""
    if not _table:
        table = np.zeros(0x110000, np.int64)
        table[97:123] = np.arange(1, 27)
        high = [c for c in range(128, len(table)) if chr(c).isalpha()]
        table[high] = 27 + np.array(high) % (SYMBOLS - 27)
        _table.append(table)
    return _table[0]


def letters(seed: int = 41) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSION))


def vectors(grams: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Vectors of trigram codes: the first letter permuted twice, the second once."""
    first, second, third = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return np.roll(item, 2, axis=1)[first] * np.roll(item, 1, axis=1)[second] * item[third]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram code, count) for texts in lower case; the middle symbol is a letter, so that none crosses a text's end."""
    whole = "\n".join(["", *((t or "").lower() for t in texts), ""])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = symbol_table()[points]
    ends = np.cumsum([1, *(len((t or "").lower()) + 1 for t in texts)])
    middle = np.flatnonzero(symbol[1:-1]) + 1
    code = (symbol[middle - 1] * SYMBOLS + symbol[middle]) * SYMBOLS + symbol[middle + 1]
    row = np.searchsorted(ends, middle, side="right") - 1
    key, count = np.unique(row * SYMBOLS**3 + code, return_counts=True)
    return key // SYMBOLS**3, key % SYMBOLS**3, count


class Model:
    """Language names and their prototypes."""

    def __init__(self, langs: list[str], prototypes: np.ndarray):
        self.langs = langs
        self.prototypes = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None], item: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and cosine of each text; UNKNOWN and 0 for one without letters."""
        row, code, count = trigrams(texts)
        if not len(row) or not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, column = np.unique(code, return_inverse=True)
        bundle = np.zeros((len(texts), DIMENSION), np.float32)
        some = max(1, (4 << 20) // max(1, len(grams)))  # rows at once, for bounded memory
        item_of = vectors(grams, item)
        for at in range(0, len(texts), some):
            a, b = np.searchsorted(row, [at, at + some])
            counts = np.zeros((min(some, len(texts) - at), len(grams)), np.float32)
            counts[row[a:b] - at, column[a:b]] = count[a:b]
            bundle[at : at + some] = counts @ item_of
        norm = np.linalg.norm(bundle, axis=1)
        cosine = (bundle @ self.prototypes.T.astype(np.float32)) / np.maximum(norm, 1e-12)[:, None]
        best = cosine.argmax(axis=1)
        seen = np.bincount(row, minlength=len(texts)) > 0
        return [self.langs[k] if s else UNKNOWN for k, s in zip(best, seen, strict=True)], np.where(seen, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)


def bundled(counts: dict[str, np.ndarray], item: np.ndarray) -> dict[str, np.ndarray]:
    """The sum of each language's n-gram vectors, from its count of each code: whole numbers."""
    names = list(counts)
    table = np.array([counts[n] for n in names]).reshape(len(names), -1)
    codes = np.flatnonzero(table.any(axis=0)) if len(names) else np.zeros(0, int)
    total = np.zeros((len(names), DIMENSION))
    for at in range(0, len(codes), 4096):  # n-grams at a time, for bounded memory
        some = codes[at : at + 4096]
        total += table[:, some].astype(float) @ vectors(some, item)
    return dict(zip(names, total.astype(np.int64), strict=True))


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text") -> Model:
    """Prototypes over all texts with a language outside the held-out fold.

    Tasks count trigrams and bundle their vectors; what reaches the driver is DIMENSION sums for each language. Without such texts there is no language to predict.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~common.held_out(key)).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.pieces(batches, "_text"):
            names, own = np.unique(np.array(batch.column("_lang").to_pylist(), object).astype(str), return_inverse=True)
            row, code, count = trigrams(batch.column("_text").to_pylist())
            order = np.argsort(own[row], kind="stable")
            edge = np.searchsorted(own[row][order], np.arange(len(names) + 1))
            for name, a, b in zip(names.tolist(), edge[:-1], edge[1:], strict=True):
                if name not in sums:
                    sums[name] = np.zeros(SYMBOLS**3, np.int64)
                np.add.at(sums[name], code[order[a:b]], count[order[a:b]])
            if len(sums) > 64:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    def out(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        found = bundled(sums, letters())
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(list(found), DIMENSION), pa.string()), pa.array(np.tile(np.arange(DIMENSION), len(found)), pa.int64()), pa.array(np.concatenate(list(found.values())), pa.int64())], names=["lang", "place", "n"])

    found = common.small_batches(rows).mapInArrow(run, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    langs, own = np.unique(np.array(found["lang"].to_pylist(), str), return_inverse=True)
    prototypes = np.zeros((len(langs), DIMENSION))
    prototypes[own, found["place"].to_numpy()] = found["n"].to_numpy()
    return Model(langs.tolist(), prototypes)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (the cosine, or 0 where it is less).

    A null text and one without letters are UNKNOWN, with a score of 0; of languages that are equally near the first by name is predicted. Texts are read whole, equal ones
    alike, and an empty table stays empty. Columns of docs that are named lang_pred or score are replaced, others stay.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # a vector for each language
    columns = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = letters()
        for batch in common.pieces(batches, text, 1 << 20):
            names, cosine = held.value.predict(batch.column(text).to_pylist(), item)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(names, pa.string()), pa.array(cosine, pa.float64())], names=[*columns, "lang_pred", "score"])

    return common.small_batches(docs).mapInArrow(run, schema)
