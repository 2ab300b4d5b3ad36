"""Packing of tokenised documents into windows of fixed size: best-fit decreasing.

A document of more tokens than a window is first cut into full windows; each full piece is a sequence
of its own. The remainders are dealt by hash into groups of bounded size, and each group is packed in
order of falling length into the tightest open window that still has room, which a segment tree over
remaining capacities finds. Group sizes don't grow with the input; only their number does.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import Memo, kept

WINDOW = 4096
#: Pieces of a group, about: large enough that the windows left open at its end weigh little.
GROUP = 4096
#: Words that a worker remembers, and twice as many at most.
WORDS = 120_000


class Tree:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, window: int) -> None:
        self.open.setdefault(room, []).append(window)
        at = room + self.width
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The window of least remaining capacity >= size, with that capacity; the latest put among equals."""
        count, at = self.count, size + self.width
        if not count[at]:
            while at > 1 and not (at % 2 == 0 and count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.width
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece; the lengths, of 1 to `window`, have to be falling."""
    tree, sequence, offset, made = Tree(window), [], [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            room, w = window, made
            made += 1
        else:
            room, w = found
        sequence.append(w)
        offset.append(window - room)
        if room > n:
            tree.put(room - n, w)
    return sequence, offset


#: Characters whose lower-case and composed forms are plain: those below U+0180 but for U+0130. A text of these alone takes the short way.
_PLAIN = range(0x180)
_WIDE = re.compile("[^\x00-\u012f\u0131-\u017f]").search


class Words(Memo):
    """Ids, as bytes, of the words that the file's own pre-tokeniser cuts a text into, each remembered.

    What is done to a text is read from the file: special tokens are told where they stand literally, as the library does by itself;
    the text between them is normalised and split by the file's pattern, and each word is encoded by the library's model. Where the file
    composes characters and lowers them, a composed text of plain Latin characters is lowered here. A file
    of another form than a lower-casing normaliser, a pattern and bytes as characters is left to the library as a whole.
    """

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(self._word, WORDS)
        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        told = json.loads(vocabulary)
        form = [(n["type"], n.get("pattern"), n.get("content")) for n in (told["normalizer"] or {}).get("normalizers", [])]
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        added = told["added_tokens"]
        split = {"type": "Split", "behavior": "Removed", "invert": True}
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.known = (
            form == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and len(steps) == 2 and split.items() <= steps[0].items() and "Regex" in steps[0]["pattern"] and bytewise.items() <= steps[1].items()
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added) and told["post_processor"] is None
        )
        if not self.known:
            return
        import regex

        pattern = steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")  # Python's own \s has four separators more
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        self.find = regex.compile(pattern).findall
        kind = lambda p: "".join(chr(c) for c in _PLAIN if regex.fullmatch(p, chr(c)))
        classes = re.sub(r"\\p\{\w+\}", lambda p: re.escape(kind(p[0])), pattern)
        self.find_plain = None if r"\p" in classes else re.compile(classes).findall
        as_characters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.characters = {c: as_characters(chr(c))[0][0] for c in _PLAIN}
        self.normalised, self.model = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize

    def _word(self, word: str) -> bytes:
        if _WIDE(word):
            return array("I", [t.id for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word) for t in self.model(part)]).tobytes()
        return array("I", [t.id for t in self.model(word.translate(self.characters))]).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, without special tokens added, as little-endian unsigned 32-bit numbers."""
        if not self.known:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.special[part])
            elif self.find_plain is not None and (part.isascii() or not _WIDE(part) and unicodedata.is_normalized("NFC", part)):
                out += map(self.__getitem__, self.find_plain(part.lower()))
            else:
                out += map(self.__getitem__, self.find(self.normalised(part)))
        return b"".join(out)


def tokenize(df: DataFrame, vocabulary: bytes, end_id: int, window: int = WINDOW, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens (and ids, if asked for).

    `vocabulary` is the content of a tokenizers file. A null or empty text is the one token `end_id`; texts are read whole, whatever their length.
    Rows that share a key, or their whole text, are documents of their own; an empty table gives no pieces. Other columns are not carried.
    """
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = kept(Words, held.value)
        last = np.array([end_id], "<u4").tobytes()
        for batch in common.pieces(batches, "_text"):
            index, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            for i, value in enumerate(batch.column("_text").to_pylist()):
                data = packed.ids(value or "") + last
                for at in range(0, len(data), 4 * window):
                    piece = data[at : at + 4 * window]
                    index.append(i)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(data) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int64))
            made = [batch.column(key).take(pa.array(index, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
            yield pa.RecordBatch.from_arrays(made + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), names=[key, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return common.small_batches(df.select(F.col(key), F.col(text).alias("_text"))).mapInArrow(run, schema)


def pack(pieces: DataFrame, n_pieces: int, window: int = WINDOW, group: int = GROUP, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `window` tokens; `n_pieces`, about, sets the number of groups.

    Groups are dealt at random but repeatably, so that repeated rows part too; inside one, ties in length go by key and start. An empty table gives none.
    """
    groups = max(1, -(-n_pieces // group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(key, "start", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", key, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit(rows["length"].tolist(), window)
        base = int(rows["_group"].iloc[0]) << 32
        return rows.drop(columns="_group").assign(sequence_id=np.array(sequence, np.int64) + base, offset=np.array(offset, np.int64))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id bigint", "offset bigint"])
    return dealt.groupBy("_group").applyInPandas(run, schema)
