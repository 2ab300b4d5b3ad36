"""Burrows-Wheeler transform and longest common prefixes of a string collection, built column by column in external files.

Round j inserts, for every string at once, the suffix of length j: the row where its tail of length j - 1 stands, and the symbol
there, give its place by the last-to-first mapping, and the least common prefix since the symbol's previous row gives its own. All
suffixes of length up to j are then in order. The columns lie in files that each round reads and writes from front to end.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Rows of the files that are in memory at a time.
ROWS = 1 << 22
KINDS = {"symbol": np.uint16, "prefix": np.uint8, "suffix": np.uint32}


class _Range:
    """Least value of ranges of an array, from a table of powers of two."""

    def __init__(self, values: np.ndarray, longest: int):
        n, many = len(values), max(1, int(longest).bit_length())
        self.table = np.empty((many, n), values.dtype)
        self.table[0] = values
        for k in range(1, many):
            half, to = 1 << k - 1, n - (1 << k) + 1
            np.minimum(self.table[k - 1, :to], self.table[k - 1, half : half + to], out=self.table[k, :to])

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Over [start, end) for each pair; no range is empty."""
        level = np.frexp((end - start).astype(float))[1].astype(np.int64) - 1
        row, flat = level * self.table.shape[1], self.table.ravel()
        return np.minimum(flat[row + start], flat[row + end - (np.int64(1) << level)])


class _Files:
    """The columns of one round, a file each; they stay open, and what a round writes goes over what an earlier one wrote."""

    def __init__(self, folder: str, name: str, symbol: type):
        self.kinds = KINDS | {"symbol": symbol}
        self.files = {k: open(os.path.join(folder, f"{name}-{k}"), "w+b", buffering=0) for k in KINDS}  # noqa: SIM115
        self.rows = 0

    def write(self, **columns: np.ndarray) -> None:
        """Add rows at the end."""
        for k, v in columns.items():
            self.files[k].seek(self.rows * np.dtype(self.kinds[k]).itemsize)
            self.files[k].write(v.astype(self.kinds[k], copy=False).data)
        self.rows += len(v)

    def read(self, kind: str, start: int, count: int) -> np.ndarray:
        out = np.empty(max(0, min(count, self.rows - start)), self.kinds[kind])
        self.files[kind].seek(start * out.itemsize)
        if len(out) and self.files[kind].readinto(out.view(np.uint8).data) != out.nbytes:
            raise OSError("a column is cut off")
        return out

    def clear(self) -> None:
        self.rows = 0

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def _places(old: _Files, counts: np.ndarray, last: np.ndarray, cap: int) -> tuple[np.ndarray, ...]:
    """Rows to insert: (row among the suffixes of length >= 1, suffix that is made longer, own prefix, successor's prefix or -1), by row.

    `last` are the rows that the last round inserted. One pass over the files from front to end; what goes on
    from block to block is, for each symbol, its count so far, the least prefix since its last row, and the inserted row, if that was one,
    that waits for its successor's prefix.
    """
    letters = len(counts)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]) - counts[0]
    seen = np.zeros(letters, np.int64)
    since = np.full(letters, 255, np.uint8)
    waiting = np.full(letters, -1, np.int64)
    rows, suffixes, own_prefix = [], [], []
    following = np.full(len(last), -1, np.int64)
    made = 0
    for at in range(0, old.rows, ROWS):
        symbol, prefix = old.read("symbol", at, ROWS), old.read("prefix", at, ROWS)
        n, more = len(symbol), at + ROWS < old.rows
        order = np.argsort(symbol, kind="stable")
        here = counts if n == old.rows else np.bincount(symbol, minlength=letters)
        first = np.cumsum(here) - here
        new = np.zeros(n, bool)
        a, b = np.searchsorted(last, [at, at + n])
        new[last[a:b] - at] = True
        fresh = new[order]
        fresh[: here[0]] = False  # a whole string goes no further
        own = np.flatnonzero(fresh)
        to = order[own]
        letter = symbol[to].astype(np.int64)
        begin = first[letter]
        head = own == begin
        start = np.where(head, 0, order[own - 1] + 1)
        # an old successor of the same first symbol has a new neighbour
        inside = own + 1 < begin + here[letter]
        told = np.flatnonzero(inside)
        told = told[~fresh[own[told] + 1]]
        low, high = to[told] + 1, order[own[told] + 1] + 1
        least = _Range(prefix, max(int((to + 1 - start).max(initial=1)), int((high - low).max(initial=1))))
        value = least.least(start, to + 1)
        if at:
            value = np.where(head, np.minimum(value, since[letter]), value)
        value = np.minimum(value.astype(np.int64) + 1, cap)
        value[head & (seen[letter] == 0)] = 0
        following[made + told] = np.minimum(least.least(low, high).astype(np.int64) + 1, cap)
        if at:
            late = np.flatnonzero((waiting >= 0) & (here > 0))
            late = late[~fresh[first[late]]]
            end = order[first[late]] + 1
            close = np.minimum(np.minimum.accumulate(prefix)[end - 1], since[late])
            following[waiting[late]] = np.minimum(close.astype(np.int64) + 1, cap)
        rows.append((before + seen)[letter] + own - begin)
        suffixes.append(old.read("suffix", at, ROWS)[to])
        own_prefix.append(value)
        if more:  # what the next block needs
            present = np.flatnonzero(here)
            ends = order[first[present] + here[present] - 1]
            after = np.append(np.minimum.accumulate(prefix[::-1])[::-1], np.uint8(255))
            absent = np.flatnonzero(here == 0)
            since[absent] = np.minimum(since[absent], after[0])
            since[present] = after[ends + 1]
            waiting[present] = -1
            tail = np.flatnonzero(~inside)
            waiting[letter[tail]] = made + tail
            seen += here
        made += len(own)
    row, suffix, value = (np.concatenate(x) for x in (rows, suffixes, own_prefix))
    if len(rows) == 1:  # one block gives them in order
        return row, suffix, value, following[:made]
    sort = np.argsort(row, kind="stable")
    return row[sort], suffix[sort], value[sort], following[:made][sort]


def build(data: np.ndarray, starts: np.ndarray, cap: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, prefix, string, length) of all suffixes of the strings data[starts[i]:starts[i + 1]], the empty ones included.

    Letters are whole numbers from 0, best below 65,535; in the transform they are one more, and 0 where a suffix is a whole string.
    prefix is the length of the common prefix with the row before, at most `cap` (which is below 255); strings have at most 254 letters.
    """
    n = len(starts) - 1
    size = np.diff(starts)
    if n == 0:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint8), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    work = tempfile.mkdtemp(prefix="bwt-", dir=folder)
    letters = int(data.max(initial=0)) + 2
    kind = np.uint16 if letters <= 1 << 16 else np.uint32
    old, new = (_Files(work, name, kind) for name in "ab")
    try:

        def symbols(string: np.ndarray, length: int) -> np.ndarray:
            more = size[string] > length
            out = np.zeros(len(string), kind)
            out[more] = data[starts[string[more] + 1] - 1 - length].astype(kind) + kind(1)
            return out

        if n >= 1 << 24:
            raise ValueError("a partition holds fewer than 2^24 strings")
        first = symbols(np.arange(n), 0)
        old.write(symbol=first, prefix=np.zeros(n), suffix=np.arange(n) << 8)
        counts, last = np.bincount(first, minlength=letters), np.arange(n)
        for length in range(1, int(size.max()) + 1):
            row, suffix, own, following = _places(old, counts, last, cap)
            symbol = symbols((suffix >> 8).astype(np.int64), length)
            last = row + n
            _insert(old, new, last, suffix + 1, own, following, symbol)
            counts = counts + np.bincount(symbol, minlength=letters)
            old.clear()
            old, new = new, old
        symbol, prefix, suffix = (old.read(k, 0, old.rows) for k in KINDS)
        return symbol, prefix, suffix >> 8, (suffix & 255).astype(np.uint8)
    finally:
        for files in (old, new):
            files.close()
        shutil.rmtree(work, ignore_errors=True)


def _insert(old: _Files, new: _Files, row: np.ndarray, suffix: np.ndarray, own: np.ndarray, following: np.ndarray, symbol: np.ndarray) -> None:
    """Copy the columns from front to end, with the new rows in their places (`row` counts in the copy)."""
    target = row - np.arange(len(row))  # the old row that each stands before
    for at in range(0, max(old.rows, 1), ROWS):
        block = {k: old.read(k, at, ROWS) for k in KINDS}
        to = at + len(block["symbol"])
        a = np.searchsorted(target, at, side="left") if at else 0
        b = len(target) if to >= old.rows else np.searchsorted(target, to, side="left")
        place = target[a:b] - at + np.arange(b - a)
        mask = np.ones(len(block["symbol"]) + b - a, bool)
        mask[place] = False
        out = {}
        for kind, values in (("symbol", symbol), ("prefix", own), ("suffix", suffix)):
            out[kind] = np.empty(len(mask), old.kinds[kind])
            out[kind][mask] = block[kind]
            out[kind][place] = values[a:b]
        # the row after an inserted one, if it is an old one of the same first symbol, has a new neighbour
        next_old = np.append(target[a:b][1:] != target[a:b][:-1], True) if b > a else np.zeros(0, bool)
        change = next_old & (following[a:b] >= 0)
        out["prefix"][place[change] + 1] = following[a:b][change]
        new.write(**out)
