"""Tables as text: rows stream to the driver a partition at a time."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

FORMATS = ("simple", "markdown", "csv", "json")


def _text(value, width: int | None) -> str:
    out = "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)
    return out if width is None or len(out) <= width else out[: width - 1] + "…"


def lines(df: DataFrame, form: str = "simple", headers: bool = True, width: int = 40, page: int = 1000) -> Iterator[str]:
    """The table's lines; columns of the simple form are as wide as their widest cell among a page of rows."""
    if form not in FORMATS:
        raise ValueError(f"a form is one of {FORMATS}")
    names = df.columns
    rows = df.toLocalIterator()
    if form == "json":
        for row in rows:
            yield json.dumps(row.asDict(recursive=True), default=str)
        return
    if form == "csv":
        for row in ([names] if headers else []), rows:
            for r in row:
                out = io.StringIO()
                csv.writer(out, lineterminator="").writerow(["" if v is None else v for v in r])
                yield out.getvalue()
        return
    if form == "markdown":
        if headers:
            yield "| " + " | ".join(names) + " |"
            yield "|" + "---|" * len(names)
        for row in rows:
            yield "| " + " | ".join(_text(v, width) for v in row) + " |"
        return
    held, first = [], headers
    for row in rows:
        held.append([_text(v, width) for v in row])
        if len(held) == page:
            yield from _aligned(names if first else None, held)
            held, first = [], False
    if held or first:
        yield from _aligned(names if first else None, held)


def _aligned(names: list[str] | None, rows: list[list[str]]) -> Iterator[str]:
    every = ([names] if names else []) + rows
    widths = [max(len(r[i]) for r in every) for i in range(len(every[0]))]
    for r in every:
        yield "  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()


def sorted_rows(rows: list[dict], column: str, ascending: bool = True) -> list[dict]:
    """Rows in memory by a column: a missing value comes last in ascending order and first in descending order, ties stay as they are."""
    return sorted(rows, key=lambda r: (r[column] is None, r[column] if r[column] is not None else 0), reverse=not ascending)


class Pages:
    """Pages of a table in a total order, told by `page(offset, limit)` as a frame; one query brings AHEAD pages, which are held until another stretch is asked for."""

    AHEAD = 5

    def __init__(self, page, size: int = 50):
        self.page, self.size, self.start, self.rows = page, size, 0, None

    def __getitem__(self, n: int) -> list[dict]:
        first = n * self.size
        if self.rows is None or not self.start <= first < self.start + self.AHEAD * self.size:
            self.start = first
            self.rows = [r.asDict() for r in self.page(first, self.AHEAD * self.size).collect()]  # a few pages
        return self.rows[first - self.start : first - self.start + self.size]


def show(df: DataFrame, form: str = "simple", headers: bool = True) -> None:
    for line in lines(df, form, headers):
        print(line)
