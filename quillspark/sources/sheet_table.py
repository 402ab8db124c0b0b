"""The table in a sheet: where its header stands, what its columns are called, and its rows."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from .csv_source import column_names

#: Share of the widest row's cells that a header fills, and the least number of them.
FILLED, LEAST = 0.6, 2
#: Headers that belong to the column on their right if theirs is empty.
SHIFTED = re.compile(r"(?i)(?:given|max)\b")


def number(cell: str | None) -> bool:
    """Whether a cell reads as a finite number; a blank one does, an absent one does not."""
    if cell is None:
        return False
    t = cell.strip()
    if not t:
        return True
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+", t):
        return True
    return bool(re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", t)) and math.isfinite(float(t))


@dataclass
class SheetTable:
    """Column names, rows as (row number, cells), and the rows above the header as (row number, cells with text)."""

    names: list[str]
    rows: list[tuple[int, list[str]]]
    preamble: list[tuple[int, list[str]]]
    header: int


def _cells(row: list[str]) -> list[str]:
    return [c for c in row if c.strip()]


def header_row(grid: list[list[str]]) -> int:
    """Of the rows that fill most of the widest one's cells, that with the most text, the first among equals.

    If it holds but one text and the row above has numbers alone, that row is the header and the text a
    label that stands lower than the others.
    """
    filled = {i: len(x) for i, r in enumerate(grid) if (x := _cells(r))}
    if not filled:
        return 0
    texts = {i: sum(not number(c) for c in _cells(grid[i])) for i in filled}
    wide = [i for i, n in filled.items() if n >= max(LEAST, math.ceil(max(filled.values()) * FILLED))]
    at = max(wide, key=lambda i: (texts[i], -i)) if wide else min(filled)
    above = at - 1
    if texts[at] == 1 and texts.get(above) == 0 and filled[above] >= filled[at] - 2:
        return above
    return at


def table(grid: list[list[str]]) -> SheetTable:
    """The table of a sheet's grid; row numbers count from 1."""
    at = header_row(grid)
    body = [(i, r) for i, r in enumerate(grid[at + 1 :], at + 2) if _cells(r)]
    head = grid[at] if grid else []
    used = [[i for i, c in enumerate(r) if c.strip()] for r in [head, *(r for _, r in body)]]
    left = min((u[0] for u in used if u), default=0)
    right = max([len(head), *(u[-1] + 1 for u in used[1:])])
    width = max(right - left, 0)
    cut = lambda r: (r[left:right] + [""] * width)[:width]
    names, first = cut(head), body[0][1][left:right] if body else []

    # labels that stand one row lower than the header
    lifted = [i for i in range(width) if not names[i].strip() and i < len(first) and first[i].strip() and not number(first[i])]
    for i in lifted:
        names[i] = first[i].strip()
    blank = lambda i: not names[i].strip()
    for i in range(1, width - 1):
        if blank(i) and not blank(i - 1) and not blank(i + 1) and number(names[i - 1]) and number(names[i + 1]):
            names[i] = f"{names[i - 1].strip()} (secondary)"
    if width > 1 and blank(1) and not blank(0) and number(first[1] if len(first) > 1 else None):
        names[1] = f"{names[0]} value"
    has = [any(cut(r)[i].strip() for _, r in body) for i in range(width)]
    for i in range(width - 1):
        if SHIFTED.match(names[i].strip()) and not has[i] and blank(i + 1) and has[i + 1]:
            names[i], names[i + 1] = "", names[i]
    rows = [(no, ["" if n == 0 and i in lifted else c for i, c in enumerate(cut(r))]) for n, (no, r) in enumerate(body)]
    preamble = [(i, x) for i, r in enumerate(grid[:at], 1) if (x := _cells(r))]
    return SheetTable(column_names(names), rows, preamble, at)
