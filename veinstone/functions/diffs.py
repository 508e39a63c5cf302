"""Sequence and word differences. Which elements stay depends on all that follow, so pandas functions find them, a pair of cells at a time."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value of diff() alone: where (old + 1) * (new + 1) is more, everything counts as deleted, then inserted.
MAX_CELLS = 1_000_000
#: Bytes of rows that a comparison holds, and how many rows it keeps where it would hold more.
HELD, KEPT = 32 << 20, 16


def kept_pairs(old: list, new: list) -> list[tuple[int, int]]:
    """Which elements a longest common subsequence keeps, as places in both, in order.

    An element of old is kept if it stands in both here, or if without it the length would be less; then with its next occurrence in new. So a common
    beginning is kept as it is. A common end adds to every length alike and is left to the last: once either side comes to it, all that the other side lacks is in it."""
    n, m, begin, end = len(old), len(new), 0, 0
    while begin < min(n, m) and old[begin] == new[begin]:
        begin += 1
    while end < min(n, m) - begin and old[n - 1 - end] == new[m - 1 - end]:
        end += 1
    found, i, j = _kept(old[begin : n - end], new[begin : m - end])
    out = [(k, k) for k in range(begin)] + [(begin + a, begin + b) for a, b in found]
    i, j = begin + i, begin + j
    skips_old = i < n - end
    while i < n and j < m:
        if old[i] == new[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif skips_old:
            i += 1
        else:
            j += 1
    return out


def _kept(old: list, new: list) -> tuple[list[tuple[int, int]], int, int]:
    """kept_pairs() until one side ends, and where both are then.

    The lengths of the common subsequences of old[i:] with every end of new are one integer a row: bit k is 0 where the length grows as
    new's end gets longer by its k-th element from behind (bit-parallel, in words of the machine). Rows come from the end and are used from the beginning: where HELD
    bytes don't hold all, KEPT of them are, and those between them are found again, span by span."""
    m, where = len(new), {}
    for j, x in enumerate(new):
        where.setdefault(x, []).append(j)
    full, width = (1 << m) - 1, m // 8 + 1

    @lru_cache(max(1, HELD // width))
    def bits(x) -> int:
        at = where.get(x, [])
        if len(at) < 32:
            return sum(1 << (m - 1 - j) for j in at)
        flags = np.zeros(m, bool)
        flags[at] = True
        return int.from_bytes(np.packbits(flags).tobytes(), "big") >> (-m % 8)

    def before(row: int, x) -> int:
        hit = row & bits(x)
        return ((row + hit) | (row - hit)) & full if hit else row

    out, i, j, todo = [], 0, 0, [(0, len(old), full)]  # spans of old with the row at their end, the next one last
    while todo and j < m:
        start, stop, row = todo.pop()
        if (stop - start) * width > HELD and stop - start > 1:
            size = -(-(stop - start) // KEPT)
            for last in range(stop, start, -size):
                first = max(start, last - size)
                todo.append((first, last, row))
                if first > start:
                    for x in reversed(old[first:last]):
                        row = before(row, x)
            continue
        rows = [row]
        for x in reversed(old[start:stop]):
            rows.append(before(rows[-1], x))
        rows.reverse()
        for i in range(start + 1, stop + 1):
            x, here, after = old[i - 1], rows[i - 1 - start], rows[i - start]
            mask = (1 << (m - j)) - 1
            # fewer ones: longer
            if new[j] == x or here is not after and (here & mask).bit_count() < (after & mask).bit_count():
                at = where[x]
                j = at[bisect_left(at, j)]
                out.append((i - 1, j))
                j += 1
                if j == m:
                    break
    return out, i, j


def runs(old: list, new: list) -> list[tuple[str, list]]:
    """(op, elements) in order: = kept, - deleted, + inserted. Between two kept elements the deleted come before the inserted."""
    return _runs(old, new, kept_pairs(old, new))


def _runs(old: list, new: list, pairs: list[tuple[int, int]]) -> list[tuple[str, list]]:
    out: list[tuple[str, list]] = []
    i = j = 0
    for a, b in [*pairs, (len(old), len(new))]:
        if i < a:
            out.append(("-", old[i:a]))
        if j < b:
            out.append(("+", new[j:b]))
        if a < len(old) and b < len(new):
            if out and out[-1][0] == "=":
                out[-1][1].append(old[a])
            else:
                out.append(("=", [old[a]]))
        i, j = a + 1, b + 1
    return out


def _elements(cell) -> list:
    return [] if cell is None else cell.split("\n") if isinstance(cell, str) else list(cell)


def _words(cell) -> list[str]:
    return re.findall(r"\s+|\S+", cell or "")


def _function(old: Column, new: Column, cut, shape, kind: str) -> Column:
    """cut makes a list of what a cell holds, shape rows of the runs of two lists."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([list(shape(runs(cut(x), cut(y)))) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, kind)(old, new)


def diff(old: list, new: list) -> list[tuple[str, str]]:
    """(op, value), one for each element; the reference's diffSequence, with its switch at MAX_CELLS. Columns are compared by runs(), whatever their size."""
    pairs = [] if (len(old) + 1) * (len(new) + 1) > MAX_CELLS else kept_pairs(old, new)
    return [(op, v) for op, values in _runs(old, new, pairs) for v in values]


_OPS = "array<struct<op:string,value:string>>"


def line_diff(old: Column, new: Column) -> Column:
    """Array of (op, value) between two arrays of strings, or two texts by line."""
    return _function(old, new, _elements, lambda found: ({"op": op, "value": v} for op, values in found for v in values), _OPS)


def word_diff(old: Column, new: Column) -> Column:
    """The same by words and white space, one entry for each run."""
    return _function(old, new, _words, lambda found: ({"op": op, "value": "".join(values)} for op, values in found), _OPS)


#: A row of places is one number: that of the old element and that of the new, from 1, 0 for none, and whether both are kept.
_OLD, _NEW = 1 << 32, 2


def _places(old: list, new: list) -> np.ndarray:
    """Rows of changed_rows(), by places; runs end each gap before the next kept one."""
    out, i, j, gap = [], 0, 0, 0
    for op, values in runs(old, new):
        if op == "=":
            out += [(i + k + 1) * _OLD + (j + k + 1) * _NEW + 1 for k in range(len(values))]
            i, j, gap = i + len(values), j + len(values), 0
        elif op == "-":
            out += [(i + k + 1) * _OLD for k in range(len(values))]
            i, gap = i + len(values), len(values)
        else:
            first, beside = len(out) - gap, gap
            for k in range(len(values)):
                if k < beside:
                    out[first + k] += (j + k + 1) * _NEW
                else:
                    out.append((j + k + 1) * _NEW)
            j, gap = j + len(values), 0
    return np.array(out, dtype=np.int64)


def changed_rows(old: Column, new: Column) -> Column:
    """Array of (kind, before, after) between two arrays of strings: context rows; deleted elements beside the inserted ones that follow them, in order,
    as changed; what is left over of either as removed or added. Only places come back from Python, the texts are put beside them by Spark."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_places(_elements(x), _elements(y)) for x, y in zip(a, b)], dtype=object)

    def row(x: Column) -> Column:
        i, j = F.shiftright(x, 32).cast("int"), (F.shiftright(x, 1).bitwiseAND(F.lit((1 << 31) - 1))).cast("int")
        kind = F.when(x.bitwiseAND(F.lit(1)) == 1, "context").when((i > 0) & (j > 0), "changed").when(i > 0, "removed").otherwise("added")
        return F.struct(kind.alias("kind"), F.get(old, i - 1).alias("before"), F.get(new, j - 1).alias("after"))

    return F.transform(F.pandas_udf(run, "array<long>")(old, new), row)
