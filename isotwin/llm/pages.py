"""Scanned pages: their lines in reading order, for one Arrow batch of pages at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Horizontal distance between line starts from which a new column begins.
COLUMN_GAP = 100
#: Blanks in a row that part the columns within a line that spans several.
_WIDE = re.compile(" {3,}")


def page_columns(text: str = "text", boxes: str = "boxes") -> list[Column]:
    """The columns that ``reading_order`` needs: the text, and the line boxes' left and upper edges alone."""
    return [F.col(text).alias("text"), F.col(f"{boxes}.x0").alias("x0"), F.col(f"{boxes}.y0").alias("y0")]


def reading_order(batch: pa.RecordBatch) -> list[list[tuple[int, str, int]]]:
    """For each page of ``batch`` (``page_columns``) its pieces of text in reading order: line from 0, piece, place in the line.

    Columns begin where line starts lie more than ``COLUMN_GAP`` apart and are read one after another, each from top to bottom.
    A line that spans columns is parted at wide blanks, each part belonging to the next column. Where the boxes are null, hold
    nulls or are not as many as the lines, the stored order holds. Null text gives no piece.
    """
    texts = batch.column("text").to_pylist()
    lines = [t.split("\n") if t is not None else [] for t in texts]
    sizes = np.fromiter(map(len, lines), int, len(lines))
    edges = []
    for name in ("x0", "y0"):
        a = batch.column(name)
        edges.append((a.flatten().to_numpy(zero_copy_only=False).astype(float), pa.compute.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False)))
    (x, nx), (y, _) = edges
    start = np.concatenate(([0], np.cumsum(nx)))
    xs, ys = np.zeros(sizes.sum()), np.zeros(sizes.sum())
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, n in enumerate(sizes):
        a, b = at[i], at[i + 1]
        own_x, own_y = x[start[i] : start[i + 1]], y[start[i] : start[i + 1]]
        if nx[i] == n and not (np.isnan(own_x).any() or np.isnan(own_y).any()):
            xs[a:b], ys[a:b] = own_x, own_y
        else:
            ys[a:b] = np.arange(n)
    page = np.repeat(np.arange(len(lines)), sizes)
    by_x = np.lexsort((xs, page))
    jump = np.concatenate(([0], (np.diff(xs[by_x]) > COLUMN_GAP) & (np.diff(page[by_x]) == 0))) if len(page) else np.zeros(0)
    count = np.cumsum(jump)
    first = count[at[:-1][sizes > 0]] if len(page) else np.zeros(0)
    column = np.empty(len(page), int)
    column[by_x] = count - np.repeat(first, sizes[sizes > 0])
    pieces: list[str] = []
    more: list[tuple[int, int, float, int, int]] = []
    extra: list[str] = []
    begins: list[int] = []
    k = 0
    for i, own in enumerate(lines):
        for n, s in enumerate(own):
            if "   " in s:
                blanks = [m.span() for m in _WIDE.finditer(s)]
                for part, (stop, (_, begin)) in enumerate(zip([b for b, _ in blanks[1:]] + [len(s)], blanks), 1):
                    more.append((i, column[k] + part, ys[k], n, part))
                    extra.append(s[begin:stop])
                    begins.append(begin)
                s = s[: blanks[0][0]]
            pieces.append(s)
            k += 1
    pieces += extra
    number = np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else np.zeros(0)
    if more:
        p, c, v, n, part = (np.array(z) for z in zip(*more))
        page, column, ys, number, part = np.concatenate((page, p)), np.concatenate((column, c)), np.concatenate((ys, v)), np.concatenate((number, n)), np.concatenate((np.zeros(k), part))
    else:
        part = np.zeros(k)
    order = np.lexsort((part, number, ys, column, page))
    places = [0] * k + begins
    out: list[list[tuple[int, str, int]]] = [[] for _ in lines]
    for j, i, n in zip(order.tolist(), page[order].tolist(), number[order].tolist()):
        out[i].append((int(n), pieces[j], places[j]))
    return out
