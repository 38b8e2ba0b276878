"""One-to-one matches of two sequences' pages, and their longest chain in order."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<a_idx: int, b_idx: int, score: double>>"


def greedy_match(cells: Column, least: float | None = None) -> Column:
    """Cells (a_idx, b_idx, score) by falling score, then a_idx, then b_idx, each taken if neither page is.

    Cells under ``least`` are none. Quadratic in the cells of one pair of books.
    """
    usable = F.filter(cells, lambda c: c["score"] >= least) if least is not None else cells
    ranked = F.array_sort(F.transform(usable, lambda c: F.struct((-c["score"]).alias("down"), c["a_idx"].cast("int").alias("a_idx"), c["b_idx"].cast("int").alias("b_idx"))))
    none = F.array().cast(MATCHES)

    def take(taken: Column, c: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["a_idx"] == c["a_idx"]) | (t["b_idx"] == c["b_idx"]))
        one = F.array(F.struct(c["a_idx"].alias("a_idx"), c["b_idx"].alias("b_idx"), (-c["down"]).cast("double").alias("score"))).cast(MATCHES)
        return F.when(clash, taken).otherwise(F.concat(taken, one))

    return F.aggregate(ranked, none, take)


def longest_chain(matches: Column) -> Column:
    """Length of the longest run of matches, by a_idx then b_idx, whose b_idx rises strictly."""
    ordered = F.transform(F.array_sort(F.transform(matches, lambda m: F.struct(m["a_idx"].alias("a"), m["b_idx"].alias("b")))), lambda p: p["b"].cast("int"))

    def place(tails: Column, b: Column) -> Column:
        under = F.size(F.filter(tails, lambda t: t < b))
        return F.concat(F.slice(tails, 1, under), F.array(b), F.slice(tails, under + 2, F.size(tails)))

    return F.size(F.aggregate(ordered, F.array().cast("array<int>"), place))


def greedy_places(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the cells (a, b, score) that greedy_match() takes, by rank; sorted once, then each cell is looked at once."""
    order = np.lexsort((b, a, -score))
    rows, row = np.unique(a[order], return_inverse=True)
    columns, column = np.unique(b[order], return_inverse=True)
    free_row, free_column = bytearray(b"\1") * len(rows), bytearray(b"\1") * len(columns)
    taken = []
    for k, (i, j) in enumerate(zip(row.tolist(), column.tolist(), strict=True)):
        if free_row[i] and free_column[j]:
            free_row[i] = free_column[j] = 0
            taken.append(k)
    return order[np.array(taken, np.int64)]


def chain_length(a: np.ndarray, b: np.ndarray) -> int:
    """longest_chain() of matches (a, b)."""
    tails: list[int] = []
    for x in b[np.lexsort((b, a))].tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)
