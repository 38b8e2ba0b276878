"""Which pages of a book are looked at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def sample_pages(pages: Column, blocks: Column | int, half: Column | int, most: Column | int) -> Column:
    """Ascending page indexes (from 0) of ``blocks`` evenly spread runs.

    The cover (0) is left out, but where it is the only page or all pages are
    wanted. Centres are rounded half to even. Too many pages are thinned evenly.
    """
    pages, blocks, half, most = map(_int, (pages, blocks, half, most))
    body = pages - 1
    centre = lambda k: F.when(blocks == 1, 1 + F.floor(body / 2)).otherwise(1 + F.bround((k + F.lit(0.5)) * body / blocks, 0)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1), lambda k: F.sequence(centre(k) - half, centre(k) + half))
    found = F.array_sort(F.array_distinct(F.filter(F.flatten(runs), lambda i: (i >= 1) & (i < pages))))
    n = F.size(found)
    thinned = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(1)) - 1), lambda i: F.element_at(found, 1 + F.least(n - 1, F.floor(i * (n / most.cast("double"))).cast("int")))))
    return (
        F.when(pages <= 0, F.array().cast("array<int>"))
        .when(pages == 1, F.array(F.lit(0)))
        .when(pages <= 3, F.sequence(F.lit(1), F.greatest(pages - 1, F.lit(1)).cast("int")))
        .when(blocks <= 0, F.sequence(F.lit(0), F.greatest(pages - 1, F.lit(0)).cast("int")))
        .when((most > 0) & (n > most), thinned)
        .otherwise(found)
        .cast("array<int>")
    )
