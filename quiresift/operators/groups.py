"""Groups of accepted pairs, with representatives that guard a merge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresift.config import Thresholds
from quiresift.functions.text import basename, suspects
from quiresift.operators.components import components
from quiresift.scratch import keep


def plain_groups(pairs: DataFrame) -> DataFrame:
    """(book, grp): connected components of ``pairs`` (a, b)."""
    return components(pairs).select(F.col("node").alias("book"), F.col("component").alias("grp"))


def guarded_groups(pairs: DataFrame, books: DataFrame, limits: Thresholds) -> DataFrame:
    """(book, grp): groups merged pair by pair, by falling score, then a, then b.

    A merge of two groups is refused unless their representatives are an
    accepted pair too; with guard "strict" a lone book stands for itself, with
    "reference" only groups have representatives. Decisions depend on nothing
    outside a connected component, so components are handled apart; within one
    the order of merges is the rule itself, so a component is one task.
    pairs: accepted(); books: (book, path, size).
    """
    found = keep(components(pairs).withColumnsRenamed({"node": "a"}), "pair-components")
    quality = books.select("book", (-suspects(basename(F.col("path")))).alias("clean"), (-F.length("path")).alias("short"), F.col("size").cast("long").alias("size"), F.lower("path").alias("path"))
    side = lambda s: quality.select(F.col("book").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("clean", "short", "size", "path")])
    rows = pairs.select("a", "b", "score", "chain", "ratio").join(found, "a").join(side("a"), "a").join(side("b"), "b")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "a", "b"], ascending=[False, True, True])
        rank, good, group, head = {}, set(), {}, {}
        for r in pdf.itertuples(index=False):
            rank[r.a] = (r.a_clean, r.a_short, r.a_size, r.a_path)
            rank[r.b] = (r.b_clean, r.b_short, r.b_size, r.b_path)
            group.setdefault(r.a, {r.a})
            group.setdefault(r.b, {r.b})
            if r.chain >= limits.min_pages and r.ratio >= limits.ratio:
                good.add((r.a, r.b))
        for r in pdf.itertuples(index=False):
            one, two = group[r.a], group[r.b]
            if one is two:
                continue
            grouped = (len(one) > 1, len(two) > 1)
            if all(grouped) or (limits.guard == "strict" and any(grouped)):
                x, y = head.get(id(one), r.a), head.get(id(two), r.b)
                if (x, y) != (r.a, r.b) and (min(x, y), max(x, y)) not in good:
                    continue
            best = max(head.pop(id(one), r.a), head.pop(id(two), r.b), key=lambda k: (rank[k], -k))
            one |= two
            for member in two:
                group[member] = one
            head[id(one)] = best
        return pd.DataFrame([(book, min(members)) for book, members in group.items() if len(members) > 1], columns=["book", "grp"])

    return rows.groupBy("component").applyInPandas(merge, "book long, grp long")
