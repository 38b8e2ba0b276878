"""How good a result is: recall against a proxy truth, score percentiles, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def pairs_of(rows: DataFrame, book: str, key: Sequence[str]) -> DataFrame:
    """(a, b), a < b: books with equal ``key``, in every pair; keys are for small classes of a truth."""
    a = rows.select(*key, F.col(book).alias("a"))
    b = rows.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(book).alias("b"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, same & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: expected, hit, missed, unsupported pairs; recall and support. Pairs are (a, b) in any order."""
    norm = lambda df: df.select(*[c.alias(n) for c, n in zip(unordered(F.col("a"), F.col("b")), "ab", strict=True)]).distinct()
    t, f = norm(truth).withColumn("t", F.lit(1)), norm(found).withColumn("f", F.lit(1))
    both = t.join(f, ["a", "b"], "full")
    out = both.agg(F.count("t").alias("expected"), F.count("f").alias("found"), F.count(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1)).alias("hit"))
    out = out.withColumn("missed", F.col("expected") - F.col("hit")).withColumn("unsupported", F.col("found") - F.col("hit"))
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    return out.withColumn("recall", share("hit", "expected")).withColumn("support", share("hit", "found"))


def percentiles(scores: DataFrame, by: str, value: str) -> DataFrame:
    """For each ``by``: n, least, p5, median, p99 and greatest ``value``, exact."""
    at = lambda p: F.percentile(F.col(value), F.lit(p))
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), at(0.05).alias("p5"), at(0.5).alias("median"), at(0.99).alias("p99"), F.max(value).alias("greatest"))


def votes(cells: DataFrame, least_score: float, least_votes: int) -> DataFrame:
    """(a_book, b_book, votes): pairs of books with enough cells of at least ``least_score``."""
    return cells.where(F.col("score") >= least_score).groupBy("a_book", "b_book").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least_votes)
